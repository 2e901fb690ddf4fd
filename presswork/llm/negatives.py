"""Hard negatives of anchors among all vectors, by bounds along spanning trees of the anchors.

Vectors are whole numbers, scores are inner products. For an anchor c and an anchor p with known scores, every row x
satisfies ``|score(c, x) - score(p, x)| <= |c - p| * |x|``. Anchors are dealt into groups of neighbours (by the signs
of a few projections), each group is given its minimum spanning tree, and the trees are walked from their roots: a child
anchor gets for every row an interval from its parent's, wider by the edge's length times the row's norm. Only rows
whose interval meets the window of scores that matters for the child are scored again, exactly; the others hand their
interval on. Copies of an anchor have edges of length zero and are scored once.

Rows are met in chunks of bounded size, every chunk with every anchor group, read one group at a time: a stated query set
against all rows, in blocks. The window is, first, the scores among the best ``positives`` of the anchor's own label;
then, for each positive, the scores from ``low`` to ``high`` percent of the positive's, of other labels, and among the
best ``negatives`` there. In both passes a chunk returns its own best rows per anchor, and Spark ranks these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import open_path, written
from presswork.session import scratch_path

#: Anchors in one tree and rows in one chunk: what a task holds beside each other.
GROUP = 256
CHUNK = 10_000
#: Signs of projections that bring near anchors together.
SIGNS = 16
#: Sums of products of whole numbers up to here are exact in doubles.
EXACT = float(1 << 52)


def prepared(df: DataFrame, row_id: str, vector: str, label: Column | str, scale: int = 256) -> DataFrame:
    """(_rid, id, label, vec) of the rows that take part: each component as floor(scale * component), a double."""
    times = lambda c: F.lit(float(scale)) * c.cast("double")
    big = lambda c: F.abs(times(c)) >= EXACT  # a whole number already, and perhaps none that fits in a long
    x = F.transform(F.col(vector), lambda c: F.when(big(c), times(c)).otherwise(F.floor(times(c)).cast("double")))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(times(c)) & (F.abs(times(c)) != float("inf")))
    rows = df.select(F.col(row_id).alias("id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(vector))
    rows = rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(fine)
    return rows.select(F.monotonically_increasing_id().alias("_rid"), "id", "label", x.alias("vec"))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end with zeros, which add nothing to an inner product."""
    flat, offsets = np.asarray(column.flatten()), np.diff(column.offsets.to_numpy())
    if len(offsets) and (offsets == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(offsets), width))
    out[np.repeat(np.arange(len(offsets)), offsets), np.arange(len(flat)) - np.repeat(np.cumsum(offsets) - offsets, offsets)] = flat
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of visit, parent of each, length of the edge to it) of a minimum spanning tree; the first is its own parent."""
    n = len(vectors)
    order, parent, length = [0], np.zeros(n, np.int64), np.full(n, np.inf)
    open_ = np.ones(n, bool)
    open_[0], at = False, 0
    length[0] = 0.0
    for _ in range(n - 1):
        away = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
        nearer = open_ & (away < length)
        length[nearer], parent[nearer] = away[nearer], at
        at = int(np.argmin(np.where(open_, length, np.inf)))
        open_[at] = False
        order.append(at)
    return np.array(order), parent, length


def _trees(width: int):
    """Anchors in the order of their trees: tree, place, place of the parent, length of the edge."""

    def build(batches):
        tree = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                vectors = _matrix(part.column("vec"), width)
                order, parent, length = spanning_tree(vectors)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                part = part.take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_rid", "id", "label", "vec")), pa.array(np.full(len(order), tree)), pa.array(np.arange(len(order))),
                     pa.array(place[parent[order]]), pa.array(length[order])], ["_rid", "id", "label", "vec", "tree", "place", "parent", "edge"])
                tree += 1

    return build


def trees(anchors: DataFrame, width: int) -> DataFrame:
    """The anchors with the tree they are in; neighbours by the signs of projections are dealt to the same tree."""
    pick = np.random.default_rng(7).standard_normal((SIGNS, width))
    code = None
    for k, row in enumerate(pick.tolist()):
        dot = F.aggregate(F.zip_with("vec", F.array(*map(F.lit, row)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
        bit = F.shiftleft((dot > 0).cast("long"), SIGNS - 1 - k)
        code = bit if code is None else code + bit
    spark = anchors.sparkSession
    coded = written(anchors.withColumn("_code", code), "anchors")
    n = max(1, -(-coded.count() // (4 * GROUP)))
    dealt = coded.repartitionByRange(n, "_code", "_rid").sortWithinPartitions("_code", "_rid")
    schema = "_rid long, id long, label long, vec array<double>, tree long, place long, parent long, edge double"
    return written(dealt.select("_rid", F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vec").mapInArrow(_trees(width), schema), "trees")


def by_tree(tree_rows: DataFrame, extra: DataFrame | None = None) -> str:
    """Folder with the trees' rows, whole trees per file and in order; ``extra`` joins columns by ``_rid``."""
    path = scratch_path(tree_rows.sparkSession, "by-tree")
    rows = tree_rows if extra is None else tree_rows.join(extra, "_rid", "left")
    rows.repartition("tree").sortWithinPartitions("tree", "place").write.option("parquet.block.size", 4 << 20).parquet(path)
    return path


def _read_trees(path: str):
    """The trees of a folder, one after the other."""
    fs, root = open_path(path)
    from pyarrow.fs import FileSelector

    for info in fs.get_file_info(FileSelector(root)):
        if not info.path.endswith(".parquet"):
            continue
        with fs.open_input_file(info.path) as f:
            rest = None
            file = pq.ParquetFile(f)
            for batch in file.iter_batches(batch_size=4 * GROUP):
                part = pa.Table.from_batches([batch])
                rest = part if rest is None else pa.concat_tables([rest, part])
                ids = rest.column("tree").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist()]
                for a, b in zip(edges, edges[1:]):
                    yield rest.slice(a, b - a).combine_chunks()
                rest = rest.slice(edges[-1])
            if rest is not None and len(rest):
                yield rest.combine_chunks()


class Walk:
    """Scores of one chunk of rows under the anchors of a tree, as intervals where nothing more is needed."""

    def __init__(self, rows: np.ndarray, norms: np.ndarray, anchors: np.ndarray):
        self.rows, self.norms, self.anchors = rows, norms, anchors
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        self.scored = 0

    def exact(self, place: int, which: np.ndarray) -> np.ndarray:
        if 2 * len(which) > len(self.rows):  # cheaper than picking them out
            self.scored += len(self.rows)
            return (self.rows @ self.anchors[place])[which]
        self.scored += len(which)
        return self.rows[which] @ self.anchors[place]

    def enter(self, place: int, parent: int, edge: float) -> None:
        if place == 0:
            self.low[0] = self.rows @ self.anchors[0]
            self.high[0] = self.low[0].copy()
            self.scored += len(self.rows)
            return
        if not edge:  # a copy of its parent
            self.low[place], self.high[place] = self.low[parent].copy(), self.high[parent].copy()
            return
        # a little more than the product, so that rounding loses no row
        size = np.abs(self.anchors[place]).max() * self.norms * len(self.anchors[place])
        slack = edge * self.norms * (1 + 1e-9) + 1e-6 + 1e-12 * size.astype(float)
        self.low[place], self.high[place] = self.low[parent].astype(float) - slack, self.high[parent].astype(float) + slack

    def among(self, place: int, fit: np.ndarray, floor: float, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the fitting rows that score from ``floor`` to ``ceiling``; their intervals become points."""
        low, high = self.low[place], self.high[place]
        which = np.flatnonzero(fit & (high >= floor) & (low <= ceiling))
        open_ = which[low[which] != high[which]]
        if len(open_):
            got = self.exact(place, open_)
            if got.dtype != low.dtype:  # whole numbers beyond what doubles hold
                self.low[place], self.high[place] = low, high = low.astype(got.dtype), high.astype(got.dtype)
            low[open_] = high[open_] = got
        scores = low[which]
        ok = (scores >= floor) & (scores <= ceiling)
        return which[ok], scores[ok]

    def best(self, place: int, fit: np.ndarray, floor: float, ceiling: float, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first n by score, ties by id; rows that cannot be among them are not scored."""
        which = np.flatnonzero(fit & (self.high[place] >= floor) & (self.low[place] <= ceiling))
        if len(which) > 4 * n:  # lower bounds under the ceiling tell how good the n-th is at least
            low, high = self.low[place][which], self.high[place][which]
            sure = low[(high <= ceiling) & (low >= floor)]
            if len(sure) >= n:
                floor = max(floor, np.sort(sure)[len(sure) - n] if sure.dtype == object else np.partition(sure, len(sure) - n)[len(sure) - n])
        which, scores = self.among(place, fit, floor, ceiling)
        if len(which) > n:
            nth = np.sort(scores)[len(scores) - n] if scores.dtype == object else np.partition(scores, len(scores) - n)[len(scores) - n]
            keep = scores >= nth
            which, scores = which[keep], scores[keep]
        order = np.lexsort((ids[which], -scores))[:n]
        return which[order], scores[order]


def _long(scores: np.ndarray) -> list[int]:
    return [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores]


def _chunks(batches, width: int):
    """Chunks of rows: (record ids, ids, labels, matrix, norms); null ids come last among ties."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            rows = _matrix(part.column("vec"), width)
            norms = np.sqrt((rows ** 2).sum(1))
            ids = part.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
            yield part, ids, part.column("label").to_numpy(), rows, norms


def _check(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where sums of products are exact in them, else Python's whole numbers."""
    top = np.abs(rows).sum(1).max(initial=0.0) * np.abs(anchors).max(initial=0.0)
    if top < EXACT:
        return rows, anchors
    whole = np.frompyfunc(int, 1, 1)
    return whole(rows), whole(anchors)


def _pass(path: str, width: int, positives: int, negatives: int, low: int, high: int, second: bool):
    """First pass: best rows of the anchor's label. Second: for each distinct positive score, best rows of other labels."""

    def search(batches):
        for part, ids, labels, rows, norms in _chunks(batches, width):
            rids = part.column("_rid").to_numpy()
            null_id = part.column("id").is_null().to_numpy(zero_copy_only=False)
            for tree in _read_trees(path):
                anchors = _matrix(tree.column("vec").chunk(0) if isinstance(tree.column("vec"), pa.ChunkedArray) else tree.column("vec"), width)
                own_rows, anchors = _check(rows, anchors)
                walk = Walk(own_rows, norms, anchors)
                out = []
                windows = tree.column("scores").to_pylist() if second else None
                last_use = {}
                for place, parent in enumerate(tree.column("parent").to_pylist()):
                    last_use[parent] = place
                for place, (rid, label, parent, edge) in enumerate(zip(*(tree.column(c).to_pylist() for c in ("_rid", "label", "parent", "edge")))):
                    walk.enter(place, parent, edge)
                    if second:
                        fit = labels != label
                        for score in windows[place] or []:
                            # 100 * negative from low * score to high * score
                            floor, ceiling = -(-low * score // 100), high * score // 100
                            if floor <= ceiling:
                                which, scores = walk.best(place, fit, floor, ceiling, negatives, ids)
                                out += [(rid, score, None if null_id[i] else int(ids[i]), s) for i, s in zip(which.tolist(), _long(scores))]
                    else:
                        fit = (labels == label) & (rids != rid)
                        which, scores = walk.best(place, fit, -np.inf, np.inf, positives, ids)
                        out += [(rid, None if null_id[i] else int(ids[i]), s, int(rids[i])) for i, s in zip(which.tolist(), _long(scores))]
                    if last_use.get(parent, -1) <= place and parent != place:
                        walk.low.pop(parent, None), walk.high.pop(parent, None)
                    if last_use.get(place, -1) <= place:
                        walk.low.pop(place, None), walk.high.pop(place, None)
                if out:
                    names = ["_rid", "positive_score", "negative_id", "negative_score"] if second else ["_rid", "positive_id", "positive_score", "_at"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return search


def mine(df: DataFrame, row_id: str, vector: str, label: Column | str, is_anchor: Column, positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    ``is_anchor``: condition on ``id``. Rows with a null label or vector, or a null or non-finite component, take no
    part; vectors of unequal length are compared as if the shorter one went on with zeros. Rows with the same id are
    rows of their own: each copy of an anchor returns its results, and copies are positives and negatives each. Rows
    whose id is null are no anchors and come last among ties. An anchor without positives, or without rows in the window,
    returns nothing; so does an empty table. Scores are exact; those beyond a
    long are given as the largest or smallest one. Other columns are not returned.
    """
    spark = df.sparkSession
    rows = written(prepared(df, row_id, vector, label, scale), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    width = max(1, width)
    slots = spark.sparkContext.defaultParallelism
    chunks = rows.select("_rid", F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vec")
    chunks = written(chunks.repartition(max(1, min(slots, -(-n // 1024)), -(-n // (8 * CHUNK)))), "chunks")
    forest = trees(rows.filter(is_anchor), width)

    first = chunks.mapInArrow(_pass(by_tree(forest), width, positives, negatives, low, high, False), "_rid long, positive_id long, positive_score long, _at long")
    by_score = Window.partitionBy("_rid").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "_at")
    chosen = first.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= positives)
    chosen = written(chosen.select("_rid", "positive_id", "positive_score"), "positives")
    scores = chosen.groupBy("_rid").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # at most ``positives`` each

    second = chunks.mapInArrow(_pass(by_tree(forest, scores), width, positives, negatives, low, high, True), "_rid long, positive_score long, negative_id long, negative_score long")
    by_score = Window.partitionBy("_rid", "positive_score").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    ranked = second.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    ids = forest.select("_rid", F.col("id").alias("anchor_id"))
    return (ranked.join(chosen, ["_rid", "positive_score"]).join(ids, "_rid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def rotated_label(row_id: str = "vec_id", label: str = "label") -> Column:
    """The label, one on (of ten) where the id is divisible by 7."""
    return F.when(F.col(row_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))


def digest(df: DataFrame) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose vec_id is divisible by 100."""
    return mine(df, "vec_id", "embedding", rotated_label(), F.col("id") % 100 == 0)


DIGEST_SQL = """
WITH parts AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM parts),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, x.r AS xr, x.vec_id AS xid, x.label AS xl,
         list_dot_product(a.v, x.v)::BIGINT AS score
  FROM vectors a JOIN vectors x ON a.vec_id % 100 = 0 AND a.r <> x.r),
positives AS (
  SELECT ar, anchor_id, xid AS positive_id, xr, score AS positive_score FROM scored WHERE al = xl
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, xid, xr) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w::INTEGER AS rank, s.xid AS negative_id, p.positive_score,
       s.score AS negative_score
FROM positives p JOIN scored s ON s.ar = p.ar AND s.al <> s.xl
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.ar, p.xr ORDER BY s.score DESC, s.xid)
QUALIFY row_number() OVER w <= 10
"""
