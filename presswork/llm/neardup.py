"""Near-duplicate documents: MinHash bands, verification on full sets, connected components.

A document's set holds the 64-bit hashes of its distinct five-word shingles; documents with equal sets are one node.

1. Signatures: ``BANDS * ROWS`` minima of universal hashes (multiply-shift) of the set; each band of ``ROWS``
   minima is a key. A pair of similarity 0.75 shares a key with probability 1 - (1 - 0.75^4)^40, all but 3e-7.
2. Stars: in every bucket of a band key, one node, the first in one of ``ORDERS`` seeded orders, is compared with the
   others: as many pairs as members, and nodes of a large group meet several centres over the bands.
3. Verification: pairs whose signatures agree in fewer than ``LEAST_AGREEMENT`` of the minima (seven standard
   deviations below 0.75) are dropped; the others are compared on their full sets.
4. Components of the links by alternating large-star and small-star.
5. The rest: a bucket whose members all lie in one component needs no more pairs. Of the others, members outside
   their bucket's largest component are joined with members of other components by prefixes: sets in order of rarity
   that are similar enough share a shingle early in both, so that only pairs that share one of their rare shingles
   meet. Of a family of near copies that is a pair of nearly everyone, so the join carries a bitmap of each set: the
   parities of its shingles in ``PARITIES`` places. Two bitmaps differ in at most as many places as the sets have
   shingles apart, and pairs that differ in more than similar sets can are proven apart inside the join. Links found
   join the components. After this step each pair of nodes that share a bucket is linked, in one component, compared,
   or proven apart.

Only node numbers, band keys and the sets of nodes in shared buckets are shuffled; sets are made anew from the texts
of those nodes, which a second scan picks out by row number. Buckets and components are aggregated and joined, never
collected. Joins are hinted to sort and merge, so that plans are the same at every size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import Found, ascii_lower, by_partition, fresh, split_words, written
from presswork.llm.components import components

SHINGLE = 5
ROWS, BANDS = 4, 40
SEED = 11
#: Seeded orders of the nodes that band keys choose from for their star's centre.
ORDERS = 4
LEAST_AGREEMENT = 0.5
#: Places of a set's parity bitmap, a multiple of 64.
PARITIES = 1024
#: Linked if NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: Arrow batches of this many bytes keep a Python worker small.
BATCH_BYTES = 4 << 20


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    return F.transform(split_words(ascii_lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))


def _hash_family(n: int):
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; words of document i are flat[offsets[i]:offsets[i + 1]]."""
    h = flat.astype(np.uint64, copy=False)

    def mixed(parts, n):
        out = np.full(len(parts[0]), n, np.uint64)
        for p in parts:
            out = out * np.uint64(0x9E3779B97F4A7C15) + p
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))

    with np.errstate(over="ignore"):
        rolled = mixed([h[k: len(h) - size + 1 + k] for k in range(size)], size) if len(h) >= size else h[:0]
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            n = b - a
            if n >= size:
                s = np.sort(rolled[a: b - size + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                out.append(mixed([h[i: i + 1] for i in range(a, b)], n))
            else:
                out.append(h[:0])
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set as a row; an empty set has the largest value everywhere."""
    n = ROWS * BANDS
    sig = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    mul, add = _hash_family(n)
    group, size = [], 0

    def done():
        x = np.concatenate([sets[i] for i in group])
        starts = np.cumsum([0] + [len(sets[i]) for i in group[:-1]])
        with np.errstate(over="ignore"):
            for k in range(n):
                sig[group, k] = np.minimum.reduceat(((x * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32), starts)

    for i, s in enumerate(sets):
        if len(s):
            group.append(i)
            size += len(s)
            if size >= 100_000:
                done()
                group, size = [], 0
    if group:
        done()
    return sig


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    words = batch.column("_h")
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    words = words.cast(pa.list_(pa.int64()))
    offsets = words.offsets.to_numpy()
    flat = words.values.to_numpy(zero_copy_only=False)
    return shingle_sets(flat.view(np.uint64), offsets)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, which no two bands share but by chance."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        out += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for r in range(ROWS):
            out = (out ^ sig[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _list_array(values: np.ndarray, lengths, kind) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _summaries(batches):
    for batch in batches:
        sets = _sets_of(batch)
        keys = _band_keys(minima(sets))
        full = [len(s) > 0 for s in sets]
        keys = keys[full].ravel() if full else keys.ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_key"), batch.column("_rid"), batch.column("_t"), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), _list_array(keys, [BANDS * f for f in full], pa.int64())],
            ["_key", "_rid", "_t", "_node", "_n", "_bands"])


def _pick(path: str):
    """Of rows (_rid, _text), those whose number the table at ``path`` has, with their node."""
    def pick(batches):
        found, part, nodes = Found(path), None, {}
        for batch in batches:
            rids = batch.column("_rid").to_pylist()
            on, want = [], []
            for i, rid in enumerate(rids):
                if part != rid >> 33:
                    part = rid >> 33
                    t = found.of(part)
                    nodes = {} if t is None else dict(zip(t.column("_rid").to_pylist(), t.column("_node").to_pylist()))
                if rid in nodes:
                    on.append(i)
                    want.append(nodes[rid])
            yield pa.RecordBatch.from_arrays([pa.array(want, pa.int64()), batch.column("_text").take(pa.array(on, pa.int64()))], ["_want", "_text"])

    return pick


def _parities(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set: bit p tells whether an odd number of its shingles fall on place p."""
    with np.errstate(over="ignore"):
        place = ((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(PARITIES)
    odd = np.bincount(place.astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _full_sets(batches):
    for batch in batches:
        sets = _sets_of(batch)
        nodes = [_node(s) if len(s) else None for s in sets]
        want = batch.column("_want").to_pylist()
        on = [i for i, n in enumerate(nodes) if n is not None and n == want[i]]
        own = [sets[i] for i in on]
        flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
        sig = minima(own).view(np.int32)
        bits = np.concatenate([_parities(s) for s in own]) if own else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i in on], pa.int64()), _list_array(flat, [len(s) for s in own], pa.int64()),
             _list_array(sig.ravel(), [sig.shape[1]] * len(own), pa.int32()), _list_array(bits, [PARITIES // 64] * len(own), pa.int64())],
            ["_node", "_set", "_sig", "_bits"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are similar enough on their full sets."""
    a = sets.select(F.col("_node").alias("a"), F.col("_set").alias("sa"), F.col("_sig").alias("ga"))
    b = sets.select(F.col("_node").alias("b"), F.col("_set").alias("sb"), F.col("_sig").alias("gb"))
    j = pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    agree = F.size(F.filter(F.zip_with("ga", "gb", lambda x, y: x == y), lambda x: x))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    similar = F.when(agree >= int(LEAST_AGREEMENT * ROWS * BANDS), DEN * both >= NUM * union).otherwise(False)
    return j.filter(similar).select("a", "b")


def _rest(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of step 5: (a, b) of different components, one of them outside its bucket's largest component."""
    members = buckets.join(labels, F.col("_node") == F.col("node"), "left")
    members = members.select("_k", "_node", F.coalesce("root", "_node").alias("_root"))
    per = members.groupBy("_k", "_root").agg(F.count(F.lit(1)).alias("c"))
    open_ = per.groupBy("_k").agg(F.max(F.struct("c", "_root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = open_.select(F.col("_k").alias("_ok"), F.col("m._root").alias("_largest"))
    members = members.join(open_, F.col("_k") == F.col("_ok"))
    nodes = members.groupBy(F.col("_node").alias("_member"), F.col("_root").alias("_r")).agg(F.max((F.col("_root") != F.col("_largest")).cast("int")).alias("_out"))
    nodes = written(nodes, "near-open")
    shingles = sets.join(nodes.hint("merge"), F.col("_node") == F.col("_member")).select("_node", "_r", "_out", F.size("_set").alias("n"), F.explode("_set").alias("s"))
    shingles = written(shingles, "near-shingles")
    counts = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("c")).select(F.col("s").alias("cs"), "c")
    place = F.row_number().over(Window.partitionBy("_node").orderBy("c", "s")) - 1
    ranked = shingles.join(counts, F.col("s") == F.col("cs")).withColumn("i", place)
    ranked = ranked.filter((F.col("c") > 1) & (DEN * F.col("i") <= (DEN - NUM) * F.col("n")))
    bits = sets.select(F.col("_node").alias("_bnode"), "_bits")
    ranked = ranked.select("s", "_node", "_r", "_out", "n", "i").join(bits.hint("merge"), F.col("_node") == F.col("_bnode"))
    ranked = written(ranked.drop("_bnode"), "near-prefixes")
    y = ranked.filter("_out = 1").select("s", F.col("_node").alias("y"), F.col("_r").alias("ry"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("_bits").alias("by"))
    x = ranked.select("s", F.col("_node").alias("x"), F.col("_r").alias("rx"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("_bits").alias("bx"))
    # similar sets share at least this many shingles, so the first one they share stands before this many from the end
    least = F.ceil(NUM * (F.col("nx") + F.col("ny")) / (DEN + NUM))
    near = (F.col("rx") != F.col("ry")) & (F.col("iy") <= F.col("ny") - least) & (F.col("ix") <= F.col("nx") - least)
    # shingles that only one of them has: at most this many, and each place where the bitmaps differ stands for one at least
    apart = F.col("nx") + F.col("ny") - 2 * least
    differ = sum((F.bit_count(F.col("bx")[w].bitwiseXOR(F.col("by")[w])) for w in range(PARITIES // 64)), F.lit(0))
    near = near & (differ <= apart)
    return y.join(x, "s").filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, _rid (row number), _t (hash of the text), _n (set size), _root (the component's node; null without words)
    and component_id (smallest key of the row's component) of every row.

    Empty and null texts have empty sets and are linked with nothing. Repeated rows are one node, so are texts with
    equal sets; a null key never wins over another, and a component of null keys only has the id null. Other columns
    are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = df.select(F.col(key).alias("_key")).schema["_key"].dataType.simpleString()
    source = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_rid"), F.xxhash64(F.col(text)).alias("_t"),
                       word_hashes(F.col(text)).alias("_h"))
    base = written(source.mapInArrow(_summaries, f"_key {kind}, _rid long, _t long, _node long, _n long, _bands array<long>"), "near-base")

    keys = base.select("_node", F.explode("_bands").alias("_k"))
    salt = F.xxhash64(F.pmod("_k", F.lit(ORDERS)))
    centres = keys.groupBy("_k").agg(F.min(F.col("_node").bitwiseXOR(salt)).alias("_x"), F.min("_node").alias("lo"), F.max("_node").alias("hi"))
    centres = centres.filter("lo < hi").select(F.col("_k").alias("_ck"), F.col("_x").bitwiseXOR(salt).alias("_centre"))
    buckets = written(keys.join(centres.hint("merge"), F.col("_k") == F.col("_ck")).select("_k", "_node", "_centre").distinct(), "near-buckets")
    stars = buckets.filter("_node <> _centre").select(F.least("_node", "_centre").alias("a"), F.greatest("_node", "_centre").alias("b"))
    stars = written(stars.distinct(), "near-stars")

    # one row per node before the join, so that many copies of a text are added up where they are read
    wanted = (base.groupBy("_node").agg(F.min("_rid").alias("_rid")).join(buckets.select("_node").distinct(), "_node", "left_semi")
              .withColumn("part", F.shiftright("_rid", 33).cast("int")))
    texts = df.select(F.monotonically_increasing_id().alias("_rid"), F.col(text).alias("_text"))
    texts = texts.mapInArrow(_pick(by_partition(wanted, "near-wanted")), "_want long, _text string")
    sets = texts.select("_want", word_hashes(F.col("_text")).alias("_h")).mapInArrow(_full_sets, "_node long, _set array<long>, _sig array<int>, _bits array<long>")
    sets = written(sets, "near-sets")
    if sets.count() != buckets.select("_node").distinct().count():
        raise RuntimeError("the documents changed between two scans")

    links = written(_compared(stars, sets), "near-links")
    labels = components(links)
    more = written(_rest(buckets, labels, sets), "near-rest")
    found = written(_compared(more.join(stars, ["a", "b"], "left_anti"), sets), "near-links")
    if not found.isEmpty():
        labels = components(links.unionByName(found))

    rows = base.select("_key", "_rid", "_t", "_node", "_n").join(labels, F.col("_node") == F.col("node"), "left")
    rows = rows.select("_key", "_rid", "_t", "_n", F.coalesce("root", "_node").alias("_root"))
    least = rows.filter("_n > 0").groupBy("_root").agg(F.min("_key").alias("_least")).select(F.col("_root").alias("_lroot"), "_least")
    least = written(least, "near-least")  # the join below reads plain tables, so that Spark can split a hot component
    out = rows.join(least, F.col("_root") == F.col("_lroot"), "left")
    return out.select("_key", "_rid", "_t", "_n", "_root", F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_key")).alias("component_id"))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is the component's id) of every row."""
    g = groups(df)
    return g.select(F.col("_key").alias("doc_id"), F.col("_n").alias("n_shingles"), "component_id",
                    F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component, and every row without words.

    The row that stays has the component's smallest key (a null key only where there is no other) and, of the texts
    with that key, the one with the smallest hash; of rows that agree in key and text one stays. Rows are told apart by
    key and text, so that others with the same key or with a null key are judged by their own text.
    """
    dkey, dtext, mine = fresh(df, "_dropped", "_dropped_text", "_own_text")
    g = groups(df, key, text).filter("_n > 0")
    per = written(g.groupBy("_root", "_key", "_t").agg(F.count(F.lit(1)).alias("c")), "near-groups")
    first = per.groupBy("_root").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "_t")).alias("f"))
    first = written(first.select(F.col("_root").alias("_froot"), F.col("f._key").alias("_fkey"), F.col("f._t").alias("_ft")), "near-first")
    per = per.join(first, F.col("_root") == F.col("_froot"))
    per = per.withColumn("_first", F.col("_key").eqNullSafe(F.col("_fkey")) & (F.col("_t") == F.col("_ft")))
    marked = written(per.filter("NOT _first OR c > 1").select(F.col("_key").alias(dkey), F.col("_t").alias(dtext), "_first"), "near-marked")
    same = F.col(key).eqNullSafe(F.col(dkey)) & (F.xxhash64(F.col(text)) == F.col(dtext))
    kept = df.join(marked.drop("_first"), same, "left_anti")
    repeated = marked.filter("_first").drop("_first")
    if repeated.isEmpty():
        return kept
    again = df.join(repeated, same, "left_semi").withColumn(mine, F.xxhash64(F.col(text))).dropDuplicates([key, mine])
    return kept.unionByName(again.drop(mine))
