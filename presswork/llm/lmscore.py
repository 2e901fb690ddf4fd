"""Cross-entropy difference: how much likelier a target model finds a document than a background model.

A token is a word (a run without ASCII white space). Both models count the words of their documents and fall back, with
Witten-Bell smoothing, on spelling a word: an interpolated trigram model over the bytes of UTF-8 text and a start mark
gives the word and the white space after it. The vocabulary is shared: all words of all documents, which grow with the
corpus; the words that only the background has are spelled by the target model, so that no token is ever unknown. The
target model is trained on the documents of a target set (here: labelled good and not toxic), the background model on
all documents, in the same way. A document's score is the mean loss of its words under the target model minus that under
the background model, in nats: the lower, the closer to the target.

Tasks count whole texts; Spark adds up the counts, by trigram and by word. The trigrams (at most 257 * 257 * 256,
whatever the input) are worked out by joins and read by every scoring task. Words have no such bound: a scan task reads
the corpus-wide counts of the words of its own rows only, which a join on the word puts into a table partitioned by scan
partition. This relies on scans of the same frame having the same partitions; a word or a target that a task does not
find again is an error. Words are held as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import Found, by_partition, open_path, written
from presswork.session import scratch_path

#: Symbols of a context: 256 bytes and the start mark.
SYMBOLS = 257
START = 256
#: Bytes of a text that are worked on at once, up to the end of a word and the white space after it.
PIECE = 1 << 20
#: Words that a task holds before it hands on their counts.
WORDS_HELD = 4 << 20
BATCH_BYTES = 4 << 20
TRIGRAM, WORD_KIND = 0, 1

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def _bytes_of(batch: pa.RecordBatch):
    text = batch.column("_text").fill_null("").cast(pa.large_binary())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + n + 1]
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def codes_of(data: np.ndarray, begin: int, end: int, at: int, stop: int) -> np.ndarray:
    """Trigram codes of the tokens at..stop of the text begin..end: (before-last, last, token) in base SYMBOLS."""
    lead = np.array([START, START], np.int32)
    low = max(begin, at - 2)
    x = np.concatenate((lead[: 2 - (at - low)], data[low:stop].astype(np.int32)))
    return (x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:]


def word_starts(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Places between begin and end where a word begins; a word that goes on at ``begin`` counts as beginning there."""
    gap = _GAP[data[begin:end]]
    return np.flatnonzero(~gap & np.concatenate(([True], gap[:-1]))) + begin


def word_hashes(data: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """64-bit hashes of the words that begin at ``starts``: sums of a random value for each byte at its place in the word."""
    x = data[starts[0]:end]
    lengths = np.diff(np.append(starts, end))
    place = np.arange(len(x), dtype=np.int64) - np.repeat(starts - starts[0], lengths)
    with np.errstate(over="ignore"):
        v = (place.astype(np.uint64) * np.uint64(256) + x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
        v[_GAP[x]] = 0
        return np.add.reduceat(v, starts - starts[0]).view(np.int64)


def _ends(data: np.ndarray, begin: int, end: int):
    """Ends of the pieces of a text: places where a word begins, at least PIECE bytes apart, and its end."""
    at = begin
    while at < end:
        at = min(at + PIECE, end)
        while at < end and (_GAP[data[at]] or not _GAP[data[at - 1]]):
            near = data[at - 1: at + PIECE]
            gap = _GAP[near]
            found = np.flatnonzero(gap[:-1] & ~gap[1:])
            at = at + int(found[0]) if len(found) else min(at + max(len(near) - 1, 1), end)
        yield at


def _pieces(batch: pa.RecordBatch):
    """(row, trigram codes, word hashes, places of the words among the codes) of texts and, for long ones, of their parts."""
    data, offsets = _bytes_of(batch)
    for row in range(batch.num_rows):
        a, b = int(offsets[row]), int(offsets[row + 1])
        at = a
        for stop in _ends(data, a, b):
            starts = word_starts(data, at, stop)
            words = word_hashes(data, starts, stop) if len(starts) else np.zeros(0, np.int64)
            yield row, codes_of(data, a, b, at, stop), words, starts - at
            at = stop


def _targets(found: Found, part: int, batch: pa.RecordBatch, seen: list) -> np.ndarray:
    """Which rows are targets; ``seen`` collects the keys met."""
    keys = found.of(part)
    if keys is None:
        return np.zeros(batch.num_rows, bool)
    keys = keys.column("_key")
    flag = pc.is_in(batch.column("_key"), value_set=keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys)
    seen.append(pc.unique(batch.column("_key").filter(flag)))
    return flag.to_numpy(zero_copy_only=False)


class _Counter:
    """Codes of one kind with their flags, counted when enough are held."""

    def __init__(self, kind: int, held: int, part: int):
        self.kind, self.held, self.part = kind, held, part
        self.codes, self.flags, self.size = [], [], 0

    def add(self, codes: np.ndarray, flag: bool):
        self.codes.append(codes)
        self.flags.append(flag)
        self.size += len(codes)

    def full(self) -> bool:
        return self.size >= self.held

    def flush(self) -> pa.RecordBatch:
        code, where = np.unique(np.concatenate(self.codes), return_inverse=True)
        target = np.repeat(np.array(self.flags, bool), [len(c) for c in self.codes])
        n = np.bincount(where, minlength=len(code)).astype(np.int64)
        t = np.bincount(where[target], minlength=len(code)).astype(np.int64)
        self.codes, self.flags, self.size = [], [], 0
        same = lambda v, kind: pa.array(np.full(len(code), v), kind)
        return pa.RecordBatch.from_arrays(
            [same(self.kind, pa.int32()), same(self.part, pa.int32()), pa.array(code.astype(np.int64)), pa.array(n), pa.array(t)],
            ["kind", "part", "code", "n", "t"])


def _count(target_path: str):
    def count(batches):
        part = TaskContext.get().partitionId()
        found, seen = Found(target_path), []
        counters = _Counter(TRIGRAM, 2 * PIECE, part), _Counter(WORD_KIND, WORDS_HELD, part)
        for batch in batches:
            target = _targets(found, part, batch, seen)
            for row, codes, words, _ in _pieces(batch):
                for counter, c in zip(counters, (codes, words)):
                    counter.add(c, bool(target[row]))
                    if counter.full():
                        yield counter.flush()
        wanted = found.of(part)
        met = len(pc.unique(pa.chunked_array(seen))) if seen else 0
        if wanted is not None and met != wanted.num_rows:
            raise RuntimeError(f"partition {part} has {met} of its {wanted.num_rows} targets: its rows changed between two scans")
        for counter in counters:
            if counter.size:
                yield counter.flush()

    return count


def _smoothed(counts: DataFrame, n: str, out: str) -> DataFrame:
    """``counts`` (u, v, w, ...) with the probability of w after (u, v) under counts ``n``, in column ``out``."""
    seen = F.sum(F.when(F.col(n) > 0, 1).otherwise(0))
    one = counts.groupBy("w").agg(F.sum(n).alias("n1"))
    all_ = one.agg(F.sum("n1").alias("n0"), F.sum(F.when(F.col("n1") > 0, 1).otherwise(0)).alias("t0")).first()
    n0, t0 = all_["n0"] or 0, all_["t0"] or 0
    # an empty target set leaves the uniform model
    p1 = (F.col("n1") + t0 / 256.0) / (n0 + t0) if n0 else F.lit(1 / 256.0)
    one = one.select("w", p1.alias("p1"))
    two = counts.groupBy("v", "w").agg(F.sum(n).alias("n2"))
    last = two.groupBy("v").agg(F.sum("n2").alias("c2"), F.sum(F.when(F.col("n2") > 0, 1).otherwise(0)).alias("t2"))
    two = two.join(last, "v").join(one, "w")
    p2 = F.when(F.col("c2") > 0, (F.col("n2") + F.col("t2") * F.col("p1")) / (F.col("c2") + F.col("t2"))).otherwise(F.col("p1"))
    two = two.select("v", "w", p2.alias("p2"))
    both = counts.groupBy("u", "v").agg(F.sum(n).alias("c3"), seen.alias("t3"))
    three = counts.join(both, ["u", "v"]).join(two, ["v", "w"])
    p3 = F.when(F.col("c3") > 0, (F.col(n) + F.col("t3") * F.col("p2")) / (F.col("c3") + F.col("t3"))).otherwise(F.col("p2"))
    return three.withColumn(out, p3).drop("c3", "t3", "p2")


def _trigram_model(counts: DataFrame) -> str:
    """Path of the table (code, target, background: losses in nats) of the trigrams in ``counts`` (code, n, t)."""
    counts = counts.select("code", F.expr(f"cast(code / {SYMBOLS * SYMBOLS} as int)").alias("u"),
                           F.expr(f"cast(code / {SYMBOLS} as int) % {SYMBOLS}").alias("v"), F.expr(f"cast(code % {SYMBOLS} as int)").alias("w"),
                           "n", "t")
    counts = written(counts, "lm-counts")
    model = _smoothed(_smoothed(counts, "n", "pb"), "t", "pt")
    path = scratch_path(counts.sparkSession, "lm-model")
    model.select("code", (-F.ln("pt")).alias("target"), (-F.ln("pb")).alias("background")).coalesce(8).write.parquet(path)
    return path


def fit(docs: DataFrame, good: DataFrame):
    """``docs`` (_key, _text), ``good`` (_good) -> path of the trigrams' losses, path of the words' counts by scan partition,
    and (words, distinct words) of the target and of all documents."""
    keys = docs.select("_key", F.spark_partition_id().alias("part"))
    # hinted, so that the plan is the same at every size
    keys = keys.join(good.hint("merge"), F.col("_key") == F.col("_good"), "left_semi").distinct()
    target_path = by_partition(keys, "lm-targets")
    raw = written(docs.mapInArrow(_count(target_path), "kind int, part int, code long, n long, t long"), "lm-raw")

    trigrams = raw.filter(F.col("kind") == TRIGRAM).groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    model_path = _trigram_model(trigrams)

    places = raw.filter(F.col("kind") == WORD_KIND)
    words = written(places.groupBy("code").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "lm-words")
    size = words.agg(F.sum("t"), F.count(F.when(F.col("t") > 0, 1)), F.sum("n"), F.count(F.lit(1))).first()
    word_path = by_partition(places.select("code", "part").join(words.hint("merge"), "code"), "lm-words-by-part")
    return model_path, word_path, [(int(size[0] or 0), int(size[1])), (int(size[2] or 0), int(size[3]))]


class Words(Found):
    """Counts (target, all) of the words of a scan partition's rows."""

    def __init__(self, path: str):
        super().__init__(path)
        self.codes, self.counts, self.codes_of = np.zeros(0, np.int64), np.zeros((0, 2)), None

    def counts_of(self, part: int, words: np.ndarray) -> np.ndarray:
        if self.codes_of != part:
            t = self.of(part)
            if t is not None:
                self.codes, first = np.unique(t.column("code").to_numpy(), return_index=True)
                self.counts = np.stack([t.column("t").to_numpy()[first], t.column("n").to_numpy()[first]], 1).astype(np.float64)
            self.codes_of, self.table = part, None
        at = np.searchsorted(self.codes, words)
        if len(words) and (not len(self.codes) or at.max() == len(self.codes) or (self.codes[at] != words).any()):
            raise RuntimeError(f"partition {part} has words that it had not when they were counted: its rows changed between two scans")
        return self.counts[at]


def word_losses(counts: np.ndarray, spelled: np.ndarray, sizes) -> np.ndarray:
    """Losses (target, background) of words with these counts whose spelling loses ``spelled``."""
    out = np.empty_like(spelled)
    with np.errstate(divide="ignore"):
        for k, (tokens, kinds) in enumerate(sizes):
            if tokens:
                out[:, k] = np.log(tokens + kinds) - np.logaddexp(np.log(counts[:, k]), np.log(kinds) - spelled[:, k])
            else:
                out[:, k] = spelled[:, k]
    return out


def _scorer(model_path: str, word_path: str, sizes):
    def score(batches):
        fs, root = open_path(model_path)
        t = pads.dataset(root, filesystem=fs, format="parquet").to_table()
        code = t.column("code").to_numpy()
        slot = np.zeros(SYMBOLS * SYMBOLS * SYMBOLS, np.int32)
        slot[code] = np.arange(len(code))
        loss = np.stack([t.column("target").to_numpy(), t.column("background").to_numpy()], 1) if len(code) else np.zeros((1, 2))
        del t, code
        part, known = TaskContext.get().partitionId(), Words(word_path)
        for batch in batches:
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2))
            for row, codes, words, at in _pieces(batch):
                if len(words):
                    spelled = np.add.reduceat(loss[slot[codes]], at, axis=0)
                    n[row] += len(words)
                    sums[row] += word_losses(known.counts_of(part, words), spelled, sizes).sum(0)
            none = n == 0
            mean = sums / np.maximum(n, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(n), pa.array(mean[:, 0], mask=none), pa.array(mean[:, 1], mask=none),
                 pa.array(mean[:, 0] - mean[:, 1], mask=none)], ["_key", "n_tokens", "ce_target", "ce_background", "score"])

    return score


def score(df: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: key, n_tokens (words), ce_target, ce_background and score (nats per word).

    ``target_keys`` has the keys of the target documents in its first column. Both models see whole texts. Null and
    empty texts, and those of white space alone, have no tokens and null scores; repeated rows are counted and scored one
    by one; nulls and repeats among the target keys, and keys without a document, change nothing; an empty target leaves a
    uniform target model; an empty table gives an empty result; other columns are not read. ``df`` is scanned three times
    and must have the same rows in the same partitions each time, as a table has.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    good = target_keys.select(F.col(target_keys.columns[0]).alias("_good")).filter("_good IS NOT NULL").distinct()
    kind = docs.schema["_key"].dataType.simpleString()
    out = docs.mapInArrow(_scorer(*fit(docs, good)), f"_key {kind}, n_tokens long, ce_target double, ce_background double, score double")
    return out.withColumnRenamed("_key", key)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents against those labelled good and not toxic."""
    return score(documents, labels.filter("quality = 1 AND toxic = 0").select("doc_id"))
