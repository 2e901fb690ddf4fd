"""Removal of repeated 50-byte strings by content hashes of positions, grouped in place of prefix doubling.

A position's rank stands for the string that starts there; equal strings have equal ranks, here 64-bit hashes of
their content, so that ranks of one length are known without a sort. Positions are dropped as soon as they are
known to be unique, and the length doubles from 25 to 50 bytes, the threshold:

1. Runs. Texts are cut where the 25-byte rank has a fixed low part, on average every 128 bytes, so equal passages are
   cut alike. A run of starts [a, b) is ranked as one by the bytes [a, b + 49]. Runs whose rank also occurs in a
   document of smaller id are removed whole; only the first document's copy of a run goes on. This takes exact copies
   and the inside of long shared passages out of the grouping.
2. Rank 25. Of each 50-byte string that is left, the smallest of its 26 ranks of length 25 is its sample; equal
   strings have equal samples. Spark groups the samples (about one per 13 positions); strings whose sample lies in
   one document only are unique and leave. The same is repeated among the rest with the pair of the smallest and
   the largest rank.
3. Runs again. Neighbouring strings with equal pairs are ranked as one, and runs that also occur in a document of
   smaller id are removed. Of the others, those whose pair lies in one document only are unique by now and leave.
4. Rank 50. The strings that are left, at the edges of shared passages, are grouped by their rank of length 50; those
   that also occur in a document of smaller id are removed.

Sorting every position at every length, as plain prefix doubling does, would shuffle 16 bytes and more per byte of
text in each round; the steps above shuffle less than the text itself.

Texts are never shuffled: each step scans the documents again and looks up what the step before found for the rows
of its own scan partition in a table that is partitioned by that number. Row numbers come from the scan's splits,
which are the same in each step; the key travels along and is checked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import Found, by_partition, written

MIN_BYTES = 50
HALF = 25
RUN_MASK = 127
#: Bytes that are worked on at once, so that their ranks stay in the processor's cache; longer texts are taken in
#: overlapping pieces.
PIECE = 1 << 17
BATCH_BYTES = 4 << 20
SEED = 5


class Ranks:
    """Content ranks of the strings in a flat byte array, by a polynomial modulo 2^64."""

    _cache: dict = {}

    @classmethod
    def tables(cls, n: int):
        if cls._cache.get("n", -1) < n:
            rng = np.random.default_rng(SEED)
            letters = rng.integers(0, 2**64, 256, dtype=np.uint64)
            base = int(rng.integers(0, 2**63)) * 2 + 1
            size = max(n, PIECE + 2 * MIN_BYTES)

            def powers(x):
                steps = np.full(size + 1, x, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            with np.errstate(over="ignore"):
                cls._cache = {"n": size, "letters": letters, "pow": powers(base), "inv": powers(pow(base, -1, 2**64))}
        return cls._cache

    def __init__(self, flat: np.ndarray):
        t = self.tables(len(flat))
        self.inv = t["inv"]
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(t["letters"][flat] * t["pow"][: len(flat)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._mix((self.sums[ends] - self.sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return self._mix((self.sums[length:] - self.sums[:n]) * self.inv[:n] + np.uint64(length))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def samples(rank: np.ndarray) -> np.ndarray:
    """The smallest of HALF + 1 consecutive ranks, by doubling."""
    m, width = rank, 1
    while width * 2 <= HALF + 1:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    rest = HALF + 1 - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges one after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - ends + lengths, lengths)
    out += np.arange(len(out))
    return out


def _bytes_of(batch: pa.RecordBatch):
    text = batch.column("_text").fill_null("").cast(pa.large_binary())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + n + 1]
    data = text.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(batch: pa.RecordBatch):
    """Flat byte arrays of about PIECE bytes with, for each text or part of one in it: (row, offset in the text,
    start in the array, number of 50-byte strings)."""
    data, offsets = _bytes_of(batch)
    flat, meta, size = [], [], 0
    for row in range(batch.num_rows):
        a, b = int(offsets[row]), int(offsets[row + 1])
        for at in range(a, b - MIN_BYTES + 1, PIECE):
            end = min(at + PIECE + MIN_BYTES - 1, b)
            if size + end - at > PIECE and meta:
                yield np.concatenate(flat), meta
                flat, meta, size = [], [], 0
            flat.append(data[at:end])
            meta.append((row, at - a, size, end - at - MIN_BYTES + 1))
            size += end - at
    if meta:
        yield np.concatenate(flat), meta


def _runs(batches):
    for batch in batches:
        for flat, meta in pieces(batch):
            ranks = Ranks(flat)
            cut = ranks.all(HALF) & np.uint64(RUN_MASK) == 0
            row, base, start, n = (np.array(x, np.int64) for x in zip(*meta))
            valid = np.zeros(len(flat) + 1, np.int32)
            np.add.at(valid, start, 1)
            np.add.at(valid, start + n, -1)
            on = np.cumsum(valid)[:-1].astype(bool)
            mark = np.zeros(len(flat), bool)
            mark[: len(cut)] = cut
            mark[start] = True
            begin = np.flatnonzero(mark & on)
            piece = np.searchsorted(start, begin, side="right") - 1
            end = np.minimum(np.append(begin[1:], len(flat)), start[piece] + n[piece])
            rows = pa.array(row[piece])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(rows), batch.column("_rid").take(rows), pa.array(base[piece] + begin - start[piece]),
                 pa.array(end - begin), pa.array(ranks.at(begin, end + (MIN_BYTES - 1)).view(np.int64))],
                ["_key", "_rid", "pos", "len", "h"])


class Spans(Found):
    """Spans (rid, key, pos, len) by row."""

    def __init__(self, path: str):
        super().__init__(path)
        self.spans, self.spans_of = None, None

    def of_batch(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row in the batch, pos, len) of the spans of a batch of one scan partition, whose row numbers ascend."""
        rids = batch.column("_rid").to_numpy()
        part = int(rids[0]) >> 33
        if self.spans_of != part:
            t = self.of(part)
            self.spans, self.spans_of, self.table = None, part, None
            if t is not None and t.num_rows:
                t = t.combine_chunks()
                rid = t.column("_rid").to_numpy()
                order = np.argsort(rid, kind="stable")
                first = order[np.flatnonzero(np.diff(rid[order], prepend=-1))]
                self.spans = (rid[order], t.column("pos").to_numpy()[order], t.column("len").to_numpy()[order],
                              rid[first], t.column("_key").take(pa.array(first)))
        if self.spans is None:
            return (np.zeros(0, np.int64),) * 3
        rid, pos, length, own, key = self.spans
        a, b = np.searchsorted(own, rids[0]), np.searchsorted(own, rids[-1], side="right")
        rows = np.minimum(np.searchsorted(rids, own[a:b]), len(rids) - 1)
        if (rids[rows] != own[a:b]).any() or key.slice(a, b - a).to_pylist() != batch.column("_key").take(pa.array(rows)).to_pylist():
            raise RuntimeError("the documents changed between two scans")
        a, b = np.searchsorted(rid, rids[0]), np.searchsorted(rid, rids[-1], side="right")
        return np.searchsorted(rids, rid[a:b]), pos[a:b], length[a:b]


def _in_piece(meta, spans) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) in the array of pieces of what the batch's spans cover there."""
    row, pos, length = spans
    begins, ends = [], []
    # the rows of a piece's texts follow each other; only a long text has several pieces
    a, b = np.searchsorted(row, meta[0][0]), np.searchsorted(row, meta[-1][0], side="right")
    own, base, start, n = (np.array(x, np.int64) for x in zip(*meta))
    at = np.searchsorted(own, row[a:b])
    known = own[np.minimum(at, len(own) - 1)] == row[a:b]
    at, pos, length = at[known], pos[a:b][known], length[a:b][known]
    begins, ends = np.maximum(0, pos - base[at]), np.minimum(n[at], pos + length - base[at])
    some = begins < ends
    return (begins + start[at])[some], (ends + start[at])[some]


def _open_starts(meta, flat_len: int, spans) -> np.ndarray:
    """Which starts of the array no removed run covers."""
    out = np.zeros(flat_len, bool)
    for _, _, start, n in meta:
        out[start: start + n] = True
    for a, b in zip(*(x.tolist() for x in _in_piece(meta, spans))):
        out[a:b] = False
    return out


def _equal_runs(value: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest runs of equal values in which ``on`` holds throughout."""
    edge = np.empty(len(on), bool)
    edge[:1] = True
    np.not_equal(value[1:], value[:-1], out=edge[1:])
    edge[1:] |= on[1:] != on[:-1]
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(on))
    open_ = on[at]
    return at[open_], end[open_]


def _per_document(value: np.ndarray, doc: np.ndarray, part: int) -> pa.RecordBatch:
    """(h, part, n): each value and whether it occurs in one (1) or more (2) of these documents."""
    order = np.argsort(value)
    value, doc = value[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    n = 1 + (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), pa.array(np.full(len(at), part, np.int32)), pa.array(n)],
                                      ["h", "part", "n"])


def _docs_of(on: np.ndarray, meta) -> np.ndarray:
    return np.array([x[0] for x in meta])[np.searchsorted([x[2] for x in meta], on, side="right") - 1]


class Known(Found):
    """Values (h) that lie in more than one document, by scan partition."""

    #: Leading bits of a value that are looked up first.
    BITS = 21

    def __init__(self, path: str):
        super().__init__(path)
        self.values, self.values_of = np.zeros(0, np.uint64), None

    def hits(self, part: int, value: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - self.BITS)
        if self.values_of != part:
            t = self.of(part)
            self.values = np.zeros(0, np.uint64) if t is None else np.unique(t.column("h").to_numpy().view(np.uint64))
            self.values_of, self.table = part, None
            self.maybe = np.zeros(1 << self.BITS, bool)
            self.maybe[self.values >> shift] = True
        out = self.maybe[value >> shift]
        at = np.flatnonzero(out)
        if len(at):
            some = value[at]
            out[at] = self.values[np.minimum(np.searchsorted(self.values, some), len(self.values) - 1)] == some
        return out


def pairs_of(rank: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The pair of smallest and largest rank as one value, of the starts in some ascending ranges; ``low`` are the
    smallest ranks of all starts."""
    gap = np.flatnonzero(begin[1:] != end[:-1]) + 1
    begin, end = begin[np.append(0, gap)], end[np.append(gap, len(end)) - 1]  # neighbours as one
    size = end - begin
    high = samples(~rank[ranges(begin, size + HALF)])
    # between two ranges the windows lie across both and belong to none
    high = high[ranges(np.cumsum(size + HALF) - size - HALF, size)]
    with np.errstate(over="ignore"):
        return Ranks._mix(low[ranges(begin, size)] * np.uint64(0x9E3779B97F4A7C15) + high)


def _batches_of(seen, part: int):
    """One batch of (value, document) pairs gathered from the pieces of a batch."""
    if seen:
        value, doc = (np.concatenate(x) for x in zip(*seen))
        if len(value):
            yield _per_document(value, doc, part)


def _part_of(batch: pa.RecordBatch) -> int:
    return batch.column("_rid")[0].as_py() >> 33


def _sampler(runs: str):
    def emit(batches):
        removed = Spans(runs)
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, seen = removed.of_batch(batch), []
            for flat, meta in pieces(batch):
                m = samples(Ranks(flat).all(HALF))
                begin, _ = _equal_runs(m, _open_starts(meta, len(flat), spans)[: len(m)])
                seen.append((m[begin], _docs_of(begin, meta)))
            yield from _batches_of(seen, _part_of(batch))

    return emit


def _paired(flat, meta, spans, shared: Known, part: int):
    """(ranks, starts, their pairs) of the open starts of an array whose samples are shared."""
    ranks = Ranks(flat)
    rank = ranks.all(HALF)
    m = samples(rank)
    begin, end = _equal_runs(m, _open_starts(meta, len(flat), spans)[: len(m)])
    hit = shared.hits(part, m[begin])
    begin, end = begin[hit], end[hit]
    if not len(begin):
        return ranks, begin, np.zeros(0, np.uint64)
    return ranks, ranges(begin, end - begin), pairs_of(rank, m, begin, end)


def _pairer(runs: str, shared: str):
    def emit(batches):
        removed, known = Spans(runs), Known(shared)
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, part, seen = removed.of_batch(batch), _part_of(batch), []
            for flat, meta in pieces(batch):
                _, on, pair = _paired(flat, meta, spans, known, part)
                if len(on):
                    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (on[1:] != on[:-1] + 1))))
                    seen.append((pair[new], _docs_of(on[new], meta)))
            yield from _batches_of(seen, part)

    return emit


def _places(batch, meta, on, columns: dict) -> pa.RecordBatch:
    """Rows (_key, _rid, pos, ...) of the starts ``on`` of an array of pieces."""
    piece = np.searchsorted([x[2] for x in meta], on, side="right") - 1
    row, base, start, _ = (np.array(x, np.int64)[piece] for x in zip(*meta))
    return pa.RecordBatch.from_arrays(
        [batch.column("_key").take(pa.array(row)), batch.column("_rid").take(pa.array(row)), pa.array(base + on - start),
         *(pa.array(v.astype(np.int64) if v.dtype != np.uint64 else v.view(np.int64)) for v in columns.values())],
        ["_key", "_rid", "pos", *columns])


def _units(runs: str, shared: str, pairs: str):
    def emit(batches):
        removed, known, known_pairs = Spans(runs), Known(shared), Known(pairs)
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, part = removed.of_batch(batch), _part_of(batch)
            for flat, meta in pieces(batch):
                ranks, on, pair = _paired(flat, meta, spans, known, part)
                if not len(on):
                    continue
                # strings of different pieces are never neighbours, as a piece ends with bytes that start none
                begin = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (on[1:] != on[:-1] + 1))))
                size = np.diff(np.append(begin, len(on)))
                pair, begin = pair[begin], on[begin]
                hit = known_pairs.hits(part, pair)
                pair, begin, size = pair[hit], begin[hit], size[hit]
                if len(begin):
                    yield _places(batch, meta, begin, {"len": size, "pair": pair, "h": ranks.at(begin, begin + size + (MIN_BYTES - 1))})

    return emit


def _strings(wanted: str):
    def emit(batches):
        edges = Spans(wanted)
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = edges.of_batch(batch)
            if not len(spans[0]):
                continue
            for flat, meta in pieces(batch):
                begin, end = _in_piece(meta, spans)
                on = np.sort(ranges(begin, end - begin))
                if len(on):
                    yield _places(batch, meta, on, {"h": Ranks(flat).at(on, on + MIN_BYTES)})

    return emit


def _remover(paths: list[str], with_text: bool):
    def emit(batches):
        found = [Spans(p) for p in paths]
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _bytes_of(batch)
            data, offsets = data[offsets[0]: offsets[-1]], offsets - offsets[0]
            edge = np.zeros(len(data) + 1, np.int32)
            for spans in found:
                row, pos, length = spans.of_batch(batch)
                np.add.at(edge, offsets[row] + pos, 1)
                np.add.at(edge, offsets[row] + pos + length + (MIN_BYTES - 1), -1)
            gone = np.cumsum(edge, out=edge)[:-1] > 0
            # a removed run ends with its text
            turn = np.zeros(len(data) + 1, bool)
            turn[1:-1] = gone[1:] != gone[:-1]
            turn[offsets] = True
            at = np.flatnonzero(turn)
            begin, end = at[:-1], at[1:]
            some = gone[begin]
            begin, end = begin[some], end[some]
            doc = np.searchsorted(offsets, begin, side="right") - 1
            n_spans = np.bincount(doc, minlength=batch.num_rows)
            removed = np.bincount(doc, end - begin, minlength=batch.num_rows).astype(np.int64)
            n_bytes = np.diff(offsets)
            kept = data[~gone]
            edges = np.concatenate(([0], np.cumsum(n_bytes - removed)))
            bounds = edges.tolist()
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])]
            arrays = [batch.column("_key"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                      pa.array(sha, pa.string())]
            names = ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                pair = pa.StructArray.from_arrays([pa.array(begin - offsets[doc], pa.int64()), pa.array(end - offsets[doc], pa.int64())],
                                                  ["begin", "end"])
                of_doc = np.concatenate(([0], np.cumsum(n_spans))).astype(np.int32)
                arrays += [pa.array([kept[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                           pa.ListArray.from_arrays(pa.array(of_doc), pair)]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return emit


def _marked(df: DataFrame) -> DataFrame:
    """Rows (_key, _rid, h, ...) with ``later``: whether h also occurs with a smaller key. A null key is the largest."""
    least = df.groupBy("h").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND least IS NOT NULL")
    least = least.select(F.col("h").alias("lh"), "least")
    later = F.col("least").isNotNull() & (F.col("_key").isNull() | (F.col("_key") > F.col("least")))
    return df.join(least, F.col("h") == F.col("lh"), "left").withColumn("later", later).drop("lh", "least")


def _shared(seen: DataFrame) -> DataFrame:
    """(h, part) of the values in more than one document, for the partitions they lie in."""
    total = F.sum("n").over(Window.partitionBy("h"))
    return seen.select("h", "part", total.alias("total")).filter("total > 1").select("h", "part").distinct()


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """_key, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row; with ``with_text`` also
    kept (the remaining bytes, which may break a character) and spans.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller key, judged on the
    input. Null texts are empty; texts under 50 bytes keep all; rows with the same key do not shorten each other; a
    null key counts as larger than all others; other columns are not read. ``df`` must read files, as its scans are
    repeated.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_rid"))
    kind = docs.schema["_key"].dataType.simpleString()
    part = F.shiftright("_rid", 33).cast("int").alias("part")

    place = f"_key {kind}, _rid long, pos long"
    spans = ["_key", "_rid", "pos", "len", part]

    runs = written(docs.mapInArrow(_runs, f"{place}, len long, h long"), "repeat-runs")
    run_path = by_partition(_marked(runs).filter("later").select(*spans), "repeat-run-spans")

    sample_path = by_partition(_shared(docs.mapInArrow(_sampler(run_path), "h long, part int, n long")), "repeat-samples")
    pair_path = by_partition(_shared(docs.mapInArrow(_pairer(run_path, sample_path), "h long, part int, n long")), "repeat-pairs")

    units = docs.mapInArrow(_units(run_path, sample_path, pair_path), f"{place}, len long, pair long, h long")
    units = written(_marked(written(units, "repeat-units")), "repeat-units")
    unit_path = by_partition(units.filter("later").select(*spans), "repeat-unit-spans")

    rest = units.filter("NOT later")
    open_ = rest.groupBy("pair").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.max(F.col("_key").isNull()).alias("nulls"))
    open_ = open_.filter("lo < hi OR (lo IS NOT NULL AND nulls)").select("pair")
    edge_path = by_partition(rest.join(open_, "pair", "left_semi").select(*spans), "repeat-edges")

    strings = written(docs.mapInArrow(_strings(edge_path), f"{place}, h long"), "repeat-strings")
    found = _marked(strings).filter("later").select("_key", "_rid", "pos", F.lit(1).cast("long").alias("len"), part)
    string_path = by_partition(found, "repeat-string-spans")

    schema = f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        schema += ", kept binary, spans array<struct<begin:long,end:long>>"
    return docs.mapInArrow(_remover([run_path, unit_path, string_path], with_text), schema)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return remove_repeats(df, with_text=False).withColumnRenamed("_key", "doc_id")
