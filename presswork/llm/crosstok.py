"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A is byte-level (a ``tokenizers`` file), tokenizer B a piece model (a ``sentencepiece`` file); both cut the
bytes of a space and the text. Places where tokens of both end are cuts; between neighbouring cuts lies a group.

Cuts are found by divide and conquer: of an interval of bytes, the token ends of A near the middle are looked up among
those of B by bisection, the nearest common one first; it divides the interval, and both halves go on in the same way.
An interval in which no common end is found is a leaf, that is a group. All intervals of a batch of documents take each
step together (numpy), so that a step costs the same calls for one interval as for a million.

Links are the pairs of an A and a B token whose byte ranges overlap; they lie within a group. How many documents hold a
pair of ids linked is counted over the whole corpus: a task gathers the distinct pairs of its documents block by block
(``BLOCK_BYTES`` of text), Spark adds the blocks' counts per pair and joins the sums back to the blocks, and each block's
documents are then read with the sums of their own pairs. What a block holds is bounded by its text; no pair, id or
document is gathered anywhere else.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswork.llm import pieces
from presswork.llm.common import written

#: Text whose pairs are counted together in a task.
BLOCK_BYTES = 16 << 20
#: Text that is aligned together.
BATCH_CHARS = 1 << 20
#: Parts of texts and links of these that a worker keeps; the table starts anew when it is full.
KNOWN_PARTS = 400_000
KNOWN_PAIRS = 4_000_000
#: Longer runs of one kind of character go to the tokenizers library, whose time does not grow with their square.
LONG_RUN = re.compile(r"\w{4000}|[^\w\s]{4000}|\s{4000}")
_KEPT: dict = {}


class BytePairs:
    """Ids of texts by a byte-level tokenizer file, the strings of special tokens being plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in printable]
        self.byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"] for t in file.get("added_tokens", []) if t.get("special")}
        vocab = {k: v for k, v in file["model"]["vocab"].items() if k not in special}
        self.size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(self.byte_of.__getitem__, token))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.fast = self._fast(file, vocab)

    def _fast(self, file: dict, vocab: dict):
        """The same merges in tiktoken, if each merge makes the next id and texts are cut by the usual pattern."""
        import public_tokenizers
        import tiktoken

        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        pre = file.get("pre_tokenizer") or {}
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not file.get("normalizer")
        if not usual or made != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
            return None
        ranks = {self.bytes[i]: i for i in vocab.values()}
        return tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) >= 4000 and LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)


def worker_pairs(path: str) -> BytePairs:
    """The tokenizer of this Python worker, kept from task to task."""
    if path not in _KEPT:
        _KEPT[path] = BytePairs(path)
    return _KEPT[path]


def divide(a_ends: np.ndarray, b_ends: np.ndarray, a_edges: np.ndarray, b_edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last A token, last B token) of every group, in order.

    ``a_ends`` and ``b_ends``: ascending ends of all tokens of a batch of texts that follow each other. ``a_edges`` and
    ``b_edges``: numbers of tokens before each text and after the last; texts have tokens and end with a common end.
    """
    lo_a, hi_a, lo_b, hi_b = a_edges[:-1], a_edges[1:] - 1, b_edges[:-1], b_edges[1:] - 1  # last tokens included
    leaves_a, leaves_b = [], []
    while len(lo_a):
        single = (lo_a == hi_a) | (lo_b == hi_b)  # no end lies inside
        leaves_a.append(hi_a[single])
        leaves_b.append(hi_b[single])
        lo_a, hi_a, lo_b, hi_b = (x[~single] for x in (lo_a, hi_a, lo_b, hi_b))
        cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        left, middle, step = np.arange(len(lo_a)), (lo_a + hi_a - 1) // 2, 0
        while len(left):
            for at in (middle[left] - step, middle[left] + step)[: 1 + (step > 0)]:
                ok = (at >= lo_a[left]) & (at < hi_a[left]) & (cut_a[left] < 0)
                who, at = left[ok], at[ok]
                place = np.searchsorted(b_ends, a_ends[at])
                hit = b_ends[place] == a_ends[at]
                cut_a[who[hit]], cut_b[who[hit]] = at[hit], place[hit]
            step += 1
            more = (cut_a[left] < 0) & ((middle[left] - step >= lo_a[left]) | (middle[left] + step < hi_a[left]))
            left = left[more]
        none = cut_a < 0
        leaves_a.append(hi_a[none])
        leaves_b.append(hi_b[none])
        lo_a, hi_a, lo_b, hi_b, cut_a, cut_b = (x[~none] for x in (lo_a, hi_a, lo_b, hi_b, cut_a, cut_b))
        lo_a, hi_a, lo_b, hi_b = (np.concatenate(x) for x in ((lo_a, cut_a + 1), (cut_a, hi_a), (lo_b, cut_b + 1), (cut_b, hi_b)))
    last_a, last_b = np.concatenate(leaves_a), np.concatenate(leaves_b)
    return np.sort(last_a), np.sort(last_b)


def linked(a_ends: np.ndarray, b_ends: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, a_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last B token that each A token overlaps, from the groups' last tokens."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    first, last = np.repeat(last_b - size_b + 1, size_a), np.repeat(last_b, size_a)
    several = np.repeat((size_a > 1) & (size_b > 1), size_a)
    at = np.flatnonzero(several)  # in other groups every A token meets every B token
    first[at] = np.searchsorted(b_ends, a_ends[at] - a_lengths[at], "right")
    last[at] = np.searchsorted(b_ends, a_ends[at])
    return first, last


class Growing:
    """Rows of whole numbers that are appended to."""

    def __init__(self, *shape: int):
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[self.n: self.n + len(rows)] = rows
        self.n += len(rows)


def _sums_by(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of numbers."""
    before = np.concatenate(([0], np.cumsum(numbers)))
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


class Aligner:
    """Aligns texts. Before a space between a character that is none and a visible one, both tokenizers begin a new
    token (checked against their files), so that such a place is a cut without a search; texts are taken apart there,
    and the groups of a part are kept for its next occurrence in a table of bounded size. Under other tokenizers a
    text is one part."""

    #: Where both tokenizers begin a token. Texts without the second pattern have such a place before every space.
    CUT, ODD = re.compile(r"(?<=[^ ])(?= \S)"), re.compile(r"^\s| (?:\s|$)")

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = worker_pairs(a_path), pieces.worker_model(b_path)
        self.wide_a, self.wide_b = self.a.size, len(self.b.bytes)
        self.by_part = self.a.fast is not None and self.b.plain
        # decimal ids behind the mark that stands before them: ; opens a group, | its B side
        self.written = [b"%s%d" % (mark, i) for mark, n in ((b",", self.wide_a), (b";", self.wide_a), (b",", self.wide_b), (b"|", self.wide_b)) for i in range(n)]
        self.offsets = (0, self.wide_a, 2 * self.wide_a, 2 * self.wide_a + self.wide_b)
        self.forget()

    def forget(self) -> None:
        #: For every part (without its first space): its number; its groups as text; whether both tokenizers spell it, tokens of
        #: A and of B, groups, links and the place of its first link; the id pairs of the links.
        self.index: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.facts, self.pairs = Growing(6), Growing()

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.by_part:
            return [text]
        if self.ODD.search(text):
            return [p[1:] for p in self.CUT.split(" " + text)]
        return text.split(" ")

    def tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of all parts, one after the other, and the number of each part's tokens: none where these do not
        spell the part in both tokenizers."""
        if self.by_part:
            own_b = self.b.ids_once([" " + p for p in parts])
        else:
            own_b = self.b.ids_of([self.b.normalise(p)[0] for p in parts])
        raw = [(" " + p).encode() for p in parts]
        sizes = np.array([len(r) for r in raw], np.int64)
        b, n_b = np.frombuffer(b"".join(own_b), "<u4").astype(np.int64), np.array([len(x) // 4 for x in own_b], np.int64)
        a, n_a = self._ids_of_a(parts, sizes)
        spelled = _sums_by(self.a.lengths[a], n_a) == sizes  # a byte-level tokenizer's tokens are the text's own bytes
        spelled &= _sums_by(self.b.lengths[b], n_b) == sizes
        said = list(map(self.b.bytes.__getitem__, b.tolist()))
        if b"".join(said) != b"".join(raw):
            edges = np.cumsum([0, *n_b]).tolist()
            spelled &= [b"".join(said[lo:hi]) == r for lo, hi, r in zip(edges, edges[1:], raw)]
        a, b = a[np.repeat(spelled, n_a)], b[np.repeat(spelled, n_b)]
        return a, np.where(spelled, n_a, 0), b, np.where(spelled, n_b, 0)

    def _ids_of_a(self, parts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all parts and their number in each. Parts between which a token cannot go on are encoded together."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(parts), np.int64)
        at = 0
        while at < len(parts):
            end, held = at, 0
            while self.by_part and end < len(parts) and held < 64 << 10:
                part = parts[end]
                if not part or part[0].isspace() or " " in part:
                    break
                held += len(part)
                end += 1
            if end == at:
                end = at + 1
            got = self.a.ids(" " + " ".join(parts[at:end]))
            ids.append(got)
            if end == at + 1:
                counts[at] = len(got)
            else:
                ends = np.searchsorted(np.cumsum(self.a.lengths[got]), np.cumsum(sizes[at:end])) + 1
                counts[at:end] = np.diff(ends, prepend=0)
            at = end
        return np.concatenate(ids), counts

    def learn(self, parts: list[str]) -> None:
        """Align parts that are not in the table."""
        a, n_a, b, n_b = self.tokens(parts)
        facts = np.zeros((len(parts), 6), np.int64)
        facts[:, 0], facts[:, 5] = n_a > 0, self.pairs.n
        self.index.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts))))
        texts = [b""] * len(parts)
        some = np.flatnonzero(n_a)
        if len(some):
            sizes_a, sizes_b = n_a[some], n_b[some]
            a_edges, b_edges = (np.concatenate(([0], np.cumsum(x))) for x in (sizes_a, sizes_b))
            a_lengths = self.a.lengths[a]
            a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(self.b.lengths[b])
            last_a, last_b = divide(a_ends, b_ends, a_edges, b_edges)
            first, last = linked(a_ends, b_ends, last_a, last_b, a_lengths)

            # the groups as text: A tokens of a group, then its B tokens
            opens_a, opens_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            opens_a[np.concatenate(([0], last_a[:-1] + 1))] = 1
            opens_b[np.concatenate(([0], last_b[:-1] + 1))] = 1
            size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            order = np.empty(len(a) + len(b), np.int64)
            order[np.arange(len(a)) + np.repeat(last_b - size_b + 1, size_a)] = a + np.where(opens_a, self.offsets[1], self.offsets[0])
            order[np.arange(len(b)) + np.repeat(last_a + 1, size_b)] = b + np.where(opens_b, self.offsets[3], self.offsets[2])
            spelled_out = list(map(self.written.__getitem__, order.tolist()))
            edges = (a_edges + b_edges).tolist()
            for i, lo, hi in zip(some.tolist(), edges, edges[1:]):
                texts[i] = b"".join(spelled_out[lo:hi])

            n_links = last - first + 1
            of_a = np.repeat(np.arange(len(a)), n_links)
            of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n_links) - n_links, n_links) + first[of_a]
            part_of_a = np.repeat(np.arange(len(some)), sizes_a)
            links = np.bincount(part_of_a, n_links, len(some)).astype(np.int64)
            facts[some, 1], facts[some, 2] = sizes_a, sizes_b
            facts[some, 3], facts[some, 4] = np.bincount(part_of_a[last_a], minlength=len(some)), links
            facts[some, 5] += np.cumsum(links) - links
            self.pairs.add(a[of_a] * self.wide_b + b[of_b])
        self.texts += texts
        self.facts.add(facts)

    def align(self, texts: list[str]):
        """For every text (n_a, n_b, n_groups, n_links, groups_sha256), and its linked id pairs (text's number, pair,
        times) as three arrays, ascending."""
        cut = [self.parts(t) for t in texts]
        if len(self.index) > KNOWN_PARTS or self.pairs.n > KNOWN_PAIRS:
            self.forget()
        new = set(chain.from_iterable(cut)).difference(self.index)
        if new:
            self.learn(list(new))
        sizes = np.array([len(c) for c in cut], np.int64)
        part = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        who = np.repeat(np.arange(len(texts)), sizes)
        facts = self.facts.held[part]
        bad = np.bincount(who, facts[:, 0] == 0, len(texts)) > 0
        totals = np.stack([np.bincount(who, facts[:, k], len(texts)).astype(np.int64) for k in (1, 2, 3, 4)], 1)
        totals[bad] = 0
        numbers, edges = part.tolist(), np.concatenate(([0], np.cumsum(sizes))).tolist()
        said = self.texts.__getitem__
        digests = ["" if n == 0 or none else hashlib.sha256(b"".join(map(said, numbers[lo:hi]))[1:]).hexdigest()
                   for n, none, lo, hi in zip(sizes.tolist(), bad.tolist(), edges, edges[1:])]
        rows = [(*t, d) for t, d in zip(totals.tolist(), digests)]

        good = ~bad[who]
        who, first, n = who[good], facts[good, 5], facts[good, 4]
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        wide = self.wide_a * self.wide_b
        key, times = np.unique(np.repeat(who, n) * wide + self.pairs.held[at], return_counts=True)
        return rows, key // wide, key % wide, times


def worker_aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker, kept with its table from task to task."""
    if (a_path, b_path) not in _KEPT:
        _KEPT[a_path, b_path] = Aligner(a_path, b_path)
    return _KEPT[a_path, b_path]


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max([1, *(k + 1 for k in range(8) if planes[k].any())]) if len(numbers) else 0
    raw = planes[:used].tobytes()
    return len(raw).to_bytes(8, "little") + used.to_bytes(1, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpacked(blob: bytes) -> np.ndarray:
    size, used = int.from_bytes(blob[:8], "little"), blob[8]
    if not size:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob[9:], size, "zstd", asbytes=True), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<i8").reshape(-1)


DOC_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _scan(a_path: str, b_path: str, key_type):
    """Rows of documents, and a row with the distinct pairs of each block of them."""

    def flush(block, keys, rows, found):
        offsets = np.cumsum([0, *(len(r) for r in rows)])
        rows = [r for part in rows for r in part]
        who = np.concatenate([w + o for (w, _, _), o in zip(found, offsets)])
        pair, times = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        distinct, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
        edges = np.searchsorted(who, np.arange(len(rows) + 1))
        packed = []
        for i in range(len(rows)):  # ascending places, as differences
            own = place[edges[i]: edges[i + 1]]
            packed.append((_packed(np.diff(own, prepend=0)), _packed(times[edges[i]: edges[i + 1]])))
        names = ["_key", *[c.split()[0] for c in DOC_COLUMNS.split(", ")], "block", "pairs", "counts"]
        n = len(rows)
        for at in range(0, n, 2000):
            part = slice(at, at + 2000)
            cols = [keys.slice(at, 2000), *[pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows[part]))],
                    pa.array([block] * len(rows[part]), pa.int64()), pa.array([p for p, _ in packed[part]], pa.binary()), pa.array([c for _, c in packed[part]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
        none = [pa.nulls(1, keys.type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([block], pa.int64()), pa.array([_packed(np.diff(distinct, prepend=0))], pa.binary()), pa.array([_packed(docs)], pa.binary())], names)

    def scan(batches):
        aligner = worker_aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        keys, rows, found, held = [], [], [], 0
        for batch in batches:
            texts = batch.column("_text").fill_null("").to_pylist()
            for lo, hi in pieces.groups_of(texts, BATCH_CHARS):
                got, *pairs = aligner.align(texts[lo:hi])
                keys.append(batch.column("_key").slice(lo, hi - lo))
                rows.append(got)
                found.append(pairs)
                held += sum(map(len, texts[lo:hi]))
                if held >= BLOCK_BYTES:
                    yield from flush(block, pa.concat_arrays(keys), rows, found)
                    block, keys, rows, found, held = block + 1, [], [], [], 0
        if rows:
            yield from flush(block, pa.concat_arrays(keys), rows, found)

    return scan


def _pairs(batches):
    """Rows (block, pair, docs) of the blocks' pairs."""
    for batch in batches:
        for block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "counts"))):
            pair, docs = np.cumsum(_unpacked(pairs)), _unpacked(counts)
            for at in range(0, len(pair), 100_000):
                own = pair[at: at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), pa.array(docs[at: at + 100_000])], ["block", "pair", "docs"])


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents."""
    order = np.argsort(pairs.column("pair").to_numpy())
    total, best = pairs.column("total").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for place, times in zip(docs.column("pairs").to_pylist(), docs.column("counts").to_pylist()):
        at, n = np.cumsum(_unpacked(place)), _unpacked(times)
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * total[at]).sum()))
    out = docs.select(["_key", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def digest(df: DataFrame, a_path: str | None = None, b_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Null and empty texts, and texts whose tokens do not spell the space and the text in both tokenizers (one with the
    space mark U+2581 in it), have no tokens: zeros and an empty digest. Every row counts as a document of its own,
    repeated ones as well; keys may be null or repeated; very long texts are aligned whole; an empty table gives no
    rows; other columns are not returned. ``n_best`` counts the links whose pair's count is the highest of its A id in
    the corpus, ties included.
    """
    a_path, b_path = a_path or default_tokenizers()[0], b_path or default_tokenizers()[1]
    kind = df.schema[key].dataType.simpleString()
    wide_b = len(pieces.worker_model(b_path).bytes)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {kind}, {DOC_COLUMNS}, block long, pairs binary, counts binary"
    scanned = written(rows.mapInArrow(_scan(a_path, b_path, kind), schema), "aligned")
    docs, blocks = scanned.filter("n_a IS NOT NULL"), scanned.filter("n_a IS NULL").select("block", "pairs", "counts")
    held = written(blocks.mapInArrow(_pairs, "block long, pair long, docs long"), "block-pairs")
    a_id = F.expr(f"pair DIV {wide_b}L")
    totals = held.groupBy("pair").agg(F.sum("docs").alias("total")).withColumn("a", a_id)
    totals = written(totals, "pair-totals")
    best = totals.groupBy("a").agg(F.max("total").alias("most"))  # at most one row for each id of A
    marked = totals.join(F.broadcast(best), "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = held.select("block", "pair").join(marked, "pair").select("block", "pair", "total", "best")
    out_schema = StructType.fromDDL(f"_key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    sums = docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_sums, out_schema)
    return sums.withColumnRenamed("_key", key)


def groups(texts: list[str], a_path: str | None = None, b_path: str | None = None) -> list[list[tuple[list[int], list[int]]]]:
    """The groups (A ids, B ids) of texts, for looking at a few of them."""
    aligner = Aligner(a_path or default_tokenizers()[0], b_path or default_tokenizers()[1])
    out = []
    for text in texts:
        parts = aligner.parts(text)
        a, n_a, b, n_b = aligner.tokens(parts) if parts else (None, np.zeros(1), None, None)
        if not n_a.all():
            out.append([])
            continue
        edges = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
        last_a, last_b = divide(np.cumsum(aligner.a.lengths[a]), np.cumsum(aligner.b.lengths[b]), *edges)
        out.append([(x.tolist(), y.tolist()) for x, y in zip(np.split(a, last_a[:-1] + 1), np.split(b, last_b[:-1] + 1))])
    return out
