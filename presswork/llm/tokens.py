"""Token ids of documents in binary files, range coded.

Writing: documents are range-partitioned and sorted by key; every task encodes its documents with the tokenizer, ends
each with an end id and writes one file: segments of range-coded blocks (see ``mixcoder``), then a table of the
documents (key and number of ids, as an Arrow file), then the table's length. Files have names of their own attempt;
the list of files is the result, so what a lost task wrote is never read.

Reading: files are decoded a segment at a time, block checksums are verified, and every document's ids are handed out
with the document's place in the whole sequence.

Tokenizing a corpus by the tokenizer's own loop spends most of its time on words it has met before. For byte-level
tokenizers that split at spaces, texts are therefore cut before every space that a visible character follows, where no
token can cross, and the distinct pieces of some megabytes of text are looked up in bounded tables, which a Python
worker keeps from task to task. Words with end marks (letters, then ``.,;:!?``) and words on both sides of a line's end
are put together from their parts, which the tokenizer never joins. Words of letters that are new go to the tokenizer's
model as the one pre-token they are, other new pieces through the whole tokenizer. Cutting, looking up and putting
together work on Arrow and numpy arrays. Texts with other white space after a space, or with the mark of a special
token, go through the tokenizer whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.common import open_path, written
from presswork.llm.mixcoder import BLOCK, LANES, decoded, read_segment, segments
from presswork.session import scratch_path

MAGIC = b"TKF2"
TAIL = "<QQ4s"  # ids, bytes of the document table, magic
END_ID = 0
#: Ids that a task holds before it codes a segment.
SEGMENT_IDS = BLOCK * LANES
#: Pieces of text whose ids a worker keeps, about, in each of two tables.
KNOWN_PIECES = 200_000
#: Text that is cut and looked up at once.
GROUP_BYTES = 4 << 20
BATCH_BYTES = 1 << 20
#: Characters of texts that the tokenizer is handed at once, or one longer text; what it returns takes far more memory than the ids.
WHOLE_CHARS = 256 << 10
#: Parts whose elements are gathered at once.
GATHERED = 1 << 15
#: Marks that a byte-level tokenizer's pattern separates from the letters before them.
END_MARKS = ".,;:!?"
#: Text of documents in one file, about.
FILE_BYTES = 32 << 20


def gather(store: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The parts [start, start + length) of an array one after the other."""
    out, done = np.empty(int(lengths.sum()), store.dtype), 0
    for i in range(0, len(starts), GATHERED):
        n = lengths[i: i + GATHERED]
        ends = np.cumsum(n)
        index = np.repeat(starts[i: i + GATHERED] - ends + n, n)
        index += np.arange(len(index))
        np.take(store, index, out=out[done: done + len(index)], mode="clip")
        done += len(index)
    return out


def _tails(array: pa.Array, skip: np.ndarray) -> pa.Array:
    """What follows the first ``skip`` bytes of every string."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset: array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets) - skip
    edges = np.concatenate(([0], np.cumsum(lengths)))
    return pa.LargeStringArray.from_buffers(len(array), pa.py_buffer(edges), pa.py_buffer(gather(data, offsets[:-1] + skip, lengths)))


class Known:
    """The ids of strings met lately; ``learn`` gives (ids, number of ids of each) of new ones.

    Strings stand in the younger of two tables from where they are met. A full younger table takes the place of the
    older one, whose strings are forgotten if they were not met meanwhile."""

    def __init__(self, learn):
        self.learn = learn
        self._empty()
        self.older = self.words, self.ids, self.edges

    def _empty(self) -> None:
        self.words, self.ids, self.edges = pa.array([], pa.large_string()), np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def turn(self) -> None:
        """Make room if the younger table is full; what ``find`` gave before no longer holds."""
        if len(self.words) >= KNOWN_PIECES:
            self.older = self.words, self.ids, self.edges
            self._empty()

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) of the ids of every word in ``ids``."""
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(distinct, value_set=self.words)
        where = place.fill_null(-1).to_numpy().astype(np.int64)
        missing = distinct.filter(place.is_null())
        if len(missing):
            there, ids, edges = self.older
            place = pc.index_in(missing, value_set=there)
            met, new = place.drop_null().to_numpy(), missing.filter(place.is_null())
            sizes = edges[met + 1] - edges[met]
            learned, lengths = self.learn(new) if len(new) else (self.ids[:0], sizes[:0])
            is_new = place.is_null().to_numpy(zero_copy_only=False)
            where[where < 0] = len(self.words) + np.where(is_new, len(met) + np.cumsum(is_new) - 1, np.cumsum(~is_new) - 1)
            self.words = pa.concat_arrays([self.words, missing.filter(place.is_valid()), new])
            self.ids = np.concatenate((self.ids, gather(ids, edges[met], sizes), learned))
            self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(np.concatenate((sizes, lengths)))))
        where = where[at]
        return self.edges[where], self.edges[where + 1] - self.edges[where]


class PieceEncoder:
    """Ids (16-bit) of texts by a tokenizer of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        kind = str(self.tokenizer.pre_tokenizer)
        self.by_piece = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind \
            and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced, self.bare = Known(self._learn_spaced), Known(self._learn_bare)
        if self.by_piece:
            n = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.starts = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            # every byte of UTF-8: characters below U+0800 and the first of each longer lead and next byte
            chars = map(chr, [*range(0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x10000, 64), *range(0x10000, 0x110000, 4096)])
            self.letters = {b: letter for c in chars for b, letter in zip(c.encode(), spell(c)[0][0])}

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, at = [], 0
        while at < len(texts):
            start, size = at, 0
            while at < len(texts) and (at == start or size + len(texts[at]) <= WHOLE_CHARS):
                size += len(texts[at])
                at += 1
            ids += [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch(texts[start:at], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint16), *ids]), np.array([len(x) for x in ids], np.int64)

    def _learn_bare(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and marks that no space comes before."""
        return self._whole(words.to_pylist())

    def _learn_spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces after a space."""
        letters = pc.utf8_is_alpha(pieces).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(pieces), np.int64)
        words, n_words = self._words(pieces.filter(pa.array(letters)).to_numpy(zero_copy_only=False))
        rest, n_rest = self._pieces(pieces.filter(pa.array(~letters)).to_pylist())
        lengths[letters], lengths[~letters] = n_words, n_rest
        starts = np.zeros(len(pieces), np.int64)
        starts[letters], starts[~letters] = np.cumsum(n_words) - n_words, len(words) + np.cumsum(n_rest) - n_rest
        return gather(np.concatenate((words, rest)), starts, lengths), lengths

    def _words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters after a space are one pre-token, so that the tokenizer's model takes them as they are."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids, lengths = array("H"), array("q")
        for word in words:
            if not word.isascii():  # the bytes in the letters of the model
                word = word.encode().decode("latin-1").translate(letters)
            tokens = tokenize("Ġ" + word)
            ids.extend([t.id for t in tokens])
            lengths.append(len(tokens))
        return np.frombuffer(ids, np.uint16), np.frombuffer(lengths, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, lengths = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        # a space that nothing follows is a token of its own only at the end of a text
        ends = [i for i, piece in enumerate(pieces) if not piece]
        others = [piece for piece in pieces if piece]
        for at in range(0, len(others), 5000):
            part = others[at: at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint16)
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) != len(part):
                raise ValueError("the tokenizer does not split at spaces")
            out.append(ids)
            lengths.append(np.diff(np.append(begins, len(ids))))
        out, lengths = np.concatenate(out), np.concatenate(lengths)
        for i in ends:  # one at most, as pieces are distinct
            space = self._whole([" "])[0]
            out = np.insert(out, int(lengths[:i].sum()), space)
            lengths = np.insert(lengths, i, len(space))
        return out, lengths

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of distinct pieces after a space."""
        n = len(pieces)
        broken = pc.match_substring(pieces, "\n").to_numpy(zero_copy_only=False)
        both = pc.split_pattern(pieces.filter(pa.array(broken)), "\n", max_splits=1).flatten()
        second = both.take(pa.array(np.arange(1, len(both), 2)))
        lines = np.flatnonzero(broken)
        order = np.arange(n)
        order[lines] = n + np.arange(0, len(both), 2)
        first = pa.concat_arrays([pieces, both]).take(pa.array(order))  # the piece up to the line's end
        one, two = pc.utf8_rtrim(first, END_MARKS), pc.utf8_rtrim(second, END_MARKS)
        letters = pc.utf8_is_alpha(one).to_numpy(zero_copy_only=False)
        joined = letters[lines] & pc.utf8_is_alpha(two).to_numpy(zero_copy_only=False)
        lines, second, two = lines[joined], second.filter(pa.array(joined)), two.filter(pa.array(joined))
        apart = letters & ~broken
        apart[lines] = True
        marks = np.flatnonzero(apart)
        head, tail = first.take(pa.array(marks)), one.take(pa.array(marks))
        mark = _tails(head, pc.binary_length(tail).to_numpy())
        mark_two = _tails(second, pc.binary_length(two).to_numpy())

        spaced = pc.if_else(pa.array(apart), one, pieces)
        starts, lengths = np.zeros((n, 5), np.int64), np.zeros((n, 5), np.int64)
        starts[:, 0], lengths[:, 0] = self.spaced.find(spaced)
        bare = pa.concat_arrays([mark, pa.array(["\n"] * len(lines), pa.large_string()), two, mark_two])
        at, size = self.bare.find(bare)
        at = at + len(self.spaced.ids)
        edge = len(marks)
        starts[marks, 1], lengths[marks, 1] = at[:edge], size[:edge]
        for column in (2, 3, 4):
            own = slice(edge, edge + len(lines))
            starts[lines, column], lengths[lines, column] = at[own], size[own]
            edge += len(lines)
        ids = gather(np.concatenate((self.spaced.ids, self.bare.ids)), starts.ravel(), lengths.ravel())
        return ids, lengths.sum(axis=1)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = texts.cast(pa.large_string())
        if not self.by_piece or not len(texts):
            return self._whole(texts.to_pylist())
        # white space in the sense of any Unicode version after a space, or the mark of an added token
        odd = pc.match_substring_regex(texts, r" [\s\x0b\x1c-\x1f\x{85}\x{180e}\p{Z}]")
        for mark in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        self.spaced.turn()
        self.bare.turn()
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        parts, edges = cut.flatten(), cut.offsets.to_numpy()
        del cut
        first = edges[:-1] - edges[0]
        piece = np.ones(len(parts), bool)
        piece[first] = False
        heads, n_heads = self._whole(pc.if_else(odd, texts, parts.take(pa.array(first))).to_pylist())
        coded = parts.filter(pa.array(piece)).dictionary_encode()
        del parts
        ids, n_ids = self._of_pieces(coded.dictionary)
        at = coded.indices.to_numpy()
        starts, lengths = np.empty(len(piece), np.int64), np.empty(len(piece), np.int64)
        starts[first], lengths[first] = np.cumsum(n_heads) - n_heads, n_heads
        starts[piece], lengths[piece] = (len(heads) + np.cumsum(n_ids) - n_ids)[at], n_ids[at]
        return gather(np.concatenate((heads, ids)), starts, lengths), np.add.reduceat(lengths, first)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian) of every text."""
        ids, lengths = self.encode_array(pa.array(texts, pa.large_string()))
        return [x.astype("<u2").tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])] if len(texts) else []


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker, kept beside the library's module from task to task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_piece_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def _groups_of(batches):
    """(keys, texts) of some megabytes, or one longer batch, at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        text = batch.column("_text").fill_null("").cast(pa.large_string())
        # a copy: the column of a batch that came from Spark keeps all of the batch, its texts included, in memory
        keys.append(batch.column("_key").take(pa.array(np.arange(len(batch)))))
        texts.append(text)
        size += text.nbytes
        if size >= GROUP_BYTES:
            yield keys, pa.concat_arrays(texts)
            keys, texts, size = [], [], 0
    if keys:
        yield keys, pa.concat_arrays(texts)


def _file_writer(folder: str, tokenizer_path: str, end_id: int):
    def write(batches):
        encoder = worker_encoder(tokenizer_path)
        fs, root = open_path(folder)
        name = f"{root}/ids-{uuid.uuid4().hex}.tks"
        out, keys, lengths, held, n_held = None, [], [], np.empty(SEGMENT_IDS, np.uint16), 0
        for key, texts in _groups_of(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name, compression=None)
                out.write(MAGIC)
            keys += key
            ids, n = encoder.encode_array(texts)
            ids = np.insert(ids, np.cumsum(n), np.uint16(end_id))
            lengths.append(n + 1)
            while len(ids):
                part, ids = ids[: SEGMENT_IDS - n_held], ids[SEGMENT_IDS - n_held:]
                held[n_held: n_held + len(part)] = part
                n_held += len(part)
                if n_held == SEGMENT_IDS:
                    for coded in segments(held):
                        out.write(coded)
                    n_held = 0
        if out is None:
            return
        for coded in segments(held[:n_held]):
            out.write(coded)
        n_ids = np.concatenate(lengths)
        table = pa.table({"key": pa.chunked_array(keys), "n": pa.array(n_ids, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        raw = sink.getvalue().to_pybytes()
        total = int(n_ids.sum())
        out.write(raw)
        out.write(struct.pack(TAIL, total, len(raw), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [name.rpartition("/")[2]],
                                          "n_docs": pa.array([len(n_ids)], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return write


def read_file(f):
    """(keys, numbers of ids, iterator over id arrays) of an open token file."""
    size = f.size()
    f.seek(size - struct.calcsize(TAIL))
    _, n_table, magic = struct.unpack(TAIL, f.read(struct.calcsize(TAIL)))
    if magic != MAGIC:
        raise ValueError("not a token file")
    end = size - struct.calcsize(TAIL) - n_table
    f.seek(end)
    table = pa.ipc.open_file(pa.py_buffer(f.read(n_table))).read_all()

    def ids():
        f.seek(len(MAGIC))
        data = memoryview(f.read(end - len(MAGIC)))
        pos = 0
        while pos < len(data):
            pos, prior, blocks = read_segment(data, pos)
            yield from decoded(prior, blocks)

    return table.column("key"), table.column("n").to_pylist(), ids()


def _file_reader(folder: str, with_ids: bool):
    def read(batches):
        fs, root = open_path(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{path}") as f:
                    keys, lengths, arrays = read_file(f)
                    rows, rest, done, at = [], np.zeros(0, np.uint16), 0, base
                    for ids in chain(arrays, [None]):
                        if ids is not None:
                            rest = np.concatenate((rest, ids))
                        pos = 0
                        while done + len(rows) < len(lengths) and pos + lengths[done + len(rows)] <= len(rest):
                            n = lengths[done + len(rows)]
                            own = rest[pos: pos + n].astype("<u4")
                            rows.append((at, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
                            pos += n
                            at += n
                        rest = rest[pos:]
                        if rows:
                            a, n, c, x = zip(*rows)
                            cols = [keys.slice(done, len(rows)).combine_chunks(), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
                            names = ["_key", "start", "n_tokens", "ids_crc32"]
                            if with_ids:
                                cols.append(pa.array(x, pa.list_(pa.int32())))
                                names.append("ids")
                            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names)
                            done += len(rows)
                            rows = []
                    if done != len(lengths) or len(rest):
                        raise ValueError(f"{path}: the ids do not add up")

    return read


def write_tokens(df: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``df`` and return the table of files: part (their order), path, n_docs, n_ids and
    base (ids in the files before).

    Documents are in ascending order of their key, nulls first, and of a hash of the text where keys are equal.
    Null and empty texts consist of the end id; repeated rows are written as often as they occur; an empty table
    writes no file; other columns are not written.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_h"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    ordered = docs.repartitionByRange(parts, "_key", "_h").sortWithinPartitions("_key", "_h").select("_key", "_text")
    files = written(ordered.mapInArrow(_file_writer(folder, tokenizer_path, end_id), "part long, path string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, files: DataFrame, folder: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids of every document."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    table = written(files.select("path", "base"), "token-index")
    n = max(1, table.count())
    raw = table.repartition(n, "path")
    kind = _key_type(spark, folder, table)
    schema = f"_key {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return raw.mapInArrow(_file_reader(folder, with_ids), schema).withColumnRenamed("_key", key)


def _key_type(spark: SparkSession, folder: str, table: DataFrame) -> str:
    """The key's type, from the first file's document table."""
    from pyspark.sql.pandas.types import from_arrow_type

    first = table.orderBy("base").first()
    if first is None:
        return "long"
    fs, root = open_path(folder)
    with fs.open_input_file(f"{root}/{first['path']}") as f:
        return from_arrow_type(read_file(f)[0].type).simpleString()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(df: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the token files of all documents, read them back and return doc_id, start, n_tokens and ids_crc32."""
    spark = df.sparkSession
    folder = scratch_path(spark, "tokens")
    files = write_tokens(df, folder, tokenizer_path or default_tokenizer())
    return read_tokens(spark, files, folder, with_ids=False)
