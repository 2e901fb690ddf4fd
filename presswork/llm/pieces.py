"""Piece encoding and decoding with the places of the pieces in the text.

A model file of the ``sentencepiece`` library gives the pieces and the compiled character map. A text is normalised here:
at every place the longest key of the map that begins there is replaced, the white space rules of the model are applied,
and for every byte of the normalised text the byte of the source is kept that it came from. The normalised text is
segmented into pieces, and each piece's range is projected through that alignment to a range of source bytes.

Segmentation is the library's, by the same model with its normaliser switched off. Where no piece of the vocabulary
holds a space mark behind another character, segments cannot cross the place before a space mark, so that text is cut
there and each distinct segment goes to the library once while it is in a worker's bounded table.

Decoding joins the pieces' bytes; the space that the model's prefix rule put in front is taken off, and bytes of byte
pieces that are no UTF-8 become U+FFFD one by one.

In this module the space mark U+2581 is held as a space (one byte): the marks of a normalised text and its spaces are
the same thing.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

MARK = "▁"
#: Segments whose ids a worker keeps; the table starts anew when it is full.
KNOWN_SEGMENTS = 400_000
#: Characters of text that are encoded together.
GROUP_CHARS = 2 << 20
# Types of pieces in a model file (fixed values of the format).
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
_KEPT: dict = {}


def _fields(message: bytes):
    """(number, value) of the fields of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, message[at: at + size]
            at += size


class CharMap:
    """The compiled character map of a model: a double-array trie over UTF-8 keys, then the replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size:]
        root = self._offset(self.units[0]) if self.units else 0
        firsts = [c for c in range(256) if self.units and (root ^ c) < len(self.units) and self.units[root ^ c] & 0x800000FF == c]
        #: Finds the bytes with which a key may begin.
        self.begins = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in firsts) + b"]") if firsts else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 512 else 0)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that begins at ``at``."""
        units = self.units
        node, found = self._offset(units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        begin = found[0]
        return self.values[begin: self.values.index(b"\0", begin)], found[1]


class PieceModel:
    """Pieces, normaliser and segmentation of a model file."""

    def __init__(self, path_or_bytes: str | bytes):
        import sentencepiece

        blob = path_or_bytes
        if isinstance(blob, str):
            with open(blob, "rb") as f:
                blob = f.read()
        parts = list(_fields(blob))
        pieces = [dict(_fields(v)) for n, v in parts if n == 1]
        trainer = {k: v for n, v in parts if n == 2 for k, v in _fields(v)}
        norm = {k: v for n, v in parts if n == 3 for k, v in _fields(v)}
        self.types = np.array([p.get(3, 1) for p in pieces])
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        names = [p.get(1, b"").decode() for p in pieces]
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.map = CharMap(norm.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("models that keep spaces as they are have no space marks to cut at")
        #: Bytes of each piece; a space mark is a space.
        self.bytes = [bytes([int(n[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else n.replace(MARK, " ").encode()
                      for n, t in zip(names, self.types.tolist())]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.surface = [self.unknown_surface if t == UNKNOWN else b for b, t in zip(self.bytes, self.types.tolist())]
        own = sorted((n for n, t in zip(names, self.types.tolist()) if t == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(re.escape(n.encode()) for n in own)) if own else None
        self.by_segment = self.byte_fallback and not own and not any(MARK in n.lstrip(MARK) for n in names)
        #: Normalising puts a space in front and changes nothing else, and texts can be cut before spaces.
        self.plain = self.by_segment and self.map.begins is None and self.dummy and not self.squeeze and not self.suffix
        # the same model without its normaliser: a later field of the same number overrides
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=blob + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        self.known: dict[str, bytes] = {}

    # -- normalisation ------------------------------------------------------------------------------------------

    def _stretches(self, raw: bytes):
        """(bytes after mapping, first source byte, whether the map made them) from left to right."""
        done = 0
        events = [m.regs[0] + (True,) for m in self.own.finditer(raw)] if self.own else []
        if self.map.begins:
            events = sorted(events + [m.regs[0] + (False,) for m in self.map.begins.finditer(raw)], key=lambda e: (e[0], not e[2]))
        for begin, end, own in events:
            if begin < done:
                continue
            hit = (raw[begin:end], end - begin) if own else self.map.longest(raw, begin)
            if hit is None:
                continue
            if begin > done:
                yield raw[done:begin], done, False
            yield hit[0], begin, True
            done = begin + hit[1]
        if done < len(raw):
            yield raw[done:], done, False

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte it stands for."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, np.int64)
        if self.map.begins is None and self.own is None:
            norm, align, made = np.frombuffer(raw, np.uint8), np.arange(len(raw) + 1), None
            front = len(raw) - len(raw.lstrip(b" ")) if self.squeeze else 0
        else:
            parts = list(self._stretches(raw))
            front = 0 if not self.squeeze else next((p[1] + (0 if p[2] else len(p[0]) - len(p[0].lstrip(b" ")))
                                                     for p in parts if (p[0] != b" " if p[2] else p[0].strip(b" "))), 0)
            sizes = np.array([len(p[0]) for p in parts])
            norm = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
            align = np.repeat(np.array([p[1] for p in parts]), sizes)
            made = np.repeat(np.where([p[2] for p in parts], np.arange(len(parts)) + 1, 0), sizes)
            inside = np.arange(len(norm)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            align = np.append(np.where(made > 0, align, align + inside), len(raw))
        space = norm == 32
        if self.squeeze:
            before = np.concatenate(([True], space[:-1]))
            drop = space & before
            if made is not None:  # what a replacement holds inside stays
                drop[1:] &= (made[1:] == 0) | (made[1:] != made[:-1])
            if not self.suffix and len(norm) and self._mark_at(norm):
                space = space | self._mark_at(norm, as_mask=True)
            keep = ~drop
            norm, space, align = norm[keep], space[keep], np.append(align[:-1][keep], align[-1])
            end = len(norm)
            while end and norm[end - 1] == 32:
                end -= 1
            norm, align = norm[:end], align[: end + 1]
            if not end:
                return "", np.zeros(1, np.int64)
        out = norm.tobytes()
        if MARK.encode() in out:  # marks in the source are spaces from here on
            first = self._mark_at(norm, as_mask=True)
            rest = np.zeros(len(norm), bool)
            rest[1:] |= first[:-1]
            rest[2:] |= first[:-2]
            out, align = out.replace(MARK.encode(), b" "), np.append(align[:-1][~rest], align[-1])
            if self.squeeze:
                out = out.rstrip(b" ")
                align = align[: len(out) + 1]
                if not out:
                    return "", np.zeros(1, np.int64)
        if self.dummy:
            out = out + b" " if self.suffix else b" " + out
            align = np.append(align, align[-1]) if self.suffix else np.concatenate(([front], align))
        return out.decode(), align

    @staticmethod
    def _mark_at(norm: np.ndarray, as_mask: bool = False):
        """Where a space mark's three bytes begin."""
        mask = np.zeros(len(norm), bool)
        if len(norm) > 2:
            mask[:-2] = (norm[:-2] == 0xE2) & (norm[1:-1] == 0x96) & (norm[2:] == 0x81)
        return mask if as_mask else bool(mask.any())

    # -- segmentation -------------------------------------------------------------------------------------------

    _SEGMENT = re.compile(" *[^ ]+| +")

    def ids_of(self, normalised: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of normalised texts."""
        if not self.by_segment:
            return self.ids_once(normalised)
        cut = [self._SEGMENT.findall(t) for t in normalised]
        if len(self.known) > KNOWN_SEGMENTS:
            self.known = {}
        new = list({s for c in cut for s in c}.difference(self.known))
        if new:
            self.known.update(zip(new, self.ids_once(new)))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def ids_once(self, normalised: list[str]) -> list[bytes]:
        """The same straight from the library."""
        ids = self.raw.encode([t.replace(" ", MARK) for t in normalised], num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(map(len, ids))).tobytes()
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def spans(self, normalised: str, ids: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First source byte of each piece and the byte after its last."""
        if self.byte_fallback:
            ends = np.cumsum(self.lengths[ids])
        else:  # an unknown piece is as long as its surface
            pieces = self.raw.encode(normalised.replace(" ", MARK), out_type=str)
            ends = np.cumsum([len(p.replace(MARK, " ").encode()) for p in pieces], dtype=np.int64)
        if len(ends) and ends[-1] != len(align) - 1:
            raise ValueError("the pieces do not add up to the normalised text")
        return align[np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))], align[ends]

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        ids = np.asarray(ids, np.int64)
        said = ids[self.types[ids] != CONTROL]
        raw = b"".join(map(self.surface.__getitem__, said.tolist()))
        lead = self._lead(said) if raw.startswith(b" ") and (self.dummy or self.squeeze) else 0
        inner = np.flatnonzero(self.types[ids] != CONTROL)
        if not len(inner) or inner[-1] - inner[0] + 1 == len(inner):  # no control id in between, which would part bytes
            try:
                return raw[lead:].decode()
            except UnicodeDecodeError:
                pass
        return self._patched(ids.tolist(), lead)

    def _lead(self, said: np.ndarray) -> int:
        """Spaces in front that the prefix rule has put there: one, or those of the first pieces if space is squeezed."""
        n = 0
        for i in said.tolist():
            if self.types[i] in (BYTE, UNKNOWN) or not self.bytes[i].startswith(b" "):
                break
            n += 1
            if not self.squeeze or self.bytes[i] != b" ":
                break
        return n

    def _patched(self, ids: list[int], lead: int) -> str:
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at: at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run += self.bytes[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)[lead:]


def worker_model(path: str) -> PieceModel:
    """The model of this Python worker, kept from task to task."""
    if path not in _KEPT:
        _KEPT[path] = PieceModel(path)
    return _KEPT[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def groups_of(texts: list[str], size: int = GROUP_CHARS):
    """Ranges (from, to) of texts with about ``size`` characters."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encoder(path: str, ends: bool, digest: bool):
    def encode(batches):
        model = worker_model(path)
        head, tail = (np.array([x], "<u4").tobytes() if ends else b"" for x in (model.bos, model.eos))
        for batch in batches:
            texts = batch.column("_text").fill_null("").to_pylist()
            for a, b in groups_of(texts):
                norm = [model.normalise(t) for t in texts[a:b]]
                rows = []
                for (text, align), own in zip(norm, model.ids_of([n for n, _ in norm])):
                    ids = np.frombuffer(own, "<u4")
                    first, after = model.spans(text, ids, align)
                    whole = head + own + tail
                    listed = np.frombuffer(whole, "<u4")
                    decoded = model.decode(listed)
                    if digest:
                        rows.append((len(listed), hashlib.sha256(whole).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
                                     int((after - first).sum())))
                    else:  # begin and end ids stand for no bytes
                        edge = [0] * bool(head), [len(texts[a + len(rows)].encode())] * bool(tail)
                        rows.append((listed.tolist(), edge[0] + first.tolist() + edge[1], edge[0] + after.tolist() + edge[1], decoded))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()] if digest else [pa.list_(pa.int32())] * 3 + [pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_covered"] if digest else ["ids", "begins", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(a, b - a), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["_key", *names])

    return encode


def _apply(df: DataFrame, path: str | None, key: str, text: str, ends: bool, digest: bool) -> DataFrame:
    ints = ArrayType(IntegerType())
    fields = [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType()), ("n_covered", LongType())] if digest \
        else [("ids", ints), ("begins", ints), ("ends", ints), ("decoded", StringType())]
    schema = StructType([StructField("_key", df.schema[key].dataType), *[StructField(n, t) for n, t in fields]])
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(_encoder(path or default_model(), ends, digest), schema).withColumnRenamed("_key", key)


def encode(df: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text", ends: bool = True) -> DataFrame:
    """key, ids, begins and ends (source bytes of each piece, the end exclusive) and the decoded text of every row.

    Null and empty texts have the begin and end ids alone (none without ``ends``) and decode to the empty text; texts of
    any length are encoded whole; repeated rows and keys give a row each; null keys stay null; an empty table gives no
    rows; other columns are not returned. Begin and end ids have empty ranges at the text's edges. No row depends on
    another, nothing is shuffled.
    """
    return _apply(df, model_path, key, text, ends, False)


def digest(df: DataFrame, model_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and n_covered (bytes that the pieces' ranges hold) of every row, by the
    same work as :func:`encode`; the same cases hold."""
    return _apply(df, model_path, key, text, True, True)
