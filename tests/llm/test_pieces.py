import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from presswork.llm import pieces, registry
from presswork.llm.common import table

from .conftest import same_rows

PATH = pieces.default_model()
PARTS = ["a", "the", " ", "  ", "\n", "▁", "é", "😀", "\x00", "　", "中", "<s>", "</s>", "<unk>", "<0x41>", "\t", "\r", "ﬁ", "Å", "xxxxx", "‍",
         "﻿", "à", "ab", "abc", "abd", "´", "½", "Å", "b", "c", " ﬁ"]
#: Keys of a small character map: longer keys over shorter ones, white space, several characters, nothing.
MAP = [("ﬁ", "fi"), ("Å", "A"), ("　", " "), ("\t", " "), ("´", " ́"), ("ab", "Z"), ("abc", "Y"), ("½", "1 2"), ("‍", ""), ("Å", "A")]


def text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 9)))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_map(dummy, squeeze):
    """The model with a character map and white space rules of our own: a later field of a message overrides."""
    trie, values = {}, b""
    for key, value in MAP:
        node = trie
        for c in key.encode():
            node = node.setdefault(c, {})
        node[None] = len(values)
        values += value.encode() + b"\0"
    units, blocks = {}, [1]

    def place(node, at):
        base = 256 * blocks[0]
        blocks[0] += 1
        units[at] = units.get(at, 0) | (base ^ at) << 10 | (256 if None in node else 0)
        for c, child in node.items():
            if c is None:
                units[base] = 1 << 31 | child
            else:
                units[base ^ c] = c
                place(child, base ^ c)

    place(trie, 0)
    array = np.full(256 * blocks[0], 0x80000001, "<u4")
    for at, unit in units.items():
        array[at] = unit
    blob = (4 * len(array)).to_bytes(4, "little") + array.tobytes() + values
    spec = b"\x12" + varint(len(blob)) + blob + b"\x18" + bytes([dummy]) + b"\x20" + bytes([squeeze])
    with open(PATH, "rb") as f:
        return f.read() + b"\x1a" + varint(len(spec)) + spec


@pytest.mark.parametrize("rules", [None, (1, 1), (1, 0), (0, 1), (0, 0)])
def test_ids_texts_and_places_as_the_library_has_them(rules):
    with open(PATH, "rb") as f:
        blob = with_map(*rules) if rules else f.read()
    library, model, rng = sentencepiece.SentencePieceProcessor(model_proto=blob), pieces.PieceModel(blob), random.Random(1)
    for _ in range(2500):
        t = text(rng)
        norm, align = model.normalise(t)
        ids = np.frombuffer(model.ids_of([norm])[0], "<u4")
        assert ids.tolist() == library.encode(t), t
        assert model.decode(np.array([1, *ids, 2])) == library.decode([1, *ids.tolist(), 2]), t
        begins, ends = model.spans(norm, ids, align)
        want = [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
        got = list(zip(begins.tolist(), ends.tolist()))
        # the library hands all bytes of one character to the last of its byte pieces
        whole = [k for k, i in enumerate(ids.tolist()) if not library.is_byte(i)]
        assert [got[k] for k in whole] == [want[k] for k in whole], t
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:])), t


def test_decoding_of_any_ids():
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceModel(PATH), random.Random(2)
    some = [0, 1, 2, 100, 259, 278, 29871, 29871, *(3 + b for b in (0x41, 0xE2, 0x96, 0x81, 0xF0, 0x9F, 0x98, 0x80))]
    for _ in range(3000):
        ids = [rng.choice(some) for _ in range(rng.randrange(0, 8))]
        assert model.decode(np.array(ids, int)) == library.decode(ids), ids


def expected(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        out.append(dict(doc_id=i, n_tokens=len(ids), ids_sha256=hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                        decoded_sha256=hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return out


def test_edge_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = pieces.digest(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"]
    same_rows(got.drop("n_covered"), expected(rows))
    assert pieces.digest(no_docs).collect() == [] and pieces.encode(no_docs).collect() == []


def test_the_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = registry.op13_pieces(spark, sf)
    same_rows(got.drop("n_covered"), expected(rows))
    size = {i: len((t or "").encode()) for i, t in rows}
    assert all(r.n_covered == size[r.doc_id] for r in got.collect())


def test_spans_cover_the_source(docs):
    for r, t in zip(*(sorted(x.collect(), key=lambda r: (str(r[0]), str(r[1]))) for x in (pieces.encode(docs).select("doc_id", "decoded", "ids", "begins", "ends"),
                                                                                       docs.selectExpr("doc_id", "coalesce(text, '') AS text")))):
        raw = t.text.encode()
        assert r.decoded == t.text and len(r.ids) == len(r.begins) == len(r.ends)
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
        assert (r.ids[0], r.ids[-1]) == (1, 2)


def test_table_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_SEGMENTS", 10)
    model, library = pieces.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for k in range(20):
        t = " ".join(f"word{k}x{j}" for j in range(15))
        assert np.frombuffer(model.ids_of([model.normalise(t)[0]])[0], "<u4").tolist() == library.encode(t)
        assert len(model.known) <= 25
