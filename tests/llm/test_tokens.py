import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from presswork.llm import mixcoder, tokens
from presswork.llm.common import table

from .conftest import edge_docs

PATH = tokens.default_tokenizer()


def pack(ids, **options):
    return b"".join(mixcoder.segments(np.array(ids, np.uint16), **options))


def unpack(data):
    at, out = 0, [np.zeros(0, np.uint16)]
    while at < len(data):
        at, prior, blocks = mixcoder.read_segment(data, at)
        out.append(mixcoder.decode(prior, blocks))
    return np.concatenate(out)


@pytest.mark.parametrize("block,lanes", [(1000, 64), (7, 3), (1024, 8192)])
def test_coder_round_trip(block, lanes):
    rng = np.random.default_rng(2)
    cases = [[], [0], [65535], np.zeros(5000), np.tile([0, 65535, 1, 2], 700), rng.integers(0, 65536, 4000), np.minimum(rng.zipf(1.3, 9000), 50256),
             np.tile(rng.integers(0, 50000, 333), 20), np.arange(3000), np.repeat(np.arange(50), 40)]
    for ids in cases:
        ids = np.array(ids, np.uint16)
        assert np.array_equal(unpack(pack(ids, block=block, lanes=lanes)), ids)


def test_coder_uses_its_contexts():
    """Well below order-0 entropy where the order-1 or order-2 context tells the next id."""
    rng = np.random.default_rng(3)
    line = rng.integers(0, 50000, 60)
    ids = np.concatenate([line[rng.integers(0, 55):][:5] for _ in range(8000)])
    order0 = np.log2(60) * len(ids) / 8
    assert len(pack(ids)) < 0.75 * order0
    noise = rng.integers(0, 50000, 60_000)
    assert len(pack(noise)) < 1.5 * np.log2(50000) / 8 * len(noise)


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(4).integers(0, 1000, 5000).astype(np.uint16)
    _, prior, blocks = mixcoder.read_segment(pack(ids, block=512))
    assert np.array_equal(mixcoder.decode(prior, [blocks[7], blocks[2]]), np.concatenate((ids[3584:4096], ids[1024:1536])))
    bad = bytearray(blocks[1])
    bad[-5] ^= 1
    with pytest.raises(ValueError):
        mixcoder.decode(prior, [blocks[0], bytes(bad)])


def reference(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    out, at = [], 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_piece_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [r[1] or "" for r in edge_docs()] + [" ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "a b  c", "it's I'll 12 ab34", "<|endoftext|>", " <|endoftext|> x",
                                                 "tab\t tab", "\r\n x", "é" * 50, "no<|endoftext|>space here", "a" * 5000, "3.14 :-) ☃ x"]
    e = tokens.PieceEncoder(PATH)
    assert e.by_piece
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_letters_go_to_the_model_once(monkeypatch):
    """New words of letters, with end marks or across a line's end, are no text for the whole tokenizer, and nothing is learned twice."""
    from tokenizers import Tokenizer

    text = "Head qwor, zvex. Straße; ñandú\nLine qwor\nzvex, ΩmegaЖ! qwor zvex.\nŁódź end"
    e, pieces, words = tokens.PieceEncoder(PATH), [], []
    whole, model = e._pieces, e._words
    monkeypatch.setattr(e, "_pieces", lambda x: (pieces.extend(x), whole(x))[1])
    monkeypatch.setattr(e, "_words", lambda x: (words.extend(x), model(x))[1])
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(e.encode([text])[0], "<u2").tolist() == want
    assert pieces == []
    assert sorted(words) == sorted(["qwor", "zvex", "Straße", "ñandú", "ΩmegaЖ", "end"])


def test_documents_against_the_tokenizer(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.digest(docs.repartition(4)).collect())
    assert got == reference(rows)


def test_edge_cases(spark, docs, no_docs, tmp_path):
    from presswork.session import scratch_path

    folder = scratch_path(spark, "tokens-test")
    files = tokens.write_tokens(docs, folder, PATH)
    back = sorted(tokens.read_tokens(spark, files, folder).collect(), key=lambda r: r.start)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert [r.doc_id for r in back] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    at = 0
    for r in back:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 0
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens
    by = {r.doc_id: r for r in back}
    assert by[1].n_tokens == by[2].n_tokens == 1
    assert sum(f.n_docs for f in files.collect()) == len(rows)
    assert tokens.digest(no_docs).count() == 0


def test_coder_memory():
    """Coding and decoding a segment takes little memory beside its ids."""
    ids = np.random.default_rng(5).integers(0, 50000, mixcoder.BLOCK * 5000).astype(np.uint16)
    tracemalloc.start()
    data = pack(ids)
    coding = tracemalloc.get_traced_memory()[1] - 2 * len(data)
    tracemalloc.reset_peak()
    before, done = tracemalloc.get_traced_memory()[0], 0
    _, prior, blocks = mixcoder.read_segment(memoryview(data))
    for part in mixcoder.decoded(prior, blocks):
        assert np.array_equal(part, ids[done: done + len(part)])
        done += len(part)
    decoding = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert done == len(ids)
    assert coding < 60e6 and decoding < 60e6, (coding, decoding)


def test_keys_do_not_hold_texts(tmp_path):
    path = str(tmp_path / "batches")
    batch = pa.RecordBatch.from_pydict({"_key": pa.array([1, None, 3]), "_text": ["x" * 700_000] * 3})
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, batch.schema) as w:
        for _ in range(8):
            w.write_batch(batch)
    kept, before = [], pa.total_allocated_bytes()
    for keys, texts in tokens._groups_of(iter(pa.ipc.open_stream(pa.OSFile(path)))):
        assert texts.nbytes <= tokens.GROUP_BYTES + batch.nbytes + 64
        kept += keys
    del texts
    assert [k.to_pylist() for k in kept] == [[1, None, 3]] * 8
    assert pa.total_allocated_bytes() - before < 1e6


def test_known_strings_stay_while_they_are_met(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 50)
    learned = []

    def learn(words):
        learned.extend(words.to_pylist())
        sizes = np.array([len(w) for w in words.to_pylist()], np.int64)
        return np.array([ord(c) for w in words.to_pylist() for c in w], np.uint16), sizes

    known = tokens.Known(learn)
    for i in range(40):
        known.turn()
        words = ["often", *(f"w{i}-{j}" for j in range(20)), "", "often", f"w{i}-3"]
        starts, sizes = known.find(pa.array(words, pa.large_string()))
        assert ["".join(map(chr, known.ids[a: a + n])) for a, n in zip(starts, sizes)] == words
        assert len(known.words) < 50 + 22 and len(known.older[0]) < 50 + 22
    assert learned.count("often") == 1 and len(learned) == 40 * 20 + 2
