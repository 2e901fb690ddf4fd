import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from presswork.llm import suffixes

from .conftest import frame


def brute(rows):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        key, t = rows[i][0], (rows[i][1] or "").encode()
        for s in range(len(t) - 49):
            first.setdefault(t[s:s + 50], key)
    for key, text, *_ in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            least = first[t[s:s + 50]]
            if least is not None and (key is None or least < key):
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = [k for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((key, len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def check(df, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_edge_cases(docs, no_docs):
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert suffixes.digest(no_docs).count() == 0


@pytest.mark.parametrize("piece", [suffixes.PIECE, 300])
def test_random_texts(spark, tmp_path, monkeypatch, piece):
    """Shared passages at any offset, self-overlapping texts, few letters, passages of just under and over 50 bytes."""
    monkeypatch.setattr(suffixes, "PIECE", piece)
    rng = random.Random(8)
    passages = ["".join(rng.choice("ab c") for _ in range(n)) for n in (49, 50, 51, 60, 75, 130, 400, 1500)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(rng.choice([rng.choice(passages), rng.choice(passages)[3:90], "é" * rng.randrange(80),
                                     "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(200)))]))
        rows.append((rng.randrange(60), "".join(parts), "en", "a", 1))
    rows += [(200, "a" * 700, "en", "a", 1), (201, "a" * 60, "en", "a", 1), (150, rows[3][1], "en", "a", 1)]
    check(frame(spark, tmp_path, rows), [r[:2] for r in rows])


def test_kept_bytes_and_spans(spark, tmp_path):
    passage = "This very passage of more than fifty bytes stands in both texts."
    rows = [(1, "one " + passage + " end", "en", "a", 1), (2, "two " + passage + " fin", "en", "a", 1)]
    out = {r._key: r for r in suffixes.remove_repeats(frame(spark, tmp_path, rows)).collect()}
    assert bytes(out[1].kept).decode() == rows[0][1] and out[1].spans == []
    assert bytes(out[2].kept).decode() == "twofin"
    assert [(s.begin, s.end) for s in out[2].spans] == [(3, 5 + len(passage))]


def _batch(texts, first=0):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), pa.array(range(first, first + n), pa.int64())],
                                      ["_key", "_text", "_rid"])


def test_pairs_of_some_starts():
    """Pairs are worked out for the wanted starts only, and are those of a window of ranks each."""
    rng = np.random.default_rng(1)
    rank = rng.integers(0, 1 << 40, 500).astype(np.uint64)
    low = suffixes.samples(rank)
    begin, end = np.array([3, 10, 40, 400]), np.array([10, 12, 41, len(low)])
    want = []
    for i in np.concatenate([np.arange(a, b) for a, b in zip(begin, end)]):
        window = rank[i: i + suffixes.HALF + 1]
        assert low[i] == window.min()
        with np.errstate(over="ignore"):
            want.append(suffixes.Ranks._mix(window.min(keepdims=True) * np.uint64(0x9E3779B97F4A7C15) + ~window.max())[0])
    assert suffixes.pairs_of(rank, low, begin, end).tolist() == want


def test_a_long_document_is_one_document(tmp_path, monkeypatch):
    """What repeats only inside one long text, in several pieces of it, is not in more than one document."""
    monkeypatch.setattr(suffixes, "PIECE", 300)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    seen = pa.Table.from_batches(suffixes._sampler(str(tmp_path / "none"))([_batch([passage * 5, "x" + passage[::-1]])])).to_pydict()
    assert len(set(seen["h"])) == len(seen["h"])
    assert set(seen["n"]) == {1}


def test_spans_of_a_batch(tmp_path):
    """Spans come with the row of the batch they belong to; other keys mean other documents."""
    folder = tmp_path / "spans" / "part=0"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"_key": [3, 1, 3, 7], "_rid": [3, 1, 3, 7], "pos": [5, 0, 90, 2], "len": [1, 2, 3, 4]}), folder / "a.parquet")
    spans = suffixes.Spans(str(tmp_path / "spans"))
    got = spans.of_batch(_batch(["a" * 200] * 5))
    assert [x.tolist() for x in got] == [[1, 3, 3], [0, 5, 90], [2, 1, 3]]
    assert [x.tolist() for x in spans.of_batch(_batch(["a"] * 2, first=4))] == [[], [], []]
    with pytest.raises(RuntimeError):
        spans.of_batch(_batch(["a"] * 4, first=1))
