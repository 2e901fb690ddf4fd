import math
import re
from collections import Counter

import numpy as np
import pytest

from presswork.llm import lmscore
from presswork.llm.common import table


def words_of(raw):
    """(word, first place, end of the white space after it) of a text."""
    found = [(m.group(), m.start()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    return [(w, a, b) for (w, a), b in zip(found, [a for _, a in found[1:]] + [len(raw)])]


def model(texts):
    """p(w | u, v) of an interpolated Witten-Bell trigram model over bytes, and counts of the words."""
    three = Counter(t for x in texts for t in zip(*(([256, 256, *x])[k:] for k in range(3))))
    two, one, after2, kinds2, after3, kinds3 = (Counter() for _ in range(6))
    for (u, v, w), n in three.items():
        two[v, w] += n
        one[w] += n
        after3[u, v] += n
        kinds3[u, v] += 1
    for (v, _), n in two.items():
        after2[v] += n
        kinds2[v] += 1
    total = sum(one.values())

    def p(u, v, w):
        q = (one[w] + len(one) / 256) / (total + len(one)) if total else 1 / 256
        q = (two[v, w] + kinds2[v] * q) / (after2[v] + kinds2[v]) if after2[v] else q
        return (three[u, v, w] + kinds3[u, v] * q) / (after3[u, v] + kinds3[u, v]) if after3[u, v] else q

    return p, Counter(w for x in texts for w, _, _ in words_of(x))


def losses(fitted, raw):
    p, counts = fitted
    x = [256, 256, *raw]
    tokens, kinds = sum(counts.values()), len(counts)
    out = []
    for w, a, b in words_of(raw):
        spelled = math.fsum(-math.log(p(*x[i:i + 3])) for i in range(a, b))
        if not tokens:
            out.append(spelled)
        elif counts[w]:
            out.append(-math.log((counts[w] + kinds * math.exp(-spelled)) / (tokens + kinds)))
        else:
            out.append(spelled - math.log(kinds / (tokens + kinds)))
    return float(np.mean(out))


@pytest.mark.parametrize("target", [[8, 12, 18, None, 12, 999], []])
def test_brute_force_on_edge_cases(spark, docs, target):
    keys = spark.createDataFrame([(k,) for k in target], "k long")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    good, all_ = model([t for i, t in rows if i in target and i is not None]), model([t for _, t in rows])
    out = lmscore.score(docs, keys).collect()
    assert len(out) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, t)
    for r in out:
        raw = by[r.doc_id]
        assert r.n_tokens == len(words_of(raw))
        if not words_of(raw):
            assert r.score is None and r.ce_target is None
        elif len(raw) < 5000:
            a, b = losses(good, raw), losses(all_, raw)
            assert (r.ce_target, r.ce_background, r.score) == pytest.approx((a, b, a - b), abs=1e-9)


def test_long_texts_in_pieces(spark, docs, monkeypatch):
    keys = spark.createDataFrame([(8,)], "k long")
    whole = {(r.doc_id, r.n_tokens): r.score for r in lmscore.score(docs, keys).collect()}
    monkeypatch.setattr(lmscore, "PIECE", 1000)
    cut = {(r.doc_id, r.n_tokens): r.score for r in lmscore.score(docs, keys).collect()}
    assert cut.keys() == whole.keys()
    assert all(cut[k] == (None if v is None else pytest.approx(v)) for k, v in whole.items())


def test_held_out_documents_are_told_apart(spark):
    """Trained with the labels of even ids; odd ids are ranked."""
    sf = "/root/testdata/sf0.01"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    keys = labels.filter("quality = 1 AND doc_id % 2 = 0").select("doc_id")
    out = lmscore.score(documents, keys).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("score IS NOT NULL").collect()
    good = np.array([r.score for r in out if r.quality == 1])
    bad = np.array([r.score for r in out if r.quality == 0])
    assert (good[:, None] < bad[None, :]).mean() > 0.9


def test_words_at_any_cut(monkeypatch):
    raw = b"  one two\x0bthree " + b"x" * 40 + b"\n\n four  "
    data = np.frombuffer(raw, np.uint8)
    whole = lmscore.word_hashes(data, lmscore.word_starts(data, 0, len(raw)), len(raw))
    assert len(whole) == 5 and len(set(whole.tolist())) == 5
    for piece in range(1, 30):
        monkeypatch.setattr(lmscore, "PIECE", piece)
        got, at = [], 0
        for stop in lmscore._ends(data, 0, len(raw)):
            starts = lmscore.word_starts(data, at, stop)
            got += lmscore.word_hashes(data, starts, stop).tolist() if len(starts) else []
            at = stop
        assert at == len(raw) and got == whole.tolist()


def test_words_gathered_grow_with_the_corpus(spark):
    distinct = []
    for sf in ("0.001", "0.01"):
        docs = table(spark, f"/root/testdata/sf{sf}", "documents").selectExpr("doc_id AS _key", "text AS _text")
        _, path, sizes = lmscore.fit(docs, spark.createDataFrame([(1,)], "_good long"))
        words = docs.selectExpr(r"explode(regexp_extract_all(_text, '[^\\x20\\x09-\\x0D]+', 0)) AS w")
        assert sizes[1] == tuple(words.selectExpr("count(*)", "count(distinct w)").first())
        assert spark.read.parquet(path).select("code").distinct().count() == sizes[1][1]
        distinct.append(sizes[1][1])
    assert distinct[1] > 2 * distinct[0]


def test_a_text_met_again_is_likelier(spark):
    """A second copy of a document lowers the loss of its rare words under the background model."""
    texts = [f"w{i}a w{i}b w{i}c w{i}d" for i in range(50)]
    rows = list(enumerate(texts)) + [(100, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.ce_background for r in lmscore.score(docs, spark.createDataFrame([(1,)], "k long")).collect()}
    assert out[7] == pytest.approx(out[100])
    assert out[7] < min(v for k, v in out.items() if k not in (7, 100)) - 0.3


def test_no_rows(spark, no_docs):
    assert lmscore.score(no_docs, spark.createDataFrame([(1,)], "k long")).count() == 0
