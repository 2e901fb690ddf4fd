import hashlib
import random
import re

import pytest

from presswork.llm import decontaminate as D

from .conftest import duck, frame, same_rows, words

ITEMS = "item_id long, text string, h string, win string"


def items(spark, tmp_path):
    rng = random.Random(3)
    base = words(rng, 200)
    rows = [(1, " ".join(base[20:50])), (2, " ".join(base[20:50]).upper()), (3, "One, two; THREE!"), (4, None), (5, "  ..."), (6, "été straße"),
            (7, " ".join(base[100:113])), (7, " ".join(base[100:113])), (8, "spam " * 14), (10, " ".join(words(rng, 40))), (11, "x" * 3000), (12, "three")]
    return frame(spark, tmp_path, [(*r, "clash", "clash") for r in rows], ITEMS)


@pytest.mark.parametrize("block", [D.BLOCK, 7])
def test_sql_on_edge_cases(spark, docs, tmp_path, block, monkeypatch):
    b = items(spark, tmp_path)
    monkeypatch.setattr(D.find, "__defaults__", tuple(block if x == D.BLOCK else x for x in D.find.__defaults__))
    same_rows(D.digest(docs, b), duck(D.digest_sql(), documents=docs.select("doc_id", "text"), benchmark=b.select("item_id", "text")))


def test_brute_force(spark, tmp_path):
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(30)]
    bench = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    rows = []
    for i in range(80):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            own = bench[rng.randrange(25)][1].split()
            at = rng.randrange(len(own))
            p = rng.randrange(len(w) + 1)
            w[p:p] = own[at: at + rng.randrange(1, 40)]
        rows.append((i, ", ".join(w), "en", "a", 1))
    out = {r.doc_id: r for r in D.digest(frame(spark, tmp_path / "d", rows), frame(spark, tmp_path / "b", bench, "item_id long, text string")).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    for i, t, *_ in rows:
        w, hit, found = cut(t), set(), set()
        for item, b in bench:
            x = cut(b)
            n = min(13, len(x))
            wins = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_empty_sides(spark, docs, no_docs, tmp_path):
    b = items(spark, tmp_path)
    assert D.digest(no_docs, b).count() == 0
    none = spark.createDataFrame([], ITEMS)
    assert D.digest(docs, none).filter("contaminated OR n_hit > 0").count() == 0
    assert D.drop_contaminated(docs, none).count() == docs.count()


def test_rows_kept_whole(spark, docs, tmp_path):
    b = items(spark, tmp_path)
    kept = D.drop_contaminated(docs, b)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in D.digest(docs, b).filter("NOT contaminated").collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
