import random
import re

from pyspark.sql import functions as F

from presswork.llm import quality
from presswork.llm.common import table

from .conftest import duck, frame, same_rows


def test_sql_on_edge_cases(docs):
    same_rows(quality.digest(docs), duck(quality.digest_sql(), documents=docs.select("doc_id", "text")))


def test_counts_by_brute_force(docs):
    got = {(r.doc_id, r.n_words): r for r in quality.digest(docs).collect()}
    for d in docs.collect():
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i:i + 8]), []).append(i)
        repeated = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d.doc_id, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 20 or 100 * repeated > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_labels_are_met(spark):
    sf = "/root/testdata/sf0.01"
    j = quality.digest(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * (n.get((0, True), 0) + n[0, False])


def test_model_learns_which_rules_hold(spark, tmp_path):
    """A rule that fires on good texts loses its vote; one that fires with others keeps it."""
    rng = random.Random(1)
    pool = [f"{a}{b}" for a in ("gard", "hous", "riv", "tow", "stre", "wind", "mount", "for") for b in ("en", "er", "ing", "let", "ain", "est", "ot", "al")]
    rows = []
    for i in range(300):
        text = " ".join("The {} and the {} of it is in {} for {}.".format(*(rng.choice(pool) + rng.choice(pool) for _ in range(4))) for _ in range(8))
        rows.append((i, text, "en", "a", 1))
    rows += [(1000 + i, "| MENU | HOME | " * 20 + f"item{i} " * 20, "en", "a", 1) for i in range(60)]
    df = frame(spark, tmp_path, rows)
    out = {r.doc_id: r for r in quality.digest(df).collect()}
    assert all(out[i].p_good > 0.9 for i in range(300))
    assert all(not out[1000 + i].kept for i in range(60))
    model = quality.fit(quality.counts(df, F.col("text")))
    assert model["accuracy"]["capitals"] > 0.9 and 0.5 <= model["share"] <= 0.9


def test_no_rows_and_rows_kept_whole(docs, no_docs):
    assert quality.digest(no_docs).count() == 0
    assert quality.keep_good(no_docs).columns == no_docs.columns
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in quality.digest(docs).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_native_plan(docs):
    plan = quality.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_votes_do_not_switch_with_length(spark):
    """One more word changes no vote; long salads of few words get the same vote as short ones, long prose none."""
    from presswork.llm import quality

    vote = lambda n, d: spark.createDataFrame([(n, d)], "n_words long, n_distinct long").selectExpr(quality.RULES["few_distinct"][1]).first()[0]
    for n in (999, 1000, 1001, 1002):
        assert vote(n, 60) and vote(n, 398) and not vote(n, 402)
    assert vote(20_000, 60) and vote(20_000, 1_700) and not vote(20_000, 1_900) and not vote(19, 1)
