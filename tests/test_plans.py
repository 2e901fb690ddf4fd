"""Plan shapes that carry the scale properties (checked on the physical plans)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_SMALL
from presswork.operators import enrich, report, summary
from presswork.plans import registry as G
from presswork.sources.store import append_store, read_store
from presswork.sources.tables import articles_fx, spread


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    p = plan_of(df)
    return p.split("== Initial Plan ==")[0]


def test_latest_then_enrich_is_top_k_not_global_sort(spark):
    p = plan_of(G.QUERIES["daily_top5"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    assert "rangepartitioning" not in p


def test_summary_shuffles_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for df in (summary.extractive_summary(docs, "doc_id", "text"), summary.topk_sentences(docs, "doc_id", "text"),
               summary.enrich_summary(docs.selectExpr("text AS content", "lang AS title", "source AS summary"))):
        assert "Exchange" not in plan_of(df)


def test_term_freq_has_one_exchange(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert final_plan(summary.term_freq(docs, "doc_id", "text")).count("Exchange hashpartitioning") == 1


def test_first_wins_limits_before_shuffle(spark):
    p = plan_of(G.QUERIES["dedup_url"](spark, SF_SMALL))
    assert p.count("WindowGroupLimit") >= 2              # partial (map side) + final


def test_rule_join_is_an_equi_join(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    p = plan_of(enrich.rule_match_join(docs, "doc_id", "text", [("x", ["the"])]))
    assert "NestedLoop" not in p and "CartesianProduct" not in p
    assert "Python" not in p and "Arrow" not in p
    texts = p[p.index("Generate explode(_own"):]               # below the grams: the scan of the texts alone
    assert "Exchange" not in texts[:texts.index("Scan parquet")]


def test_spread_only_when_under_parallelism(spark):
    many = spark.range(0, 1000, 1, numPartitions=spark.sparkContext.defaultParallelism * 2)
    assert spread(many) is many
    one = spark.range(0, 1000, 1, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_window_pushdown_and_partition_pruning(spark, tmp_dir):
    append_store(articles_fx(spark, SF_SMALL), tmp_dir)
    store = read_store(spark, tmp_dir)
    win = report.recent_window(store, dt.datetime(2024, 1, 1, 12), "24h")
    p = plan_of(win)
    assert "PushedFilters: [Or(IsNull(published_at)" in p
    assert "PartitionFilters: [(isnull(pub_date" in p
    assert win.count() == articles_fx(spark, SF_SMALL).filter(
        F.col("published_at").isNull() | (F.col("published_at") >= F.lit(dt.datetime(2023, 12, 31, 12)))).count()


def test_rule_lists_frames_and_blocks_match_alike(spark, monkeypatch):
    from presswork.plans.params import FREQ_CATEGORY_RULES

    docs = spark.createDataFrame([(1, "Nation of the aation"), (2, ""), (3, None), (None, "x-y E"), (1, "the")], "id long, t string")
    rules = FREQ_CATEGORY_RULES + [("edge", ["ation", "e", "x-y", ""]), ("again", ["ation"])]
    texts = [(r.id, (r.t or "").lower()) for r in docs.collect()]
    want = sorted(str((i, o, label, k)) for i, t in texts for o, (label, ks) in enumerate(rules) for k in ks if k in t)
    rows = lambda r: sorted(str(tuple(x)) for x in enrich.rule_match_join(docs, "id", "t", r).collect())
    assert rows(rules) == want == rows(enrich.rules_frame(spark, rules))
    monkeypatch.setattr(enrich, "KEYWORD_BYTES", 150)
    assert rows(rules) == want
    odd = [("odd", ["\U0001F600", "\U0001F600b", "a\nb", "?", None, "straße"])]
    more = spark.createDataFrame([(1, "x \U0001F600B\U0001F601 A\nB"), (2, "STRAßE ?"), (3, "\U0001F601")], "id long, t string")
    got = sorted((r.id, r.keyword) for r in enrich.rule_match_join(more, "id", "t", odd).collect())
    assert got == [(1, "a\nb"), (1, "\U0001F600"), (1, "\U0001F600b"), (2, "?"), (2, "straße")]
    assert enrich.rule_match_join(more, "id", "t", []).collect() == [] == enrich.rule_match_join(more, "id", "t", [("none", [None])]).collect()


def test_many_keywords(spark):
    """The keys of many keywords: every keyword in a text is found, whatever gram it is looked up by."""
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    keywords = sorted({word(rng.randrange(1, 9)) for _ in range(3000)})
    texts = [(i, word(rng.randrange(0, 60))) for i in range(200)]
    rules = spark.createDataFrame([(0, "x", k) for k in keywords], "rule_ord int, label string, keyword string")
    got = enrich.rule_match_join(spark.createDataFrame(texts, "id long, t string"), "id", "t", rules).collect()
    assert sorted((r.id, r.keyword) for r in got) == sorted((i, k) for i, t in texts for k in keywords if k in t)


def test_stop_words_of_any_size(spark):
    from presswork.operators import trends

    docs = spark.createDataFrame([(1, "alpha beta beta gamma gamma gamma"), (2, "delta beta alpha")], "id long, t string")
    rows = lambda s, **kw: [(r.term, r.cnt) for r in trends.trend_terms(docs, "t", ["id"], "report", 10, stopwords=s, **kw).collect()]
    want = [("beta", 3), ("alpha", 2), ("delta", 1)]
    assert rows(["gamma", "gamma", None]) == want
    frame = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("word")).unionByName(spark.createDataFrame([("gamma",)], "word string"))
    assert rows(frame) == want
    assert rows([]) == [("beta", 3), ("gamma", 3), ("alpha", 2), ("delta", 1)]
    p = plan_of(trends.trend_terms(docs, "t", ["id"], "report", 10, stopwords=frame))
    assert "LeftAnti" in p and " IN (" not in p and "INSET" not in p
    kept = trends.stopword_filter(docs.select(F.explode(F.split("t", " ")).alias("term")), frame)
    assert kept.filter("term = 'gamma'").count() == 0 and kept.count() == 6
