"""The store: commits, enrichment as deltas, folding, key index, newest dates, report file."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from presswork.operators.report import latest_n, recent_window
from presswork.sources import store as S
from presswork.sources.manifest import MANIFEST, State, entry, state

AS_OF = dt.datetime(2026, 2, 15, 20)
RULES = {"categories": [("fruit", ["apple"]), ("tool", ["hammer"])], "high": ["rotten"], "med": ["ripe"]}


def rows(spark, first, n, title="apple {i}", age=3, content="ripe text {i}"):
    """n articles, i * ``age`` hours old; every fifth one undated."""
    made = [(i, "s", "d.com", title.format(i=i), f"https://d.com/{i}", None, None if i % 5 == 4 else AS_OF - dt.timedelta(hours=age * i),
             content.format(i=i), None, None, None, None, f"k{i}") for i in range(first, first + n)]
    return spark.createDataFrame(made, S.ARTICLE_SCHEMA)


def content(spark, path):
    return sorted(map(str, S.read_store(spark, path).collect()))


def enriched(spark, path):
    return {r.arrival_id: (r.category, r.severity, r.summary) for r in S.read_store(spark, path).collect()}


def scans(df):
    """Files and output rows of every scan of an executed frame."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            m = node.metrics()
            found.append({k: m.apply(k).value() for k in ("numFiles", "numOutputRows", "filesSize") if m.contains(k)} | {"schema": node.schema().simpleString()})
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_an_append_during_an_enrichment_survives(spark, tmp_dir, monkeypatch):
    S.append_store(rows(spark, 0, 10), tmp_dir)
    real = S.publish

    def late(spark, path, *entries):
        monkeypatch.setattr(S, "publish", real)
        S.append_store(rows(spark, 10, 5), tmp_dir)      # between the enrichment's read and its commit
        real(spark, path, *entries)

    monkeypatch.setattr(S, "publish", late)
    S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES)
    got = enriched(spark, tmp_dir)
    assert len(got) == 15
    assert {i for i, r in got.items() if r[0] == "fruit"} == set(range(10))
    assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES) == 15
    assert {r[0] for r in enriched(spark, tmp_dir).values()} == {"fruit"}


@pytest.mark.parametrize("what", ["append", "enrich", "fold", "index"])
def test_a_killed_writer_leaves_the_old_store(spark, tmp_dir, monkeypatch, what):
    S.append_store(rows(spark, 0, 10), tmp_dir)
    S.append_store(rows(spark, 10, 10), tmp_dir)
    S.write_enrichment(spark, tmp_dir, AS_OF, "24h", **RULES)
    before, ids = content(spark, tmp_dir), S.next_arrival_id(spark, tmp_dir)

    def killed(*args):
        raise KeyboardInterrupt

    work = {"append": lambda: S.append_store(rows(spark, 20, 5), tmp_dir), "enrich": lambda: S.write_enrichment(spark, tmp_dir, AS_OF, "7d"),
            "fold": lambda: S.fold_store(spark, tmp_dir), "index": lambda: S.fold_index(spark, tmp_dir)}[what]
    with monkeypatch.context() as m:
        m.setattr(S, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            work()
    assert content(spark, tmp_dir) == before and S.next_arrival_id(spark, tmp_dir) == ids
    work()
    S.append_store(rows(spark, 25, 1), tmp_dir)
    assert len(content(spark, tmp_dir)) == (26 if what == "append" else 21)


def test_changed_rules_write_only_changed_rows(spark, tmp_dir):
    S.append_store(rows(spark, 0, 10), tmp_dir)
    S.append_store(rows(spark, 10, 10, title="hammer {i}"), tmp_dir)
    assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES) == 20
    delta = lambda: sorted((d.version, d.n) for d in state(spark, tmp_dir).of("delta"))
    assert delta() == [(1, 20)]
    changed = {**RULES, "categories": [("fruit", ["apple"]), ("iron", ["hammer"])]}
    assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **changed) == 20
    assert delta() == [(1, 20), (2, 10)]
    assert {i: r[0] for i, r in enriched(spark, tmp_dir).items()} == {i: "fruit" if i < 10 else "iron" for i in range(20)}
    assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES) == 20          # and back
    assert delta() == [(1, 20), (2, 10), (3, 10)]
    assert enriched(spark, tmp_dir)[12][0] == "tool"


def test_a_run_without_news_reads_no_texts(spark, tmp_dir, monkeypatch):
    S.append_store(rows(spark, 0, 10), tmp_dir)
    S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES)

    def evaluated(*args, **kw):
        raise AssertionError("rows are evaluated")

    with monkeypatch.context() as m:
        m.setattr(S, "update_enrichment", evaluated)
        n = len(os.listdir(f"{tmp_dir}/{MANIFEST}"))
        assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES) == 10
        assert S.write_enrichment(spark, tmp_dir, AS_OF, "24h", **RULES) > 0          # a narrower window
        assert len(os.listdir(f"{tmp_dir}/{MANIFEST}")) == n
        for other in ({"since": "14d"}, {"high": ["ripe"]}):                          # a wider window, other rules
            with pytest.raises(AssertionError):
                S.write_enrichment(spark, tmp_dir, AS_OF, **({"since": "7d"} | RULES | other))
    S.append_store(rows(spark, 10, 5), tmp_dir)
    seen = []
    real = S.update_enrichment
    monkeypatch.setattr(S, "update_enrichment", lambda df, *a, **kw: seen.append(df.count()) or real(df, *a, **kw))
    assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES) == 15
    assert seen == [5]                                                                 # the new rows alone
    assert all(r[0] == "fruit" for r in enriched(spark, tmp_dir).values())


def test_rules_after_other_rules_are_applied_again():
    runs = [("a", 1, 5), ("a", 2, 6), ("b", 3, 7), ("a", 4, 8)]
    day = dt.datetime(2026, 1, 1)
    st = State([entry("run", None, rules=r, version=v, seq=s, start=day) for r, v, s in runs])
    assert [st.evaluated("a", day), st.evaluated("b", day), st.evaluated("a", day - dt.timedelta(1))] == [8, 0, 0]
    assert State(st.entries[:2]).evaluated("a", day) == 6


def test_enrichment_compiles(spark, tmp_dir):
    """Whole-stage code of the enrichment compiles; nothing falls back to interpretation."""
    S.append_store(rows(spark, 0, 10), tmp_dir)
    before = spark.conf.get("spark.sql.codegen.fallback", "true")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert S.write_enrichment(spark, tmp_dir, AS_OF, "7d") == 10
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)


def test_folding_keeps_rows_and_their_enrichment(spark, tmp_dir):
    for k in range(5):
        S.append_store(rows(spark, 10 * k, 10), tmp_dir)
        if k % 2:
            S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES)
    other = {**RULES, "categories": [("pome", ["apple 4"])]}
    S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **other)
    before, ids = content(spark, tmp_dir), S.next_arrival_id(spark, tmp_dir)
    seq = state(spark, tmp_dir).seq
    assert S.fold_store(spark, tmp_dir)
    st = state(spark, tmp_dir)
    assert content(spark, tmp_dir) == before and len(st.of("data")) == 1 and st.of("delta") == []
    assert (st.next_id, st.seq) == (ids, seq)
    assert not S.fold_store(spark, tmp_dir)
    S.append_store(rows(spark, 50, 2), tmp_dir)
    assert not S.fold_store(spark, tmp_dir)                                  # two rows are not worth rewriting fifty
    S.write_enrichment(spark, tmp_dir, AS_OF, "30d", **RULES)                # an older row's delta stays apart
    before = content(spark, tmp_dir)
    S.append_store(rows(spark, 52, 2), tmp_dir)
    assert S.fold_store(spark, tmp_dir)
    assert sorted(e.n for e in state(spark, tmp_dir).of("data")) == [4, 50] and len(state(spark, tmp_dir).of("delta")) == 1
    assert [r for r in content(spark, tmp_dir) if r in before] == before
    assert S.fold_store(spark, tmp_dir, everything=True)
    assert len(state(spark, tmp_dir).of("data")) == 1 and [r for r in content(spark, tmp_dir) if r in before] == before


def test_a_fold_and_an_enrichment_beside_it(spark, tmp_dir, monkeypatch):
    S.append_store(rows(spark, 0, 6), tmp_dir)
    S.append_store(rows(spark, 6, 6), tmp_dir)
    real = S.publish

    def late(spark, path, *entries):
        monkeypatch.setattr(S, "publish", real)
        S.write_enrichment(spark, tmp_dir, AS_OF, "7d", **RULES)
        S.append_store(rows(spark, 12, 1), tmp_dir)
        real(spark, path, *entries)

    monkeypatch.setattr(S, "publish", late)
    S.fold_store(spark, tmp_dir)
    got = enriched(spark, tmp_dir)
    assert len(got) == 13 and {i for i, r in got.items() if r[0] == "fruit"} == set(range(12))


def test_an_ingest_reads_its_own_buckets_of_the_stored_keys(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(S, "INDEX_FILE_KEYS", 16)
    ids = spark.range(2_000).select(
        F.col("id").alias("arrival_id"), F.lit("s").alias("source"), F.lit("d.com").alias("domain"), F.lit("t").alias("title"),
        F.concat(F.lit("https://d.com/"), "id").alias("url"), F.lit(None).cast("string").alias("canonical_url"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("published_at"), *[F.lit(None).cast("string").alias(c) for c in ("content", "summary", "category", "severity", "soc_action")],
        F.concat(F.lit("k"), "id").alias("dedupe_key"))
    S.append_store(ids.filter("arrival_id < 1990"), tmp_dir)
    assert S.fold_index(spark, tmp_dir) and not S.fold_index(spark, tmp_dir)
    S.append_store(ids.filter("arrival_id >= 1990"), tmp_dir)
    new = spark.createDataFrame([(f"https://d.com/{i}",) for i in [*range(0, 2_000, 201), 1_995, 50_000, 50_001]] + [(None,)], "url string")
    got = S.not_stored(new, tmp_dir)
    assert sorted(str(r.url) for r in got.collect()) == ["None", "https://d.com/50000", "https://d.com/50001"]
    read = scans(S.stored_keys(spark, tmp_dir, new))
    index = [s for s in read if s["schema"] == "struct<key:string,name:string,bucket:int>"]
    assert len(index) == 1 and 0 < index[0]["numOutputRows"] < 1_990 / 5
    assert sum(s["numOutputRows"] for s in read) == index[0]["numOutputRows"] + 10
    key = S.not_stored(spark.createDataFrame([("k1",), ("k2000",)], "dedupe_key string"), tmp_dir, "dedupe_key")
    assert [r.dedupe_key for r in key.collect()] == ["k2000"]


def test_index_runs_merge_like_sizes(spark, tmp_dir):
    for k in range(6):
        S.append_store(rows(spark, 10 * k, 10), tmp_dir)
        S.fold_index(spark, tmp_dir)
    sizes = sorted(r.n for r in state(spark, tmp_dir).of("index"))
    assert sum(sizes) == 60 and len(sizes) <= 3
    new = spark.createDataFrame([(f"https://d.com/{i}",) for i in range(70)], "url string")
    assert S.not_stored(new, tmp_dir).count() == 10


def test_latest_reads_the_newest_dates_only(spark, tmp_dir):
    for k in range(4):
        S.append_store(rows(spark, 40 * k, 40, age=1), tmp_dir)
    for n, since in ((5, "7d"), (25, "7d"), (25, "24h"), (150, "7d"), (200, "7d")):
        want = latest_n(recent_window(S.read_store(spark, tmp_dir), AS_OF, since), n)
        got = latest_n(recent_window(S.latest_stored(spark, tmp_dir, AS_OF, since, n), AS_OF, since), n)
        assert list(map(str, got.collect())) == list(map(str, want.collect()))
    few = scans(S.latest_stored(spark, tmp_dir, AS_OF, "7d", 10))
    assert sum(s["numOutputRows"] for s in few) <= 24                      # one day of seven
    assert scans(S.latest_stored(spark, tmp_dir, AS_OF, "7d", 10_000))[0]["numOutputRows"] > 100


def test_a_plain_folder_becomes_a_store(spark, tmp_dir):
    old = f"{tmp_dir}/old"
    S.write_version(rows(spark, 0, 8), old)
    assert S.read_store(spark, old).count() == 8 and S.next_arrival_id(spark, old) == 8
    S.append_store(rows(spark, 8, 4), old)
    S.write_enrichment(spark, old, AS_OF, "7d", **RULES)
    assert S.read_store(spark, old).count() == 12 and {r[0] for r in enriched(spark, old).values()} == {"fruit"}
    assert S.fold_store(spark, old, everything=True)
    assert S.read_store(spark, old).count() == 12 and S.next_arrival_id(spark, old) == 12


def test_empty_stores_and_batches(spark, tmp_dir):
    none = f"{tmp_dir}/none"
    assert S.read_store(spark, none).collect() == [] and S.next_arrival_id(spark, none) == 0
    assert S.write_enrichment(spark, none, AS_OF, "7d") == 0
    assert not S.fold_store(spark, none) and not S.fold_index(spark, none)
    assert S.latest_stored(spark, none, AS_OF, "7d", 5).collect() == []
    S.append_store(rows(spark, 0, 0), none)
    assert S.read_store(spark, none).collect() == []
    assert S.not_stored(rows(spark, 0, 3), none).count() == 3


def test_report_file_is_replaced_whole(spark, tmp_dir):
    lines = lambda *x: spark.createDataFrame([(0, i, 0, t) for i, t in enumerate(x)], "sec int, pos int, sub int, line string").repartition(3)
    path = f"{tmp_dir}/out/report_2026-02-15.md"
    for text in (["# a", "", "b ñ"], ["# c"]):
        S.report_file(lines(*text), path)
        assert open(path, encoding="utf-8").read() == "".join(t + "\n" for t in text)
        assert [f for f in os.listdir(f"{tmp_dir}/out") if not f.endswith(".crc")] == ["report_2026-02-15.md"]
