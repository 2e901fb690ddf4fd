"""Feeds are rendered once, by many tasks, and texts shuffled once on the way."""

import re
from glob import glob

from pyspark.sql import functions as F

from presswork.plans import registry
from presswork.sources import feeds as FD
from presswork.sources.tables import articles_fx

SF_SMALL = "/root/testdata/sf0.001"


def test_archive_is_written_by_every_task(spark):
    feeds = spark.range(0, 6, 1, 6).select(F.lit("a").alias("source"), F.concat(F.lit("<rss>"), F.col("id").cast("string"), F.lit("</rss>")).alias("xml"))
    path = registry._land_archive(spark, feeds)
    assert len(glob(f"{path}/source=a/part-*")) == 6


def test_quarantine_renders_feeds_once(spark, monkeypatch):
    calls, land = [], FD.land_feeds
    monkeypatch.setattr(FD, "land_feeds", lambda *a, **k: (calls.append(a), land(*a, **k)))
    rows = registry.QUERIES["quarantine"](spark, SF_SMALL).collect()
    assert len(calls) == 1 and rows and {r.reason for r in rows} == {"no feed document"}


def test_texts_take_part_in_one_join(spark, tmp_dir):
    spark.createDataFrame([(1, "s", "a"), (1, "s", "b"), (None, "s", "c"), (5, "s", "d")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(0, "u0"), (1, "u1"), (1, "u2")], "page_id bigint, url string").write.parquet(f"{tmp_dir}/pages.parquet")
    spark.sql("SELECT 1L AS event_id, timestamp_ntz'2024-01-01' AS ts UNION ALL SELECT 1L, timestamp_ntz'2024-01-02'").write.parquet(f"{tmp_dir}/events.parquet")
    a = articles_fx(spark, tmp_dir)
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, \(_id#\d+L = event_id#", plan) and not re.search(r"doc_id#\d+L = event_id#", plan)
    got = sorted((r.content, r.url, str(r.published_at)) for r in a.collect())
    days = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert got == sorted([(t, u, d) for t in "ab" for u in ("u1", "u2") for d in days] + [("c", None, "None"), ("d", None, "None")])


def test_ingest_writes_what_it_parsed_once(spark, tmp_dir, monkeypatch):
    from presswork.streaming import ingest

    names, kept = [], ingest._kept
    monkeypatch.setattr(ingest, "_kept", lambda df, name: (names.append(name), kept(df, name))[1])
    item = "<item><title>{0}</title><link>https://x.example/{0}</link></item>"
    body = "<rss><channel>" + item.format("a") + "<item><title>no link</title></item><item><title>bad</titel></item></channel></rss>"
    files = spark.createDataFrame([("/l/s/f.xml", body), ("/l/s/g.xml", "<rss>cut")], "file_path string, body string")
    done = ingest.ingest_batch(spark, f"{tmp_dir}/store", files)
    assert [(r.source, r["items"], r.inserted) for r in done.counts.collect()] == [("s", 1, 1)] and done.quarantined == 2
    assert names == ["parsed-feeds", "quarantine"]
