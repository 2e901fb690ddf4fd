"""Ingest of landed feeds and pages: one function for a run, a stream's micro-batch and the tests.

A batch is parsed once and materialised; sources that robots rules forbid are left out; what cannot be parsed goes
to the quarantine table beside the store; the rest is reduced to first arrivals per URL (or per title|domain|date
key), anti-joined with the stored keys and appended. What came of each source and how much was quarantined is a table
beside the store too (``_ingest``), so that a stream's run reports what all of its batches did.

Landed feed files are also a file stream. With ``trigger(availableNow=True)`` a run processes everything landed since
the last run and stops; the checkpoint remembers processed files, and the anti-join makes a re-landed file (or a
replayed micro-batch after a failure) insert nothing. First-wins over *all history* needs the store itself, so this
is not ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators.dedup import ingest_counts, new_articles, union_sources
from presswork.operators.robots import robots_filter
from presswork.session import path_exists, scratch_path
from presswork.sources.feeds import ARRIVAL_ORDER, feed_documents, items_to_articles, parse_feeds
from presswork.sources.html import links_to_items, scan_html_links
from presswork.sources.store import insert_batch, not_stored

QUARANTINE = "_quarantine"
QUARANTINE_SCHEMA = "file_path string, doc_ord bigint, entry_ord bigint, reason string, content_hash bigint"
COUNTS = "_ingest"
COUNTS_SCHEMA = "run string, batch bigint, source string, items bigint, inserted bigint, quarantined bigint"
ORDER = ["kind_ord", *ARRIVAL_ORDER]


@dataclass
class Ingested:
    counts: DataFrame        # (source, items, inserted)
    quarantined: int


def page_items(pages: DataFrame, source_col: str = "source", selector: str = "a", sources: DataFrame | None = None) -> DataFrame:
    """Landed HTML pages ``(source, page_id, url, html)`` -> article rows (undated, no content).

    With a registry, a page's links are chosen by its source's ``link_tag`` (``selector`` where it has none); one pass
    per distinct selector, of which a registry has a handful.
    """
    p = pages.select("page_id", "url", "html", F.col(source_col).alias("source"))
    if sources is None:
        p = p.withColumn("_tag", F.lit(selector)).withColumn("source_ord", F.lit(None).cast("int"))
        tags = [selector]
    else:
        reg = sources.filter("kind = 'html'").groupBy(F.col("name").alias("_name")).agg(
            F.min(F.struct("source_ord", "link_tag")).alias("_r"))
        p = p.join(reg, F.col("source") == F.col("_name"), "left").select(
            "page_id", "url", "html", "source", F.coalesce("_r.link_tag", F.lit(selector)).alias("_tag"), "_r.source_ord")
        tags = sorted({r[0] or selector for r in sources.filter("kind = 'html'").select("link_tag").distinct().collect()} | {selector})
    out = None
    for tag in tags:
        links = scan_html_links(p.filter(F.col("_tag") == tag), selector=tag, keep=("source", "source_ord"))
        items = links_to_items(links, F.col("source"), F.col("source_ord"))
        out = items if out is None else out.unionByName(items)
    null = lambda kind: F.lit(None).cast(kind)
    return out.select(
        "source", "domain", "title", "url", null("string").alias("canonical_url"), "published_at", null("string").alias("content"),
        null("string").alias("summary"), null("string").alias("category"), null("string").alias("severity"),
        null("string").alias("soc_action"), "dedupe_key", F.col("source_ord").isNull().cast("int").alias("listed"), "source_ord",
        F.lit("").alias("file_path"), "doc_ord", "entry_ord", null("string").alias("guid"))


def admitted_sources(sources: DataFrame, robots: DataFrame | None) -> DataFrame:
    """The registry's sources whose address robots rules allow to be read."""
    return sources if robots is None else robots_filter(sources, robots)


def ingest_batch(spark: SparkSession, store_path: str, files: DataFrame | None = None, pages: DataFrame | None = None, mode: str = "url",
                 sources: DataFrame | None = None, dates: str = "wall_clock", robots: DataFrame | None = None) -> Ingested:
    """Insert what is new of landed feed files ``(file_path, body)`` and pages ``(source, page_id, url, html)``.

    ``sources``: the registry; it gives the order of arrival and the link selectors. ``robots``: rules
    ``(host, rule_ord, allow, path_prefix)``; listed sources and pages whose address they forbid are left out.
    """
    frames, quarantined = [], 0
    admitted = None if sources is None else admitted_sources(sources, robots)
    if files is not None:
        # what loads and what does not is written once, as articles
        parsed = _kept(items_to_articles(parse_feeds(files), sources, dates, beside=("reason", "content_hash")), "parsed-feeds")
        quarantined = _quarantine(parsed.filter("reason IS NOT NULL"), store_path)
        items = parsed.filter("reason IS NULL").drop("reason", "content_hash")
        if sources is not None and robots is not None:
            shut = sources.join(admitted.select("name"), "name", "left_anti").select(F.col("name").alias("_shut")).distinct()
            items = items.join(shut, F.col("source") == F.col("_shut"), "left_anti")
        frames.append(items)
    if pages is not None:
        allowed = pages if robots is None else robots_filter(pages, robots)
        frames.append(_kept(page_items(allowed, sources=sources), "parsed-pages"))
    if not frames:
        raise ValueError("nothing to ingest")
    batch = union_sources(*frames)
    fresh = new_articles(batch, None, mode, ORDER, absent=lambda rows, key: not_stored(rows, store_path, key))
    inserted = insert_batch(fresh, store_path, ORDER)
    return Ingested(ingest_counts(batch, inserted), quarantined)


def _quarantine(bad: DataFrame, store_path: str) -> int:
    """List what could not be parsed beside the store; returns how much was not listed before. The same place of the same
    file is listed again if what is there is something else."""
    spark, path = bad.sparkSession, f"{store_path.rstrip('/')}/{QUARANTINE}"
    bad = bad.select("file_path", "doc_ord", "entry_ord", "reason", "content_hash")
    if path_exists(spark, path):
        known = spark.read.schema(QUARANTINE_SCHEMA).parquet(path)
        same = [bad[c].eqNullSafe(known[c]) for c in ("file_path", "doc_ord", "entry_ord", "content_hash")]
        bad = bad.join(known, same, "left_anti")
    bad = _kept(bad, "quarantine")
    n = bad.count()
    if n:
        bad.write.mode("append").parquet(path)
    return n


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder once and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_frame(files: DataFrame, store_path: str, mode: str = "url", sources: DataFrame | None = None, dates: str = "wall_clock",
                 robots: DataFrame | None = None) -> DataFrame:
    """Ingest feed files ``(file_path, body)``; per-source counts ``(source, items, inserted)``."""
    return ingest_batch(files.sparkSession, store_path, files, None, mode, sources, dates, robots).counts


@dataclass
class StreamRun(Ingested):
    query: object            # the finished StreamingQuery


def incremental_ingest(spark: SparkSession, landing: str, store_path: str, checkpoint: str, mode: str = "url",
                       sources: DataFrame | None = None, dates: str = "wall_clock", max_files_per_trigger: int | None = None,
                       robots: DataFrame | None = None) -> StreamRun:
    """Run one availableNow pass over everything below ``landing``; counts and quarantine of all of its micro-batches."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(landing).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))
    run, counts_path = uuid.uuid4().hex, f"{store_path.rstrip('/')}/{COUNTS}"

    def per_batch(df: DataFrame, epoch_id: int) -> None:
        done = ingest_batch(spark, store_path, df, None, mode, sources, dates, robots)
        rows = done.counts.select(F.lit(run).alias("run"), F.lit(epoch_id).cast("bigint").alias("batch"), "source", "items", "inserted",
                                  F.lit(0).cast("bigint").alias("quarantined"))
        total = spark.createDataFrame([(run, epoch_id, None, 0, 0, done.quarantined)], COUNTS_SCHEMA)
        rows.unionByName(total).coalesce(1).write.mode("append").parquet(counts_path)

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    own = (spark.read.schema(COUNTS_SCHEMA).parquet(counts_path) if path_exists(spark, counts_path)
           else spark.createDataFrame([], COUNTS_SCHEMA)).filter(F.col("run") == run)
    by_source = own.filter("source IS NOT NULL").groupBy("source").agg(F.sum("items").alias("items"), F.sum("inserted").alias("inserted"))
    return StreamRun(by_source, int(own.agg(F.sum("quarantined")).first()[0] or 0), q)
