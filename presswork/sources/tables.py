"""Readers for the landed driver tables and the article view bound to them.

``articles_fx`` gives the article data model on top of the driver tables
(one row per document):

* ``arrival_id`` = ``doc_id``; ``source``; ``content`` = ``text``
* ``title`` = first line of the text, whitespace-cleaned, cut at 400
* ``url`` = ``pages.url`` of page ``doc_id mod count(pages)`` (several
  documents share a URL, which exercises de-duplication)
* ``published_at`` = ``events.ts`` of event ``doc_id``; NULL when
  ``doc_id mod 13 = 0`` (undated items)
* ``domain`` from the URL; ``summary``/``category``/``severity``/
  ``soc_action`` NULL (not enriched yet)

The same view is written in SQL in ``presswork.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions.text import clean_whitespace, first_line, truncate
from presswork.functions.urls import dedupe_key, get_domain
from presswork.rules import TITLE_MAX

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
UNDATED_EVERY = 13


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when a scan yields fewer splits than the cluster has
    task slots (e.g. one Parquet row group). Large inputs already arrive in thousands of
    splits and are left as they are, so at scale this adds no shuffle."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows else df


def articles_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ids = table(spark, sf_dir, "documents", spread_rows=False).select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").distinct()
    pages = table(spark, sf_dir, "pages", spread_rows=False).select("page_id", "url")
    events = table(spark, sf_dir, "events", spread_rows=False).select("event_id", "ts")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    keyed = ids.withColumn("_page", F.pmod(F.col("_id"), n_pages))
    # pages and events are joined to the ids alone, and what they give to the documents, so that texts are shuffled at
    # most once; AQE broadcasts a side only when its runtime size is under the broadcast threshold.
    found = (keyed.join(pages, keyed["_page"] == pages["page_id"], "left")
             .join(events, keyed["_id"] == events["event_id"], "left").select("_id", "url", "ts"))
    j = docs.join(found, F.col("doc_id") == F.col("_id"), "left")
    return j.select(
        F.col("doc_id").alias("arrival_id"),
        F.col("source"),
        get_domain(F.col("url")).alias("domain"),
        truncate(clean_whitespace(first_line(F.col("text"))), TITLE_MAX).alias("title"),
        F.col("url"),
        F.lit(None).cast("string").alias("canonical_url"),
        F.when(F.pmod(F.col("doc_id"), F.lit(UNDATED_EVERY)) == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("ts")).alias("published_at"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("soc_action"),
    ).withColumn("dedupe_key", dedupe_key(F.col("title"), F.col("domain"), F.col("published_at")))


def as_of_of(articles: DataFrame):
    """The newest publication time of a frame as a scalar-subquery Column."""
    return articles.agg(F.max("published_at")).scalar()


def as_of_fx(spark: SparkSession, sf_dir: str):
    """The newest publication time of ``articles_fx``, from the document ids and events alone."""
    ids = table(spark, sf_dir, "documents", spread_rows=False).select("doc_id").filter(F.pmod("doc_id", F.lit(UNDATED_EVERY)) != 0)
    events = table(spark, sf_dir, "events", spread_rows=False).select("event_id", "ts")
    return events.join(ids, F.col("event_id") == F.col("doc_id"), "left_semi").agg(F.max("ts")).scalar()
