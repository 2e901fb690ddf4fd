"""One daily run: ingest landed feeds and pages, refresh the window's enrichment, write the report.

* Feeds and pages become article rows, feeds first (arrival priority), in the registry's order of sources; then
  first arrival per URL wins and URLs already stored are skipped; the new rows are appended as one batch. With a
  stream checkpoint, only feed files that no earlier run has seen are read.
* Enrichment of the window is written back where it changes something (``write_enrichment``).
* The report is built from the stored, enriched rows of the newest dates and written as one Markdown file; only the
  bounded report rows reach the driver.

The store's folders and the report are each published in one step, so that a run that is killed leaves the store and the
report of before, and the next run does what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork import rules as R
from presswork.plans.daily import daily_report
from presswork.session import ensure_checkpoint_dir
from presswork.sources.feeds import read_feed_files
from presswork.sources.store import latest_stored, report_file, write_enrichment
from presswork.streaming.ingest import Ingested, incremental_ingest, ingest_batch


@dataclass
class RunResult:
    counts: DataFrame | None   # (source, items, inserted); none where there was nothing to ingest
    quarantined: int
    enriched: int
    markdown: str


def ingest(spark: SparkSession, store_path: str, feeds_path: str | None = None, pages: DataFrame | None = None, mode: str = "url",
           dates: str = "wall_clock", sources: DataFrame | None = None, robots: DataFrame | None = None) -> Ingested:
    """Insert the new articles of one run."""
    files = read_feed_files(spark, feeds_path) if feeds_path else None
    return ingest_batch(spark, store_path, files, pages, mode, sources, dates, robots)


def run_once(spark: SparkSession, store_path: str, report_path: str, as_of, since: str = R.DEFAULT_SINCE,
             limit: int = R.DEFAULT_LIMIT, feeds_path: str | None = None, pages: DataFrame | None = None, mode: str = "url",
             dates: str = "wall_clock", sources: DataFrame | None = None, robots: DataFrame | None = None, summarizer=None,
             feeds_checkpoint: str | None = None, **rules) -> RunResult:
    """``summarizer``: a ``Column -> Column`` plug-in; ``feeds_checkpoint``: a stream checkpoint, so that
    only newly landed feed files are read."""
    ensure_checkpoint_dir(spark)
    done = None
    if feeds_path and feeds_checkpoint:
        done = incremental_ingest(spark, feeds_path, store_path, feeds_checkpoint, mode, sources, dates, robots=robots)
        feeds_path = None
    if feeds_path or pages is not None:
        own = ingest(spark, store_path, feeds_path, pages, mode, dates, sources, robots)
        done = own if done is None else _both(done, own)
    enriched = write_enrichment(spark, store_path, as_of, since, summarizer=summarizer, **rules)
    rep = daily_report(latest_stored(spark, store_path, as_of, since, limit), as_of, since, limit, enrich_rows=False)
    report_file(rep.lines, report_path)
    return RunResult(done.counts if done else None, done.quarantined if done else 0, enriched, rep.markdown())


def _both(a: Ingested, b: Ingested) -> Ingested:
    """Counts of feeds read by the stream and of pages."""
    counts = a.counts.unionByName(b.counts).groupBy("source").agg(F.sum("items").alias("items"), F.sum("inserted").alias("inserted"))
    return Ingested(counts, a.quarantined + b.quarantined)
