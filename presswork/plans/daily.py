"""The daily report: window -> latest N -> enrichment -> top 5, trends, counts, Markdown.

Work that grows with the store: one scan of the window (the publication
predicate is pushed to Parquet; with a date-partitioned store the
``pub_date`` predicate also prunes partitions). Everything after
``latest_n`` is bounded by the report limit (<= 200 rows): the latest rows
are enriched and summarised once, materialised with a reliable checkpoint
(lineage cut, survives executor loss) and fanned out to the small outputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork import rules as R
from presswork.operators import enrich, report, summary, trends
from presswork.session import ensure_checkpoint_dir


@dataclass
class DailyReport:
    latest: DataFrame
    top: DataFrame
    trends: DataFrame
    counts: DataFrame
    header: DataFrame
    top_rows: DataFrame
    detail: DataFrame
    detail_b: DataFrame
    lines: DataFrame

    def markdown(self) -> str:
        return report.render_markdown(self.lines)


def latest_enriched(store: DataFrame, as_of, since: str = R.DEFAULT_SINCE, limit: int = R.DEFAULT_LIMIT,
                    categories=R.CATEGORY_RULES_A, high=R.SEVERITY_HIGH_A, med=R.SEVERITY_MED_A,
                    summarize: bool = True, materialize: bool = True, enrich_rows: bool = True) -> DataFrame:
    win = report.recent_window(store, as_of, since)
    latest = report.latest_n(win, limit)
    if materialize:
        # <= 200 rows: cut the lineage once (reliable checkpoint in the shared
        # spark.checkpoint.dir) so the window is scanned once
        ensure_checkpoint_dir(store.sparkSession)
        latest = latest.checkpoint(eager=True)
    out = enrich.enrich_a(latest, categories=categories, high=high, med=med) if enrich_rows else latest
    if summarize:
        out = summary.enrich_summary(out)
    if materialize:
        out = out.checkpoint(eager=True)
    return out


def daily_report(store: DataFrame, as_of, since: str = R.DEFAULT_SINCE, limit: int = R.DEFAULT_LIMIT,
                 categories=R.CATEGORY_RULES_A, high=R.SEVERITY_HIGH_A, med=R.SEVERITY_MED_A,
                 summarize: bool = True, materialize: bool = True, trend_variant: str = "md",
                 enrich_rows: bool = True) -> DailyReport:
    """``enrich_rows=False`` reports the stored category/severity/action as they are."""
    latest = latest_enriched(store, as_of, since, limit, categories, high, med, summarize, materialize, enrich_rows)
    top = report.top_by_severity(latest, R.TOP_N, strip=True)
    tr = trends.trend_terms(latest, "title", [F.col("pos")], trend_variant, R.TREND_N)
    header = report.report_header(latest, as_of, since, limit)
    top_rows = report.report_top_rows(top)
    detail = report.report_detail_rows(latest)
    lines = report.report_lines(header, top_rows, trends.trends_line(tr), detail)
    return DailyReport(latest=latest, top=top, trends=tr, counts=report.severity_counts(latest),
                       header=header, top_rows=top_rows, detail=detail,
                       detail_b=report.report_detail_rows_b(latest), lines=lines)
