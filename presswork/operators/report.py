"""Time-window selection, top-N and the report datasets.

All report outputs are derived from the latest-N frame (N <= 200), so the
only work that scales with the store is the window scan (predicate pushed
to Parquet) and the enrichment of the window rows; everything after
``latest_n`` is bounded by N.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork import rules as R
from presswork.functions.dates import parse_since_hours
from presswork.functions.text import clamp_lines, clean_whitespace, html_to_text, truncate
from presswork.operators.enrich import md_guidance, severity_rank


def _as_col(as_of) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ column. Python datetimes go through their ISO text so
    neither the driver's nor the session's time zone can shift them (aware values are
    taken as their UTC wall clock)."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def window_start(as_of, since: str | int) -> Column:
    hours = since if isinstance(since, int) else parse_since_hours(since)
    return F.timestamp_add("HOUR", F.lit(-int(hours)), _as_col(as_of))


def recent_window(df: DataFrame, as_of, since: str | int = R.DEFAULT_SINCE, ts_col: str = "published_at",
                  part_col: str = "pub_date") -> DataFrame:
    """Undated rows, or rows published at/after ``as_of - since`` (no upper bound).

    The predicate reaches the Parquet scan as ``Or(IsNull, >=)``; on a store
    partitioned by ``pub_date`` the same window on the partition column
    (undated partition kept) prunes whole date folders.
    """
    start = window_start(as_of, since)
    out = df.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= start))
    if part_col in df.columns:
        out = out.filter(F.col(part_col).isNull() | (F.col(part_col) >= F.to_date(start)))
    return out


def report_order(ts_col: str = "published_at", id_col: str = "arrival_id") -> list[Column]:
    """Newest first, undated last, then latest arrival first: a total order."""
    return [F.col(ts_col).desc_nulls_last(), F.col(id_col).desc()]


def report_order_key(ts_col: str = "published_at", id_col: str = "arrival_id") -> list[Column]:
    """:func:`report_order` as ascending keys (for ``min(struct(...))`` first-seen logic)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(ts_col))
    return [F.col(ts_col).isNull(), F.coalesce(-micros, F.lit(0).cast("bigint")), -F.col(id_col)]


def check_limit(limit: int) -> int:
    if not (R.LIMIT_MIN <= int(limit) <= R.LIMIT_MAX):
        raise ValueError(f"limit must be in [{R.LIMIT_MIN}, {R.LIMIT_MAX}], got {limit}")
    return int(limit)


def latest_n(df: DataFrame, limit: int = R.DEFAULT_LIMIT, with_pos: bool = True) -> DataFrame:
    """First ``limit`` rows in report order (TakeOrderedAndProject), with their position ``pos``."""
    top = df.orderBy(*report_order()).limit(check_limit(limit))
    if not with_pos:
        return top
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*report_order())).cast("bigint"))


def top_by_severity(latest: DataFrame, n: int = R.TOP_N, strip: bool = False) -> DataFrame:
    """From the latest rows: severity rank desc, published desc (undated last), then report order."""
    order = [severity_rank("severity", strip).desc(), F.col("published_at").desc_nulls_last(), F.col("arrival_id").desc()]
    top = latest.orderBy(*order).limit(int(n))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def severity_counts(df: DataFrame, sev_col: str = "severity") -> DataFrame:
    """One row: critica, alta, media, baja (null/empty counts as baja; unknown labels nowhere)."""
    s = F.lower(F.coalesce(F.col(sev_col), F.lit("")))
    return df.agg(
        F.count_if(s.isin("critica", "crítica")).cast("bigint").alias("critica"),
        F.count_if(s == "alta").cast("bigint").alias("alta"),
        F.count_if(s == "media").cast("bigint").alias("media"),
        F.count_if((s == "baja") | (s == "")).cast("bigint").alias("baja"),
    )


def iso_ts(c, missing: str) -> Column:
    """Python ``isoformat()`` of a naive timestamp (micro-seconds only when non-zero)."""
    ts = F.col(c) if isinstance(c, str) else c
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(missing)).when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def _or(c: str, default: str) -> Column:
    """Python ``x or default``: null and '' both fall back."""
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(default)).otherwise(F.col(c))


def report_header(latest: DataFrame, as_of, since: str, limit: int) -> DataFrame:
    return latest.agg(
        F.date_format(_as_col(as_of), "yyyy-MM-dd").alias("report_date"),
        F.lit(since).alias("since"),
        F.count(F.lit(1)).alias("included"),
        F.lit(int(limit)).cast("bigint").alias("limit"),
    )


def report_top_rows(top: DataFrame) -> DataFrame:
    return top.select(
        "rank", "title",
        F.lower(_or("severity", "n/a")).alias("severity"),
        _or("category", "general").alias("category"),
        "url",
    )


def report_detail_rows(latest: DataFrame) -> DataFrame:
    """Markdown detail view: one row per article in report order."""
    summ = clean_whitespace(F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary"))
                            .otherwise(F.coalesce(F.col("content"), F.lit(""))))
    return latest.select(
        "pos", "title", "source", "domain",
        iso_ts("published_at", "n/a").alias("published"),
        _or("category", "general").alias("category"),
        _or("severity", "baja").alias("severity"),
        "url",
        F.when(summ == "", F.lit("(sin resumen disponible)")).otherwise(truncate(summ, R.MD_SUMMARY_MAX)).alias("summary"),
        md_guidance("severity", 1).alias("guidance_1"),
        md_guidance("severity", 2).alias("guidance_2"),
    )


def report_detail_rows_b(latest: DataFrame) -> DataFrame:
    """The second (paginated) detail view's data: clamped summary and stored action."""
    src = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.coalesce(F.col("content"), F.lit("")))
    summ = clamp_lines(html_to_text(src), R.SUMMARY_LINES)
    act = clamp_lines(html_to_text(F.col("soc_action")), 4)
    return latest.select(
        "pos", html_to_text(F.col("title")).alias("title"), "source",
        iso_ts("published_at", "n/d").alias("published"),
        _or("category", "general").alias("category"),
        _or("severity", "baja").alias("severity"),
        "url",
        F.when(summ == "", F.lit("(sin resumen)")).otherwise(summ).alias("summary"),
        F.when(act == "", F.lit("(sin recomendación)")).otherwise(act).alias("action"),
    )


def report_lines(header: DataFrame, top_rows: DataFrame, trends_line_df: DataFrame,
                 detail: DataFrame) -> DataFrame:
    """The Markdown report as ordered lines ``(sec, pos, sub, line)``; sort by all three.

    Every input is bounded by the report limit, so this frame is small.
    """
    L = F.lit
    hdr = header.select(F.array(
        F.concat(L("# Informe diario de ciberseguridad — "), F.col("report_date")),
        F.concat(L("Ventana analizada: últimas **"), F.col("since"), L("**")),
        F.concat(L("Noticias incluidas en reporte: **"), F.col("included").cast("string"),
                 L("** (limit="), F.col("limit").cast("string"), L(")")),
        L(""), L("## Top 5 del día")).alias("lines"), L(0).alias("sec"), L(0).cast("bigint").alias("pos"))
    top = top_rows.select(F.array(
        F.concat(F.col("rank").cast("string"), L(". **"), F.col("title"), L("** ")),
        F.concat(L(" - Severidad: **"), F.col("severity"), L("** | Categoría: **"), F.col("category"), L("** ")),
        F.concat(L(" - URL: "), F.col("url"))).alias("lines"), L(1).alias("sec"), F.col("rank").alias("pos"))
    mid = trends_line_df.select(F.array(L(""), L("## Tendencias (términos repetidos)"), F.col("line"), L(""),
                                        L("## Detalle por noticia")).alias("lines"), L(2).alias("sec"),
                                L(0).cast("bigint").alias("pos"))
    det = detail.select(F.array(
        F.concat(L("### "), F.col("title")),
        F.concat(L("- Fuente: **"), F.col("source"), L("** | Dominio: `"), F.col("domain"), L("`")),
        F.concat(L("- Publicado: **"), F.col("published"), L("**")),
        F.concat(L("- Categoría: **"), F.col("category"), L("** | Severidad: **"), F.col("severity"), L("**")),
        F.concat(L("- URL: "), F.col("url")),
        L("**Resumen (3–5 líneas):**"), F.col("summary"),
        L("**Qué debería mirar un SOC:**"), F.col("guidance_1"), F.col("guidance_2"), L("")).alias("lines"),
        L(3).alias("sec"), F.col("pos"))
    blocks = hdr.unionByName(top).unionByName(mid).unionByName(det)
    lines = blocks.select("sec", "pos", F.posexplode("lines").alias("sub", "line"))
    # the document ends right after the last non-empty line
    last = F.max(F.when(F.col("line") != "", F.struct("sec", "pos", "sub"))).over(Window.partitionBy())
    return (lines.withColumn("_last", last)
            .filter(F.struct("sec", "pos", "sub") <= F.col("_last"))
            .select(F.col("sec").cast("int").alias("sec"), F.col("pos").cast("bigint").alias("pos"),
                    F.col("sub").cast("int").alias("sub"), "line"))


def render_markdown(lines: DataFrame) -> str:
    """Collect the (bounded) report lines into the final text."""
    rows = lines.orderBy("sec", "pos", "sub").select("line").collect()
    return "\n".join(r.line for r in rows).rstrip() + "\n"
