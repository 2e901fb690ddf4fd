"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their DuckDB oracles.

Every query reads the driver tables (or frames Spark derives from them)
in full; none caps, samples or subsets rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork import rules as R
from presswork.functions import dates as D
from presswork.functions import text as T
from presswork.functions import urls as U
from presswork.operators import dedup, enrich, report, summary, trends
from presswork.plans import oracle as O
from presswork.sources.tables import articles_fx, as_of_fx, table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# flagship: window -> latest N -> enrichment -> top 5
# ---------------------------------------------------------------------------

def _latest(spark, sf, limit=R.DEFAULT_LIMIT, since="24h"):
    arts = articles_fx(spark, sf)
    win = report.recent_window(arts, as_of_fx(spark, sf), since)
    return report.latest_n(win, limit)


@register("daily_top5", _with(O.ARTICLES_FX, O.window(24), O.latest(25), O.enrich_a("latest")) + f"""
SELECT row_number() OVER (ORDER BY {O.sev_rank('severity')} DESC, published_at DESC NULLS LAST, arrival_id DESC) AS rank,
       arrival_id, title, url, published_at, category, severity, severity_score
FROM enr ORDER BY {O.sev_rank('severity')} DESC, published_at DESC NULLS LAST, arrival_id DESC LIMIT 5""")
def q_daily_top5(spark, sf):
    enr = enrich.enrich_a(_latest(spark, sf))
    top = report.top_by_severity(enr, R.TOP_N)
    return top.select("rank", "arrival_id", "title", "url", "published_at", "category", "severity", "severity_score")


# ---------------------------------------------------------------------------
# scalar text functions
# ---------------------------------------------------------------------------

@register("clean_whitespace", f"SELECT doc_id, {O.clean('text')} AS clean FROM documents")
def q_clean_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_whitespace("text").alias("clean"))


@register("strip_html", "SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS stripped FROM pages")
def q_strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html("html").alias("stripped"))


# ---------------------------------------------------------------------------
# URL functions
# ---------------------------------------------------------------------------

@register("get_domain", f"SELECT page_id, {O.domain('url')} AS domain FROM pages")
def q_get_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.get_domain("url").alias("domain"))


def _canon_sql(url: str) -> str:
    p = lambda i: f"regexp_extract({O.url_cleanup(url)}, {O.q(O.URL_PARTS)}, {i})"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    sch = f"CASE WHEN {p(1)} = '' THEN 'https' ELSE lower({p(1)}) END"
    net = f"lower({p(3)})"
    path = f"regexp_replace({p(4)}, '(^|/)([^/;]*);$', '\\1\\2')"
    tracking = ", ".join(O.q(t) for t in R.TRACKING_PARAMS)
    kv = (f"list_transform(list_filter(string_split({p(5)}, '&'), lambda s: s <> ''), "
          f"lambda s: {{'k': {dec('split_part(s, ' + chr(39) + '=' + chr(39) + ', 1)')}, "
          f"'v': CASE WHEN contains(s, '=') THEN {dec('substr(s, instr(s, ' + chr(39) + '=' + chr(39) + ') + 1)')} ELSE '' END}})")
    qs = (f"array_to_string(list_transform(list_sort(list_filter({kv}, lambda e: e.k NOT IN ({tracking}))), "
          f"lambda e: {enc('e.k')} || '=' || {enc('e.v')}), '&')")
    schemes = ", ".join(O.q(s) for s in U.NETLOC_SCHEMES)
    auth_path = f"CASE WHEN {path} <> '' AND NOT starts_with({path}, '/') THEN '/' || {path} ELSE {path} END"
    body = f"CASE WHEN {net} <> '' OR ({sch}) IN ({schemes}) THEN '//' || {net} || {auth_path} ELSE {path} END"
    return f"({sch} || ':' || {body} || CASE WHEN {qs} <> '' THEN '?' || {qs} ELSE '' END)"


@register("canonicalize_url", f"SELECT page_id, {_canon_sql('url')} AS canonical_url FROM pages")
def q_canonicalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonicalize_url("url").alias("canonical_url"))


# ---------------------------------------------------------------------------
# more text functions
# ---------------------------------------------------------------------------

@register("split_sentences", f"""SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, array_to_string(ss, chr(10)) AS sentences
FROM (SELECT doc_id, {O.sentences(O.clean('text'))} AS ss FROM documents)""")
def q_split_sentences(spark, sf):
    ss = T.split_sentences(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(ss).cast("bigint").alias("n_sentences"), F.array_join(ss, "\n").alias("sentences"))


@register("clamp_lines", f"SELECT doc_id, {O.clamp('text', 5)} AS clamped FROM documents")
def q_clamp_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clamp_lines(F.col("text"), 5).alias("clamped"))


@register("tokens_alnum", f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens
FROM (SELECT doc_id, {O.words('text', 3)} AS w FROM documents)""")
def q_tokens_alnum(spark, sf):
    w = T.tokens_alnum(F.col("text"), 3)
    return table(spark, sf, "documents").select(
        "doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.array_join(w, " ").alias("tokens"))


_STRIP = O.q(R.TOKEN_STRIP_CHARS)


@register("tokens_ws", _with(O.ARTICLES_FX) + f"""SELECT arrival_id,
  array_to_string(list_transform(list_filter(string_split(lower({O.clean('title')}), ' '), lambda s: s <> ''),
                                 lambda s: trim(s, {_STRIP})), ' ') AS tokens
FROM articles""")
def q_tokens_ws(spark, sf):
    toks = F.transform(T.tokens_ws(F.col("title")), T.strip_token)
    return articles_fx(spark, sf).select("arrival_id", F.array_join(toks, " ").alias("tokens"))


@register("truncate", _with(O.ARTICLES_FX) + f"""SELECT arrival_id, left(content, {R.CONTENT_MAX}) AS content_cut,
  CAST(length(left(content, {R.CONTENT_MAX})) AS BIGINT) AS n_chars, left({O.clean('content')}, {R.MD_SUMMARY_MAX}) AS summary_cut
FROM articles""")
def q_truncate(spark, sf):
    a = articles_fx(spark, sf)
    cut = T.truncate(F.col("content"), R.CONTENT_MAX)
    return a.select("arrival_id", cut.alias("content_cut"), F.char_length(cut).cast("bigint").alias("n_chars"),
                    T.truncate(T.clean_whitespace("content"), R.MD_SUMMARY_MAX).alias("summary_cut"))


def _entities_sql(x: str) -> str:
    # the entities present in the driver's pages; legacy names also decode without
    # the ';' (as HTML5 parsers do); '&amp' last, so decoding stays single-pass
    for ent, ch in [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&copy;?", "\u00a9"),
                    ("&middot;?", "\u00b7"), ("&amp;?", "&")]:
        x = f"regexp_replace({x}, {O.q(ent)}, {O.q(ch)}, 'g')"
    return x


def _html_to_text_sql(x: str) -> str:
    y = _entities_sql(f"coalesce({x}, '')")
    y = f"regexp_replace({y}, {O.q('(?s)<!--.*?(-->|$)')}, ' ', 'g')"
    for tag in ("script", "style", "template"):
        y = f"regexp_replace({y}, {O.q('(?is)<' + tag + '\\b[^>]*>.*?(</' + tag + '\\s*>|$)')}, ' ', 'g')"
    y = f"regexp_replace({y}, {O.q('<[A-Za-z/!?][^>]*>')}, ' ', 'g')"
    return O.clean(_entities_sql(y))


@register("html_to_text", f"SELECT page_id, {_html_to_text_sql('html')} AS text FROM pages")
def q_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


# ---------------------------------------------------------------------------
# keys and dates
# ---------------------------------------------------------------------------

@register("dedupe_key", _with(O.ARTICLES_FX) + f"""SELECT arrival_id, {_canon_sql('url')} AS url,
  sha256(lower({O.strip_ws('title')}) || '|' || {O.domain(_canon_sql('url'))} || '|' ||
         coalesce(strftime(published_at, '%Y-%m-%d'), '')) AS dedupe_key
FROM articles""")
def q_dedupe_key(spark, sf):
    a = articles_fx(spark, sf).withColumn("url", U.canonicalize_url("url"))
    return a.select("arrival_id", "url", U.dedupe_key("title", U.get_domain("url"), "published_at").alias("dedupe_key"))


def _derived_dates(spark, sf):
    """Publication strings rendered by Spark from ``events.ts`` in several feed formats."""
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id")
    off = F.element_at(F.array(F.lit("Z"), F.lit("+05:30"), F.lit("-0800")),
                       (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int"))
    return ev.select(
        "event_id", "ts", "user_id",
        F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("rfc822"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), off).alias("iso"),
    )


@register("parse_pub_ts", """SELECT event_id, date_trunc('second', ts) AS from_rfc822, ts AS from_iso_wall,
  ts - CASE user_id % 3 WHEN 0 THEN INTERVAL 0 MINUTE WHEN 1 THEN INTERVAL 330 MINUTE ELSE INTERVAL (-480) MINUTE END AS from_iso_utc,
  CAST(NULL AS TIMESTAMP) AS rfc822_as_iso_utc
FROM events""")
def q_parse_pub_ts(spark, sf):
    d = _derived_dates(spark, sf)
    return d.select("event_id",
                    D.parse_pub_ts(F.col("rfc822")).alias("from_rfc822"),
                    D.parse_pub_ts(F.col("iso")).alias("from_iso_wall"),
                    D.parse_iso_utc(F.col("iso")).alias("from_iso_utc"),
                    D.parse_iso_utc(F.col("rfc822")).alias("rfc822_as_iso_utc"))


@register("since_hours", """SELECT event_id, CASE event_type WHEN 'view' THEN user_id WHEN 'click' THEN user_id * 24 ELSE NULL END AS hours
FROM events""")
def q_since_hours(spark, sf):
    ev = table(spark, sf, "events")
    unit = F.when(F.col("event_type") == "view", F.lit(" h")).when(F.col("event_type") == "click", F.lit("D")).otherwise(F.lit("w"))
    return ev.select("event_id", D.since_hours_col(F.concat(F.col("user_id").cast("string"), unit)).alias("hours"))


@register("date_of", _with(O.ARTICLES_FX) + "SELECT arrival_id, strftime(published_at, '%Y-%m-%d') AS pub_date FROM articles")
def q_date_of(spark, sf):
    return articles_fx(spark, sf).select("arrival_id", U.date_iso("published_at").alias("pub_date"))


# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------

@register("recent_window", _with(O.ARTICLES_FX, O.window(24)) + "SELECT arrival_id, published_at FROM win")
def q_recent_window(spark, sf):
    a = articles_fx(spark, sf)
    return report.recent_window(a, as_of_fx(spark, sf), "24h").select("arrival_id", "published_at")


@register("recent_window_7d", _with(O.ARTICLES_FX, O.window(168)) + "SELECT arrival_id, published_at FROM win")
def q_recent_window_7d(spark, sf):
    a = articles_fx(spark, sf)
    return report.recent_window(a, as_of_fx(spark, sf), "7d").select("arrival_id", "published_at")


def _robots_sql() -> str:
    from presswork.plans.params import ROBOTS_RULES
    vals = ", ".join(f"({O.q(h)}, {o}, {str(a).upper()}, {O.q(p)})" for h, o, a, p in ROBOTS_RULES)
    path = (f"(regexp_extract(url, {O.q(O.URL_PARTS)}, 4) || CASE WHEN regexp_extract(url, {O.q(O.URL_PARTS)}, 5) <> '' "
            f"THEN '?' || regexp_extract(url, {O.q(O.URL_PARTS)}, 5) ELSE '' END)")
    return f"""WITH rules(host, rule_ord, allow, path_prefix) AS (VALUES {vals}),
u AS (SELECT page_id, url, {O.domain('url')} AS host, CASE WHEN {path} = '' THEN '/' ELSE {path} END AS path FROM pages),
m AS (SELECT u.page_id, min({{'o': r.rule_ord, 'a': r.allow}}) AS first_rule FROM u JOIN rules r ON r.host = u.host AND starts_with(u.path, r.path_prefix) GROUP BY u.page_id)
SELECT u.page_id, u.url, coalesce(m.first_rule.a, TRUE) AS allowed FROM u LEFT JOIN m USING (page_id)"""


@register("robots_filter", _robots_sql())
def q_robots_filter(spark, sf):
    from presswork.operators.robots import robots_allowed, rules_frame
    from presswork.plans.params import ROBOTS_RULES
    return robots_allowed(table(spark, sf, "pages").select("page_id", "url"), rules_frame(spark, ROBOTS_RULES))


# ---------------------------------------------------------------------------
# scan of HTML links, union of sources, de-duplication
# ---------------------------------------------------------------------------

_HREF_SQL = "(regexp_extract(attrs, {p}, 1) || regexp_extract(attrs, {p}, 2) || regexp_extract(attrs, {p}, 3))"


def _links_sql() -> str:
    inner = f"regexp_extract(a, {O.q('(?is)^<a(?:[^A-Za-z0-9_>][^>]*)?>(.*)</a>$')}, 1)"
    txt = f"regexp_replace({inner}, {O.q('<[A-Za-z/!?][^>]*>')}, ' ', 'g')"
    live = f"regexp_replace(coalesce(html, ''), {O.q('(?s)<!--.*?(?:-->|$)')}, ' ', 'g')"
    for tag in ("script", "style", "template"):
        live = f"regexp_replace({live}, {O.q('(?is)<' + tag + '(?:[^A-Za-z0-9_].*?)?(?:</' + tag + '\\s*>|$)')}, ' ', 'g')"
    href = "(?is)(?:^|[ \t\r\n\f])href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    return f"""links AS (
  SELECT page_id, url AS page_url, CAST(i - 1 AS BIGINT) AS link_ord,
         {_entities_sql(_HREF_SQL.format(p=O.q(href)))} AS href,
         {O.clean(_entities_sql(txt))} AS title
  FROM (SELECT page_id, url, x.a AS a, x.i AS i, regexp_extract(x.a, {O.q('(?is)^<a((?:[^A-Za-z0-9_>][^>]*)?)>')}, 1) AS attrs
        FROM pages, unnest(regexp_extract_all({live}, {O.q('(?is)<a(?:[^A-Za-z0-9_>][^>]*)?>.*?</a>')})) WITH ORDINALITY AS x(a, i)))"""


@register("scan_html_links", _with(_links_sql()) + "SELECT page_id, link_ord, href, title FROM links")
def q_scan_html_links(spark, sf):
    from presswork.sources.html import scan_html_links
    return scan_html_links(table(spark, sf, "pages")).select("page_id", "link_ord", "href", "title")


def _link_items_sql() -> str:
    resolved = "CASE WHEN starts_with(href, '/') THEN regexp_replace(page_url, '/+$', '') || href ELSE href END"
    return f"""link_items AS (
  SELECT 'pages' AS source, {O.domain(_canon_sql('link'))} AS domain, left(title, 400) AS title, {_canon_sql('link')} AS url,
         CAST(NULL AS TIMESTAMP) AS published_at, 1 AS kind_ord, 0 AS source_ord, page_id AS doc_ord, link_ord AS entry_ord
  FROM (SELECT *, {resolved} AS link FROM links WHERE href <> '' AND title <> '')
  WHERE starts_with(link, 'http'))"""


def _article_items_sql() -> str:
    return f"""art_items AS (
  SELECT source, {O.domain(_canon_sql('url'))} AS domain, title, {_canon_sql('url')} AS url, published_at,
         0 AS kind_ord, 0 AS source_ord, 0 AS doc_ord, arrival_id AS entry_ord
  FROM articles WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> '')"""


def _article_items(spark, sf):
    a = articles_fx(spark, sf).filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    a = a.withColumn("url", U.canonicalize_url("url"))
    return a.select("source", U.get_domain("url").alias("domain"), "title", "url", "published_at",
                    F.lit(0).alias("source_ord"), F.lit(0).cast("bigint").alias("doc_ord"), F.col("arrival_id").alias("entry_ord"))


def _link_items(spark, sf):
    from presswork.sources.html import links_to_items, scan_html_links
    return links_to_items(scan_html_links(table(spark, sf, "pages")), "pages", 0).drop("dedupe_key")


_BATCH_SQL = (_with(O.ARTICLES_FX, _links_sql(), _link_items_sql(), _article_items_sql(),
                    "batch AS (SELECT * FROM art_items UNION ALL SELECT * FROM link_items)"))


_BATCH_ORDER = ["kind_ord", "source_ord", "doc_ord", "entry_ord"]
_BATCH_ORDER_SQL = "CAST(kind_ord AS INTEGER) AS kind_ord, CAST(doc_ord AS BIGINT) AS doc_ord, CAST(entry_ord AS BIGINT) AS entry_ord"
_BATCH_ORDER_COLS = ["kind_ord", "doc_ord", "entry_ord"]


@register("union_sources", _BATCH_SQL + f"SELECT source, url, title, {_BATCH_ORDER_SQL} FROM batch")
def q_union_sources(spark, sf):
    u = dedup.union_sources(_article_items(spark, sf), _link_items(spark, sf))
    return u.select("source", "url", "title", *_BATCH_ORDER_COLS)


_FIRST_URL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY kind_ord, source_ord, doc_ord, entry_ord) AS rn FROM batch) WHERE rn = 1"


@register("dedup_url", _BATCH_SQL + f"SELECT url, source, title, {_BATCH_ORDER_SQL} FROM ({_FIRST_URL})")
def q_dedup_url(spark, sf):
    u = dedup.union_sources(_article_items(spark, sf), _link_items(spark, sf))
    return dedup.dedup_url(u, _BATCH_ORDER).select("url", "source", "title", *_BATCH_ORDER_COLS)


@register("dedup_key", _BATCH_SQL + f"""SELECT dedupe_key, url, source, {_BATCH_ORDER_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY kind_ord, source_ord, doc_ord, entry_ord) AS rn FROM (
    SELECT *, sha256(lower({O.strip_ws('title')}) || '|' || domain || '|' || coalesce(strftime(published_at, '%Y-%m-%d'), '')) AS dedupe_key
    FROM batch)) WHERE rn = 1""")
def q_dedup_key(spark, sf):
    u = dedup.union_sources(_article_items(spark, sf), _link_items(spark, sf))
    return dedup.dedup_key(u, _BATCH_ORDER).select("dedupe_key", "url", "source", *_BATCH_ORDER_COLS)


@register("ingest_counts", _BATCH_SQL + f"""SELECT b.source, count(*) AS items, CAST(coalesce(max(k.inserted), 0) AS BIGINT) AS inserted
FROM batch b LEFT JOIN (SELECT source, count(*) AS inserted FROM ({_FIRST_URL}) GROUP BY source) k USING (source)
GROUP BY b.source""")
def q_ingest_counts(spark, sf):
    u = dedup.union_sources(_article_items(spark, sf), _link_items(spark, sf))
    return dedup.ingest_counts(u, dedup.dedup_url(u, _BATCH_ORDER))


@register("anti_existing", _BATCH_SQL + """SELECT doc_ord, entry_ord, url FROM link_items
WHERE url NOT IN (SELECT url FROM art_items)""")
def q_anti_existing(spark, sf):
    """HTML link items whose canonical URL is not already stored as an article."""
    links = _link_items(spark, sf).select("doc_ord", "entry_ord", "url")
    return dedup.anti_existing(links, _article_items(spark, sf), "url")


# ---------------------------------------------------------------------------
# enrichment
# ---------------------------------------------------------------------------

from presswork.plans import params as P  # noqa: E402


def _enriched(spark, sf, freq: bool):
    a = articles_fx(spark, sf)
    if freq:
        return enrich.enrich_a(a, categories=P.FREQ_CATEGORY_RULES, high=P.FREQ_SEVERITY_HIGH, med=P.FREQ_SEVERITY_MED)
    return enrich.enrich_a(a)


def _enrich_sql(freq: bool) -> str:
    lt = O.lower0("title")
    ls = "lower(coalesce(title, '') || chr(10) || coalesce(content, ''))"
    cats = P.FREQ_CATEGORY_RULES if freq else R.CATEGORY_RULES_A
    hi, me = (P.FREQ_SEVERITY_HIGH, P.FREQ_SEVERITY_MED) if freq else (R.SEVERITY_HIGH_A, R.SEVERITY_MED_A)
    return (f"e0 AS (SELECT * EXCLUDE (category, severity, soc_action), {O.category_case(lt, cats)} AS category, "
            f"{O.score_sum(ls, hi, me)} AS severity_score FROM articles), "
            f"e1 AS (SELECT *, {O.severity_case('severity_score')} AS severity FROM e0), "
            f"enriched AS (SELECT *, {O.soc_action_a('category', 'severity')} AS soc_action FROM e1)")


for _freq, _sfx in ((False, ""), (True, "_freq")):
    register(f"categorize_a{_sfx}", _with(O.ARTICLES_FX, _enrich_sql(_freq)) + "SELECT arrival_id, category FROM enriched")(
        lambda spark, sf, _f=_freq: _enriched(spark, sf, _f).select("arrival_id", "category"))
    register(f"severity_score_a{_sfx}", _with(O.ARTICLES_FX, _enrich_sql(_freq)) +
             "SELECT arrival_id, severity_score, severity FROM enriched")(
        lambda spark, sf, _f=_freq: _enriched(spark, sf, _f).select("arrival_id", "severity_score", "severity"))
    register(f"soc_action_a{_sfx}", _with(O.ARTICLES_FX, _enrich_sql(_freq)) + "SELECT arrival_id, soc_action FROM enriched")(
        lambda spark, sf, _f=_freq: _enriched(spark, sf, _f).select("arrival_id", "soc_action"))
    register(f"severity_counts{_sfx}", _with(O.ARTICLES_FX, _enrich_sql(_freq)) + """SELECT
  count(*) FILTER (WHERE lower(coalesce(severity, '')) IN ('critica', 'crítica')) AS critica,
  count(*) FILTER (WHERE lower(coalesce(severity, '')) = 'alta') AS alta,
  count(*) FILTER (WHERE lower(coalesce(severity, '')) = 'media') AS media,
  count(*) FILTER (WHERE lower(coalesce(severity, '')) IN ('baja', '')) AS baja FROM enriched""")(
        lambda spark, sf, _f=_freq: report.severity_counts(_enriched(spark, sf, _f)))


@register("md_guidance", _with(O.ARTICLES_FX, _enrich_sql(True)) + f"""SELECT arrival_id,
  {O.md_guidance('severity', 1)} AS guidance_1, {O.md_guidance('severity', 2)} AS guidance_2,
  {O.sev_rank('severity')} AS severity_rank FROM enriched""")
def q_md_guidance(spark, sf):
    e = _enriched(spark, sf, True)
    return e.select("arrival_id", enrich.md_guidance("severity", 1).alias("guidance_1"),
                    enrich.md_guidance("severity", 2).alias("guidance_2"),
                    enrich.severity_rank("severity").alias("severity_rank"))


def _enrich_b_sql(freq: bool) -> str:
    cats = P.FREQ_CATEGORY_RULES if freq else R.CATEGORY_RULES_B
    tiers = P.FREQ_TIERS if freq else R.SEVERITY_TIERS_B
    summ = O.clamp(_html_to_text_sql(_html_to_text_sql("content")), R.SUMMARY_LINES)
    return (f"b0 AS (SELECT arrival_id, {summ} AS summary, title FROM articles), "
            f"b1 AS (SELECT *, lower(coalesce(title, '') || ' ' || summary) AS lb FROM b0), "
            f"enriched_b AS (SELECT arrival_id, summary, {O.category_case('lb', cats)} AS category, "
            f"{O.category_case('lb', tiers, 'baja')} AS severity FROM b1)")


for _freq, _sfx in ((False, ""), (True, "_freq")):
    register(f"enrich_b{_sfx}", _with(O.ARTICLES_FX, _enrich_b_sql(_freq)) + f"""SELECT arrival_id, summary, category, severity,
  {O.lookup_case('category', R.SOC_ACTIONS_B, R.SOC_ACTION_DEFAULT_B)} AS soc_reco FROM enriched_b""")(
        lambda spark, sf, _f=_freq: enrich.enrich_b(
            articles_fx(spark, sf), "content",
            categories=P.FREQ_CATEGORY_RULES if _f else R.CATEGORY_RULES_B,
            tiers=P.FREQ_TIERS if _f else R.SEVERITY_TIERS_B).select("arrival_id", "summary", "category", "severity", "soc_reco"))


@register("enrich_b_summarized", _with(O.ARTICLES_FX, f"""b0 AS (SELECT arrival_id, title, {O.clamp(_html_to_text_sql(
    f"array_to_string({O.sentences(O.clean(_html_to_text_sql('content')))}[1:2], ' ')"), R.SUMMARY_LINES)} AS summary FROM articles)""",
    "b1 AS (SELECT *, lower(coalesce(title, '') || ' ' || summary) AS lb FROM b0)") + f"""SELECT arrival_id, summary,
  {O.category_case('lb', P.FREQ_CATEGORY_RULES)} AS category, {O.category_case('lb', P.FREQ_TIERS, 'baja')} AS severity FROM b1""")
def q_enrich_b_summarized(spark, sf):
    """The second enrichment with a summariser plug-in."""
    e = enrich.enrich_b(articles_fx(spark, sf), "content", summary.LeadSummarizer(2), P.FREQ_CATEGORY_RULES, P.FREQ_TIERS)
    return e.select("arrival_id", "summary", "category", "severity")


@register("rule_match_join", "WITH rules(rule_ord, label, keyword) AS (VALUES " + ", ".join(
    f"({i}, {O.q(lab)}, {O.q(k)})" for i, (lab, kws) in enumerate(P.FREQ_CATEGORY_RULES) for k in kws) + """)
SELECT d.doc_id, r.rule_ord, r.label, r.keyword FROM documents d JOIN rules r ON contains(lower(coalesce(d.text, '')), r.keyword)""")
def q_rule_match_join(spark, sf):
    ev = enrich.rule_match_join(table(spark, sf, "documents"), "doc_id", "text", P.FREQ_CATEGORY_RULES)
    return ev.select("doc_id", "rule_ord", "label", "keyword")


@register("rule_match_ngram", "WITH rules(rule_ord, label, keyword) AS (VALUES " + ", ".join(
    f"({i}, {O.q(lab)}, {O.q(k)})" for i, (lab, kws) in enumerate(P.FREQ_CATEGORY_RULES) for k in kws) + """)
SELECT d.doc_id, r.rule_ord, r.label, r.keyword FROM documents d JOIN rules r ON contains(lower(coalesce(d.text, '')), r.keyword)""")
def q_rule_match_ngram(spark, sf):
    """The same evidence from a rule frame."""
    rf = enrich.rules_frame(spark, P.FREQ_CATEGORY_RULES)
    return enrich.rule_match_ngram(table(spark, sf, "documents"), "doc_id", "text", rf).select(
        "doc_id", "rule_ord", "label", "keyword")


@register("categorize_by_join", "WITH rules(rule_ord, label, keyword) AS (VALUES " + ", ".join(
    f"({i}, {O.q(lab)}, {O.q(k)})" for i, (lab, kws) in enumerate(P.FREQ_CATEGORY_RULES) for k in kws) + f""")
SELECT doc_id, {O.category_case(O.lower0('text'), P.FREQ_CATEGORY_RULES)} AS category FROM documents""")
def q_categorize_by_join(spark, sf):
    return enrich.categorize_by_join(table(spark, sf, "documents"), "doc_id", "text", P.FREQ_CATEGORY_RULES)


# ---------------------------------------------------------------------------
# extractive summary
# ---------------------------------------------------------------------------

def summary_sql(src: str, id_col: str, text_col: str, max_lines: int = R.SUMMARY_LINES) -> str:
    """CTEs ending in ``summ(id, summary)`` over ``src(id, text)``."""
    return f"""sb AS (SELECT {id_col} AS id, {O.clean(text_col)} AS t FROM {src}),
ss AS (SELECT sb.id, x.s, x.i FROM sb, unnest({O.sentences('sb.t')}) WITH ORDINALITY AS x(s, i)),
stk AS (SELECT ss.id, ss.i, y.w FROM ss, unnest({O.words('ss.s')}) AS y(w)),
sfq AS (SELECT id, w, count(*) AS c FROM stk GROUP BY id, w),
ssc AS (SELECT stk.id, stk.i, sum(sfq.c) AS sc, count(*) AS n FROM stk JOIN sfq USING (id, w) GROUP BY stk.id, stk.i),
srk AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY -(CAST(sc AS DOUBLE) / sqrt(CAST(n AS DOUBLE))), i) AS rk FROM ssc),
spk AS (SELECT srk.id, string_agg(ss.s, chr(10) ORDER BY srk.i) AS picked FROM srk JOIN ss USING (id, i) WHERE rk <= {max_lines} GROUP BY srk.id),
sf3 AS (SELECT id, string_agg(s, ' ' ORDER BY i) AS f3 FROM ss WHERE i <= 3 GROUP BY id),
summ AS (SELECT sb.id, CASE WHEN sb.t = '' THEN '' WHEN spk.id IS NULL THEN coalesce(sf3.f3, '') ELSE trim(spk.picked) END AS summary
         FROM sb LEFT JOIN spk USING (id) LEFT JOIN sf3 USING (id))"""


@register("extractive_summary", _with(summary_sql("documents", "doc_id", "text")) + "SELECT id AS doc_id, summary FROM summ")
def q_extractive_summary(spark, sf):
    return summary.extractive_summary(table(spark, sf, "documents"), "doc_id", "text")


@register("summarizer_plugin", _with(summary_sql("documents", "doc_id", "text", 3)) + "SELECT id AS doc_id, summary FROM summ")
def q_summarizer_plugin(spark, sf):
    plugin = summary.ExtractiveSummarizer(max_lines=3)
    return table(spark, sf, "documents").select("doc_id", plugin(F.col("text")).alias("summary"))


@register("summarizer_lead", f"""SELECT doc_id, array_to_string({O.sentences(O.clean('text'))}[1:2], ' ') AS summary FROM documents""")
def q_summarizer_lead(spark, sf):
    """A second plug-in, handed to the enrichment of articles without a summary."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("string").alias("summary"), F.col("text").alias("content"),
                                             F.lit("").alias("title"))
    return summary.enrich_summary(d, summarizer=summary.LeadSummarizer(2)).select("doc_id", "summary")


@register("topk_sentences", _with(summary_sql("documents", "doc_id", "text")) + """SELECT srk.id AS doc_id, CAST(srk.i - 1 AS BIGINT) AS sent_idx,
  ss.s AS sentence, CAST(srk.rk AS BIGINT) AS score_rank FROM srk JOIN ss USING (id, i) WHERE srk.rk <= 5""")
def q_topk_sentences(spark, sf):
    return summary.topk_sentences(table(spark, sf, "documents"), "doc_id", "text", 5)


@register("term_freq", f"""SELECT doc_id, term, cnt, max(cnt) OVER (PARTITION BY doc_id) AS max_cnt FROM (
  SELECT doc_id, w AS term, count(*) AS cnt FROM (SELECT doc_id, unnest({O.words(O.clean('text'))}) AS w FROM documents) GROUP BY doc_id, w)""")
def q_term_freq(spark, sf):
    return summary.term_freq(table(spark, sf, "documents"), "doc_id", "text")


def _enrich_a_full_sql() -> str:
    src = "(SELECT arrival_id, CASE WHEN coalesce(content, '') <> '' THEN content ELSE title END AS src FROM win)"
    return (_with(O.ARTICLES_FX, O.window(24), summary_sql(src, "arrival_id", "src"),
                  _enrich_sql(False).replace("FROM articles", "FROM win")) +
            """SELECT e.arrival_id, e.category, e.severity, e.soc_action, s.summary FROM enriched e JOIN summ s ON s.id = e.arrival_id""")


@register("enrich_a", _enrich_a_full_sql())
def q_enrich_a(spark, sf):
    a = articles_fx(spark, sf)
    win = report.recent_window(a, as_of_fx(spark, sf), "24h")
    e = summary.enrich_summary(enrich.enrich_a(win))
    return e.select("arrival_id", "category", "severity", "soc_action", "summary")


@register("enrich_count", _with(O.ARTICLES_FX, O.window(24)) + "SELECT count(*) AS enriched FROM win")
def q_enrich_count(spark, sf):
    """Rows that the enrichment of the window wrote back, as the daily run counts them."""
    from presswork.session import scratch_path
    from presswork.sources.store import append_store, read_store, write_enrichment
    a = articles_fx(spark, sf)
    path = scratch_path(spark, "store")
    append_store(a, path)
    as_of = a.agg(F.max("published_at")).first()[0]
    write_enrichment(spark, path, as_of, "24h")
    return report.recent_window(read_store(spark, path), as_of, "24h").filter(
        "category IS NOT NULL AND severity IS NOT NULL AND soc_action IS NOT NULL AND summary IS NOT NULL").agg(F.count(F.lit(1)).alias("enriched"))


# ---------------------------------------------------------------------------
# trends
# ---------------------------------------------------------------------------

def _trend_sql(variant: str, n: int | None, text: str = "title", min_len: int = 4) -> str:
    """Tokens ``tk(rn, term, pos)`` in report order, then count + first appearance per term."""
    base = (f"ord AS (SELECT {text} AS txt, row_number() OVER (ORDER BY published_at DESC NULLS LAST, arrival_id DESC) AS rn "
            f"FROM articles)")
    if variant == "regex":
        stop = ", ".join(O.q(w) for w in R.STOPWORDS_REGEX)
        tok = (f"tk AS (SELECT rn, x.term, x.pos FROM ord, unnest({O.words('txt', min_len)}) WITH ORDINALITY AS x(term, pos) "
               f"WHERE x.term NOT IN ({stop}))")
    else:
        raw = (f"rw AS (SELECT rn, x.raw, x.pos FROM ord, unnest(list_filter(string_split(lower({O.clean('txt')}), ' '), "
               f"lambda s: s <> '')) WITH ORDINALITY AS x(raw, pos))")
        if variant == "md":      # length tested on the raw token, stripped afterwards
            stop = ", ".join(O.q(w) for w in R.STOPWORDS_MD)
            tok = (raw + f", st AS (SELECT rn, trim(raw, {_STRIP}) AS term, pos FROM rw WHERE length(raw) >= {min_len}), "
                   f"tk AS (SELECT * FROM st WHERE term <> '' AND term NOT IN ({stop}))")
        else:                    # stripped first, then the length test
            stop = ", ".join(O.q(w) for w in R.STOPWORDS_REPORT)
            tok = (raw + f", st AS (SELECT rn, trim(raw, {_STRIP}) AS term, pos FROM rw), "
                   f"tk AS (SELECT * FROM st WHERE length(term) >= {min_len} AND term NOT IN ({stop}))")
    agg = "SELECT term, count(*) AS cnt, min({'rn': rn, 'pos': pos}) AS f FROM tk GROUP BY term"
    if n is None:
        return _with(O.ARTICLES_FX, base, tok) + f"SELECT term, cnt FROM ({agg})"
    return (_with(O.ARTICLES_FX, base, tok) +
            f"SELECT row_number() OVER (ORDER BY cnt DESC, f) AS rank, term, cnt FROM ({agg}) ORDER BY cnt DESC, f LIMIT {n}")


def _trend(variant, n, text="title", min_len=4):
    def fn(spark, sf):
        a = articles_fx(spark, sf)
        return trends.trend_terms(a, text, report.report_order_key(), variant, n, min_len)
    return fn


register("trend_terms_report", _trend_sql("report", 10))(_trend("report", 10))
register("trend_terms_md", _trend_sql("md", 10))(_trend("md", 10))
register("trend_terms_regex", _trend_sql("regex", None, "content"))(_trend("regex", None, "content"))
register("trend_terms_report_content", _trend_sql("report", 10, "content"))(_trend("report", 10, "content"))


# ---------------------------------------------------------------------------
# window selection and report datasets (frequent-word rules, so every
# severity level occurs)
# ---------------------------------------------------------------------------

@register("latest_n", _with(O.ARTICLES_FX, O.window(24), O.latest(25)) + "SELECT pos, arrival_id, published_at, title FROM latest")
def q_latest_n(spark, sf):
    return _latest(spark, sf).select("pos", "arrival_id", "published_at", "title")


@register("latest_n_200_7d", _with(O.ARTICLES_FX, O.window(168), O.latest(200)) + "SELECT pos, arrival_id, published_at FROM latest")
def q_latest_n_200(spark, sf):
    return _latest(spark, sf, 200, "7d").select("pos", "arrival_id", "published_at")


def _rep_sql() -> list[str]:
    src = "(SELECT arrival_id, CASE WHEN coalesce(content, '') <> '' THEN content ELSE title END AS src FROM enriched)"
    return [O.ARTICLES_FX, O.window(24), O.latest(25), _enrich_sql(True).replace("FROM articles", "FROM latest"),
            summary_sql(src, "arrival_id", "src"),
            "rep AS (SELECT e.* EXCLUDE (summary), s.summary FROM enriched e JOIN summ s ON s.id = e.arrival_id)"]


def _daily(spark, sf, materialize: bool = True):
    from presswork.plans.daily import daily_report
    a = articles_fx(spark, sf)
    return daily_report(a, as_of_fx(spark, sf), "24h", 25, categories=P.FREQ_CATEGORY_RULES,
                        high=P.FREQ_SEVERITY_HIGH, med=P.FREQ_SEVERITY_MED, materialize=materialize)


_TOP_ORDER = f"{O.sev_rank('severity', strip=True)} DESC, published_at DESC NULLS LAST, arrival_id DESC"


@register("top5", _with(*_rep_sql()) + f"""SELECT row_number() OVER (ORDER BY {_TOP_ORDER}) AS rank, arrival_id, severity,
  published_at FROM rep ORDER BY {_TOP_ORDER} LIMIT 5""")
def q_top5(spark, sf):
    return _daily(spark, sf).top.select("rank", "arrival_id", "severity", "published_at")


@register("report_header", _with(*_rep_sql()) + """SELECT strftime((SELECT max(published_at) FROM articles), '%Y-%m-%d') AS report_date,
  '24h' AS since, count(*) AS included, CAST(25 AS BIGINT) AS "limit" FROM rep""")
def q_report_header(spark, sf):
    return _daily(spark, sf).header


@register("report_top5_rows", _with(*_rep_sql()) + f"""SELECT row_number() OVER (ORDER BY {_TOP_ORDER}) AS rank, title,
  lower({O.or_default('severity', 'n/a')}) AS severity, {O.or_default('category', 'general')} AS category, url
FROM rep ORDER BY {_TOP_ORDER} LIMIT 5""")
def q_report_top5_rows(spark, sf):
    return _daily(spark, sf).top_rows


_SRC2 = "CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE coalesce(content, '') END"
_DETAIL_SQL = f"""detail AS (SELECT pos, title, source, domain, {O.iso_ts('published_at', 'n/a')} AS published,
  {O.or_default('category', 'general')} AS category, {O.or_default('severity', 'baja')} AS severity, url,
  CASE WHEN {O.clean(_SRC2)} = '' THEN '(sin resumen disponible)' ELSE left({O.clean(_SRC2)}, {R.MD_SUMMARY_MAX}) END AS summary,
  {O.md_guidance('severity', 1)} AS guidance_1, {O.md_guidance('severity', 2)} AS guidance_2 FROM rep)"""


@register("report_detail_rows", _with(*_rep_sql(), _DETAIL_SQL) + "SELECT * FROM detail")
def q_report_detail_rows(spark, sf):
    return _daily(spark, sf).detail


@register("report_detail_rows_b", _with(*_rep_sql()) + f"""SELECT pos, {_html_to_text_sql('title')} AS title, source,
  {O.iso_ts('published_at', 'n/d')} AS published, {O.or_default('category', 'general')} AS category,
  {O.or_default('severity', 'baja')} AS severity, url,
  CASE WHEN {O.clamp(_html_to_text_sql(_SRC2), 5)} = '' THEN '(sin resumen)' ELSE {O.clamp(_html_to_text_sql(_SRC2), 5)} END AS summary,
  CASE WHEN {O.clamp(_html_to_text_sql('soc_action'), 4)} = '' THEN '(sin recomendación)' ELSE {O.clamp(_html_to_text_sql('soc_action'), 4)} END AS action
FROM rep""")
def q_report_detail_rows_b(spark, sf):
    return _daily(spark, sf).detail_b


def _md_trends_sql() -> str:
    stop = ", ".join(O.q(w) for w in R.STOPWORDS_MD)
    return f"""rw AS (SELECT pos, x.raw, x.tp FROM rep, unnest(list_filter(string_split(lower({O.clean('title')}), ' '), lambda s: s <> ''))
                WITH ORDINALITY AS x(raw, tp)),
tk AS (SELECT pos, trim(raw, {_STRIP}) AS term, tp FROM rw WHERE length(raw) >= 4),
tr AS (SELECT row_number() OVER (ORDER BY cnt DESC, f) AS rank, term, cnt FROM (
         SELECT term, count(*) AS cnt, min({{'p': pos, 't': tp}}) AS f FROM tk WHERE term <> '' AND term NOT IN ({stop}) GROUP BY term)
       ORDER BY cnt DESC, f LIMIT 10),
trl AS (SELECT CASE WHEN count(*) > 0 THEN string_agg('`' || term || '`(' || CAST(cnt AS VARCHAR) || ')', ', ' ORDER BY rank)
                    ELSE '(sin datos)' END AS line FROM tr)"""


@register("trend_terms_report_md", _with(*_rep_sql(), _md_trends_sql()) + "SELECT rank, term, cnt FROM tr")
def q_trend_terms_report_md(spark, sf):
    return _daily(spark, sf).trends


def _lines_sql() -> str:
    top = f"""t5 AS (SELECT row_number() OVER (ORDER BY {_TOP_ORDER}) AS rank, title,
      lower({O.or_default('severity', 'n/a')}) AS severity, {O.or_default('category', 'general')} AS category, url
      FROM rep ORDER BY {_TOP_ORDER} LIMIT 5)"""
    blocks = f"""blocks AS (
  SELECT 0 AS sec, CAST(0 AS BIGINT) AS pos, ['# Informe diario de ciberseguridad — ' || strftime((SELECT max(published_at) FROM articles), '%Y-%m-%d'),
      'Ventana analizada: últimas **24h**',
      'Noticias incluidas en reporte: **' || CAST((SELECT count(*) FROM rep) AS VARCHAR) || '** (limit=25)', '', '## Top 5 del día'] AS lines
  UNION ALL
  SELECT 1, rank, [CAST(rank AS VARCHAR) || '. **' || title || '** ', ' - Severidad: **' || severity || '** | Categoría: **' || category || '** ',
      ' - URL: ' || url] FROM t5
  UNION ALL
  SELECT 2, 0, ['', '## Tendencias (términos repetidos)', line, '', '## Detalle por noticia'] FROM trl
  UNION ALL
  SELECT 3, pos, ['### ' || title, '- Fuente: **' || source || '** | Dominio: `' || domain || '`', '- Publicado: **' || published || '**',
      '- Categoría: **' || category || '** | Severidad: **' || severity || '**', '- URL: ' || url, '**Resumen (3–5 líneas):**', summary,
      '**Qué debería mirar un SOC:**', guidance_1, guidance_2, ''] FROM detail),
lines AS (SELECT CAST(sec AS INTEGER) AS sec, pos, CAST(x.i - 1 AS INTEGER) AS sub, x.line FROM blocks, unnest(lines) WITH ORDINALITY AS x(line, i))"""
    return top + ",\n" + blocks


@register("report_lines", _with(*_rep_sql(), _DETAIL_SQL, _md_trends_sql(), _lines_sql()) +
          "SELECT * FROM lines WHERE NOT (sec = 3 AND sub = 10 AND pos = (SELECT max(pos) FROM detail))")
def q_report_lines(spark, sf):
    return _daily(spark, sf).lines


@register("daily_report", _with(*_rep_sql(), _DETAIL_SQL, _md_trends_sql(), _lines_sql()) + """SELECT
  strftime((SELECT max(published_at) FROM articles), '%Y-%m-%d') AS report_date,
  string_agg(line, chr(10) ORDER BY sec, pos, sub) || chr(10) AS markdown
FROM lines WHERE NOT (sec = 3 AND sub = 10 AND pos = (SELECT max(pos) FROM detail))""")
def q_daily_report(spark, sf):
    d = _daily(spark, sf)
    md = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec", "pos", "sub", "line"))),
                                           lambda e: e["line"]), "\n"), F.lit("\n"))
    return d.lines.agg(md.alias("markdown")).crossJoin(d.header.select("report_date"))


@register("severity_counts_report", _with(*_rep_sql()) + """SELECT
  count(*) FILTER (WHERE lower(coalesce(severity, '')) IN ('critica', 'crítica')) AS critica,
  count(*) FILTER (WHERE lower(coalesce(severity, '')) = 'alta') AS alta,
  count(*) FILTER (WHERE lower(coalesce(severity, '')) = 'media') AS media,
  count(*) FILTER (WHERE lower(coalesce(severity, '')) IN ('baja', '')) AS baja FROM rep""")
def q_severity_counts_report(spark, sf):
    return _daily(spark, sf).counts


# ---------------------------------------------------------------------------
# feed sources, store and incremental ingest (feeds rendered by Spark from
# the driver tables and landed in the shared checkpoint folder)
# ---------------------------------------------------------------------------

def _land(spark, sf, kind: str) -> str:
    from presswork.session import scratch_path
    from presswork.sources import feeds as FD
    a = articles_fx(spark, sf)
    path = scratch_path(spark, f"landing-{kind}")
    FD.land_feeds(FD.render_rss_feeds(a) if kind == "rss" else FD.render_atom_feeds(a), path)
    return path


def _ingested_sql(ts: str) -> str:
    stripped = "regexp_replace(coalesce(content, ''), '<[^>]+>', '', 'g')"
    content = f"NULLIF(left({O.clean(stripped)}, {R.CONTENT_MAX}), '')"
    return f"""ingested AS (SELECT arrival_id, source, left({O.clean('title')}, {R.TITLE_MAX}) AS title, {_canon_sql('trim(url)')} AS url,
  {ts} AS published_at, {content} AS content
FROM articles WHERE {O.clean('title')} <> '' AND trim(coalesce(url, '')) <> '')"""


@register("scan_rss", _with(O.ARTICLES_FX, _ingested_sql("date_trunc('second', published_at)")) + "SELECT * FROM ingested")
def q_scan_rss(spark, sf):
    from presswork.sources import feeds as FD
    items, _ = FD.scan_feeds(spark, _land(spark, sf, "rss"))
    return FD.items_to_articles(items).select(F.col("guid").cast("bigint").alias("arrival_id"), "source", "title", "url",
                                              "published_at", "content")


@register("scan_atom", _with(O.ARTICLES_FX, _ingested_sql("date_trunc('second', published_at) - INTERVAL 330 MINUTE")) +
          "SELECT * FROM ingested")
def q_scan_atom(spark, sf):
    from presswork.sources import feeds as FD
    items, _ = FD.scan_feeds(spark, _land(spark, sf, "atom"))
    return FD.items_to_articles(items, dates="utc").select(F.col("guid").cast("bigint").alias("arrival_id"), "source",
                                                           "title", "url", "published_at", "content")


@register("quarantine", _with(O.ARTICLES_FX) + """SELECT source, 'no feed document' AS reason
FROM articles GROUP BY source, floor(arrival_id / 2000)""")
def q_quarantine(spark, sf):
    """Good feeds plus a truncated copy of each (cut in half, so never closed): every cut
    file is quarantined, and only the good files load."""
    from presswork.session import scratch_path
    from presswork.sources import feeds as FD
    root = scratch_path(spark, "landing-mixed")
    feeds = FD.render_rss_feeds(articles_fx(spark, sf))
    # both are landed by one job, so that the feeds are rendered once
    both = feeds.withColumn("state", F.explode(F.array(F.lit("good"), F.lit("cut"))))
    half = F.left("xml", (F.length("xml") / 2).cast("int"))
    FD.land_feeds(both.withColumn("xml", F.when(F.col("state") == "cut", half).otherwise(F.col("xml"))), root, by=("state",))
    _, bad = FD.scan_feeds(spark, root)
    return bad.select(FD.source_from_path(F.col("file_path")).alias("source"), "reason")


@register("incremental_ingest", _with(O.ARTICLES_FX, _ingested_sql("date_trunc('second', published_at)")) + """SELECT url, source, title,
  published_at, content FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source, arrival_id) AS rn FROM ingested) WHERE rn = 1""")
def q_incremental_ingest(spark, sf):
    from presswork.session import scratch_path
    from presswork.sources.store import read_store
    from presswork.streaming.ingest import incremental_ingest
    landing = _land(spark, sf, "rss")
    store, ckpt = scratch_path(spark, "store"), scratch_path(spark, "stream-ckpt")
    incremental_ingest(spark, landing, store, ckpt)
    incremental_ingest(spark, landing, store, ckpt)      # a rerun adds nothing
    return read_store(spark, store).select("url", "source", "title", "published_at", "content")


def _registry_of(spark, sf):
    """A registry that lists every other source of the documents, the last one first."""
    names = table(spark, sf, "documents").select("source").distinct()
    place = F.row_number().over(Window.orderBy(F.col("source").desc()))
    return names.select(F.col("source").alias("name"), place.alias("source_ord")).filter("source_ord % 2 = 1").select(
        F.lit("rss").alias("kind"), "name", F.concat(F.lit("https://feeds.example/"), "name").alias("url"), F.lit(None).cast("string").alias("link_tag"),
        "source_ord")


_REGISTRY_SQL = """reg AS (SELECT * FROM (SELECT source AS name, row_number() OVER (ORDER BY source DESC) AS source_ord
  FROM (SELECT DISTINCT source FROM documents)) WHERE source_ord % 2 = 1)"""


@register("source_registry", _with(O.ARTICLES_FX, _ingested_sql("date_trunc('second', published_at)"), _REGISTRY_SQL) + """SELECT arrival_id, source,
  CAST(reg.source_ord AS INTEGER) AS source_ord, CASE WHEN reg.name IS NULL THEN 1 ELSE 0 END AS listed
FROM ingested LEFT JOIN reg ON reg.name = source""")
def q_source_registry(spark, sf):
    """Feed items with their place in the registry."""
    from presswork.sources import feeds as FD
    items, _ = FD.scan_feeds(spark, _land(spark, sf, "rss"))
    arts = FD.items_to_articles(items, _registry_of(spark, sf))
    return arts.select(F.col("guid").cast("bigint").alias("arrival_id"), "source", "source_ord", "listed")


@register("run_ingest", _with(O.ARTICLES_FX, _links_sql(), _link_items_sql(), _ingested_sql("date_trunc('second', published_at)"), _REGISTRY_SQL) + """
SELECT url, source, title, published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY kind_ord, listed, source_ord, doc_ord, entry_ord) AS rn FROM (
    SELECT url, source, title, published_at, 0 AS kind_ord, CASE WHEN reg.name IS NULL THEN 1 ELSE 0 END AS listed,
      coalesce(reg.source_ord, 0) AS source_ord, CASE WHEN reg.name IS NULL THEN source ELSE '' END AS doc_ord, arrival_id AS entry_ord
    FROM ingested LEFT JOIN reg ON reg.name = source
    UNION ALL SELECT url, 'site' AS source, title, NULL AS published_at, 1 AS kind_ord, 1 AS listed, 0 AS source_ord,
      lpad(CAST(doc_ord AS VARCHAR), 20, '0') AS doc_ord, entry_ord FROM link_items)) WHERE rn = 1""")
def q_run_ingest(spark, sf):
    """Feeds and pages through the run's ingest, sources in the order of a registry."""
    from presswork.plans.run import ingest
    from presswork.session import scratch_path
    from presswork.sources.store import read_store
    store = scratch_path(spark, "store")
    pages = table(spark, sf, "pages").withColumn("source", F.lit("site"))
    ingest(spark, store, _land(spark, sf, "rss"), pages, sources=_registry_of(spark, sf))
    return read_store(spark, store).select("url", "source", "title", "published_at")


@register("quarantine_entries", _with(O.ARTICLES_FX) + """SELECT source, CAST(sum(CASE WHEN arrival_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS malformed,
  count(*) AS entries FROM articles GROUP BY source""")
def q_quarantine_entries(spark, sf):
    """Feeds in which every fifth entry is not well-formed: these entries are quarantined, the others load."""
    from presswork.session import scratch_path
    from presswork.sources import feeds as FD
    root = scratch_path(spark, "landing-malformed")
    a = articles_fx(spark, sf).withColumn("title", F.when(F.col("arrival_id") % 5 == 0, F.lit("@@broken@@")).otherwise(F.lit("fine")))
    feeds = FD.render_rss_feeds(a.withColumn("content", F.lit(None).cast("string")))
    FD.land_feeds(feeds.withColumn("xml", F.replace("xml", F.lit("@@broken@@</title>"), F.lit("broken</titel>"))), root)
    items, bad = FD.scan_feeds(spark, root)
    bad = bad.select(FD.source_from_path(F.col("file_path")).alias("source"), F.lit(1).alias("m"))
    both = bad.unionByName(items.select("source", F.lit(0).alias("m")))
    return both.groupBy("source").agg(F.sum("m").cast("bigint").alias("malformed"), F.count(F.lit(1)).alias("entries"))


def _land_archive(spark, feeds) -> str:
    """Rendered feeds as files per source, each with many feed documents: every task that rendered some writes its own."""
    from presswork.session import scratch_path
    path = scratch_path(spark, "archive")
    feeds.select("source", "xml").write.partitionBy("source").text(path)
    return path


@register("feed_archive", _with(O.ARTICLES_FX, _ingested_sql("date_trunc('second', published_at)")) + "SELECT * FROM ingested")
def q_feed_archive(spark, sf):
    """Feeds in a few large files, split by bytes between entries."""
    from presswork.sources import feeds as FD
    parsed = FD.read_feed_archive(spark, _land_archive(spark, FD.render_rss_feeds(articles_fx(spark, sf))))
    return FD.items_to_articles(parsed.filter("reason IS NULL")).select(
        F.col("guid").cast("bigint").alias("arrival_id"), "source", "title", "url", "published_at", "content")


@register("feed_archive_entries", _with(O.ARTICLES_FX) + """SELECT source, CASE WHEN arrival_id % 5 = 0 THEN 'malformed entry' END AS reason,
  count(*) AS entries FROM articles GROUP BY 1, 2""")
def q_feed_archive_entries(spark, sf):
    """Atom archives in which every fifth entry is not well-formed, loaded and quarantined by one parse."""
    from presswork.sources import feeds as FD
    a = articles_fx(spark, sf).withColumn("title", F.when(F.col("arrival_id") % 5 == 0, F.lit("@@broken@@")).otherwise(F.lit("fine")))
    feeds = FD.render_atom_feeds(a.withColumn("content", F.lit(None).cast("string")))
    feeds = feeds.withColumn("xml", F.replace("xml", F.lit("@@broken@@</title>"), F.lit("broken</titel>")))
    return FD.read_feed_archive(spark, _land_archive(spark, feeds), "atom").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("entries"))


@register("ingest_rerun_inserts", _with(O.ARTICLES_FX, _ingested_sql("published_at")) + """SELECT 1 AS run,
  CAST(count(DISTINCT url) AS BIGINT) AS inserted FROM ingested
UNION ALL SELECT 2 AS run, CAST(0 AS BIGINT) AS inserted""")
def q_ingest_rerun_inserts(spark, sf):
    """Rows inserted by a first ingest of the landed feeds and by an identical rerun."""
    from presswork.session import scratch_path
    from presswork.sources.feeds import read_feed_files
    from presswork.streaming.ingest import ingest_frame
    landing = _land(spark, sf, "rss")
    store = scratch_path(spark, "store")
    files = read_feed_files(spark, landing)
    runs = [ingest_frame(files, store).agg(F.lit(run).alias("run"), F.sum("inserted").alias("inserted")) for run in (1, 2)]
    return runs[0].unionByName(runs[1])


@register("read_store", _with(O.ARTICLES_FX) + """SELECT arrival_id, source, domain, title, url, published_at, content, summary
FROM articles""")
def q_read_store(spark, sf):
    from presswork.session import scratch_path
    from presswork.sources.store import append_store, read_store
    path = scratch_path(spark, "store")
    append_store(articles_fx(spark, sf), path)
    return read_store(spark, path).select("arrival_id", "source", "domain", "title", "url", "published_at", "content", "summary")


def _update_sql() -> str:
    src = "(SELECT arrival_id, CASE WHEN coalesce(content, '') <> '' THEN content ELSE title END AS src FROM win)"
    return (_with(O.ARTICLES_FX, O.window(24), summary_sql(src, "arrival_id", "src"),
                  _enrich_sql(False).replace("FROM articles", "FROM win")) +
            """SELECT e.arrival_id, e.category, e.severity, e.soc_action, s.summary FROM enriched e JOIN summ s ON s.id = e.arrival_id
UNION ALL SELECT arrival_id, category, severity, soc_action, summary FROM articles WHERE arrival_id NOT IN (SELECT arrival_id FROM win)""")


@register("update_enrichment", _update_sql())
def q_update_enrichment(spark, sf):
    from presswork.sources.store import update_enrichment
    a = articles_fx(spark, sf)
    return update_enrichment(a, as_of_fx(spark, sf), "24h").select("arrival_id", "category", "severity", "soc_action", "summary")


@register("missing_summary", _with(O.ARTICLES_FX) + """SELECT arrival_id FROM articles
WHERE (published_at IS NULL OR published_at >= (SELECT max(published_at) FROM articles) - INTERVAL 168 HOUR)
  AND NOT (published_at IS NULL OR published_at >= (SELECT max(published_at) FROM articles) - INTERVAL 24 HOUR)""")
def q_missing_summary(spark, sf):
    from presswork.sources.store import update_enrichment
    a = articles_fx(spark, sf)
    first = update_enrichment(a, as_of_fx(spark, sf), "24h")
    wide = report.recent_window(first, as_of_fx(spark, sf), "7d")
    return wide.filter(F.coalesce(F.col("summary"), F.lit("")) == "").select("arrival_id")


@register("resolve_link", _with(_links_sql()) + """SELECT page_id, link_ord,
  CASE WHEN starts_with(href, '/') THEN regexp_replace(page_url, '/+$', '') || href ELSE href END AS link FROM links""")
def q_resolve_link(spark, sf):
    from presswork.sources.html import scan_html_links
    links = scan_html_links(table(spark, sf, "pages"))
    return links.select("page_id", "link_ord", U.resolve_link(F.col("href"), F.col("page_url")).alias("link"))


@register("required_fields", _with(_links_sql()) + "SELECT page_id, link_ord FROM links WHERE href <> '' AND title <> ''")
def q_required_fields(spark, sf):
    from presswork.sources.html import scan_html_links
    links = scan_html_links(table(spark, sf, "pages"))
    return links.filter((F.col("href") != "") & (F.col("title") != "")).select("page_id", "link_ord")


# ---------------------------------------------------------------------------
# focused views of single operators
# ---------------------------------------------------------------------------

def _enrich_b_frame(spark, sf):
    return enrich.enrich_b(articles_fx(spark, sf), "content", categories=P.FREQ_CATEGORY_RULES, tiers=P.FREQ_TIERS)


register("categorize_b", _with(O.ARTICLES_FX, _enrich_b_sql(True)) + "SELECT arrival_id, category FROM enriched_b")(
    lambda spark, sf: _enrich_b_frame(spark, sf).select("arrival_id", "category"))
register("severity_tier_b", _with(O.ARTICLES_FX, _enrich_b_sql(True)) + "SELECT arrival_id, severity FROM enriched_b")(
    lambda spark, sf: _enrich_b_frame(spark, sf).select("arrival_id", "severity"))
register("soc_action_b", _with(O.ARTICLES_FX, _enrich_b_sql(True)) + f"""SELECT arrival_id,
  {O.lookup_case('category', R.SOC_ACTIONS_B, R.SOC_ACTION_DEFAULT_B)} AS soc_reco FROM enriched_b""")(
    lambda spark, sf: _enrich_b_frame(spark, sf).select("arrival_id", "soc_reco"))


@register("severity_rank", _with(O.ARTICLES_FX, _enrich_sql(True)) + f"""SELECT arrival_id, {O.sev_rank('severity')} AS severity_rank,
  {O.sev_rank("upper(severity) || ' '", strip=True)} AS severity_rank_stripped FROM enriched""")
def q_severity_rank(spark, sf):
    e = _enriched(spark, sf, True)
    return e.select("arrival_id", enrich.severity_rank("severity").alias("severity_rank"),
                    enrich.severity_rank(F.concat(F.upper("severity"), F.lit(" ")), strip=True).alias("severity_rank_stripped"))


@register("action_lookup", _with(O.ARTICLES_FX, _enrich_sql(True)) + f"""SELECT arrival_id,
  {O.lookup_case('category', R.SOC_ACTIONS_A, R.SOC_ACTION_DEFAULT_A)} AS action FROM enriched""")
def q_action_lookup(spark, sf):
    return _enriched(spark, sf, True).select("arrival_id", enrich.action_lookup("category").alias("action"))


@register("stopword_filter", _with(O.ARTICLES_FX) + f"""SELECT arrival_id, array_to_string(list_filter(
  list_transform(list_filter(string_split(lower({O.clean('title')}), ' '), lambda s: s <> ''), lambda s: trim(s, {_STRIP})),
  lambda w: length(w) >= 4 AND w NOT IN ({", ".join(O.q(w) for w in R.STOPWORDS_REPORT)})), ' ') AS kept_terms FROM articles""")
def q_stopword_filter(spark, sf):
    toks = F.transform(T.tokens_ws(F.col("title")), T.strip_token)
    kept = F.filter(toks, lambda w: (F.char_length(w) >= 4) & ~w.isin(R.STOPWORDS_REPORT))
    return articles_fx(spark, sf).select("arrival_id", F.array_join(kept, " ").alias("kept_terms"))


@register("entry_content", _with(O.ARTICLES_FX) + f"""SELECT arrival_id,
  NULLIF(left({O.clean("regexp_replace(coalesce(content, ''), '<[^>]+>', '', 'g')")}, {R.CONTENT_MAX}), '') AS content,
  published_at IS NULL AS from_content_element
FROM articles WHERE {O.clean('title')} <> '' AND trim(coalesce(url, '')) <> ''""")
def q_entry_content(spark, sf):
    """Atom entries carry dated text in <summary> and undated text in <content>; both must load."""
    from presswork.sources import feeds as FD
    items, _ = FD.scan_feeds(spark, _land(spark, sf, "atom"))
    arts = FD.items_to_articles(items, dates="utc")
    flag = items.select(F.col("guid"), F.col("summary_raw").isNull().alias("from_content_element"))
    return arts.join(flag, "guid").select(F.col("guid").cast("bigint").alias("arrival_id"), "content", "from_content_element")


@register("append_store", _with(O.ARTICLES_FX) + "SELECT arrival_id, url, published_at FROM articles")
def q_append_store(spark, sf):
    """Two appended batches (dated, then undated rows) read back as one table."""
    from presswork.session import scratch_path
    from presswork.sources.store import append_store, read_store
    path = scratch_path(spark, "store")
    a = articles_fx(spark, sf)
    append_store(a.filter(F.col("published_at").isNotNull()), path)
    append_store(a.filter(F.col("published_at").isNull()), path)
    return read_store(spark, path).select("arrival_id", "url", "published_at")


@register("report_sink", _with(*_rep_sql(), _DETAIL_SQL, _md_trends_sql(), _lines_sql()) +
          "SELECT line FROM lines WHERE NOT (sec = 3 AND sub = 10 AND pos = (SELECT max(pos) FROM detail))")
def q_report_sink(spark, sf):
    """The report written as one text file and read back (one row per line)."""
    from presswork.session import scratch_path
    from presswork.sources.store import report_sink
    path = scratch_path(spark, "report")
    report_sink(_daily(spark, sf).lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("store_enriched", _update_sql())
def q_store_enriched(spark, sf):
    """Two batches, an enrichment by other rules before and after the second, then by the rules themselves, folded and read."""
    from presswork.session import scratch_path
    from presswork.sources.store import append_store, fold_store, read_store, write_enrichment
    a = articles_fx(spark, sf)
    path = scratch_path(spark, "store")
    as_of = a.agg(F.max("published_at")).first()[0]
    other = {"categories": P.FREQ_CATEGORY_RULES}
    append_store(a.filter("arrival_id % 2 = 0"), path)
    write_enrichment(spark, path, as_of, "24h", **other)
    append_store(a.filter("arrival_id % 2 = 1"), path)
    write_enrichment(spark, path, as_of, "24h", **other)
    write_enrichment(spark, path, as_of, "24h")
    fold_store(spark, path)
    return read_store(spark, path).select("arrival_id", "category", "severity", "soc_action", "summary")


@register("not_stored", _BATCH_SQL + """SELECT doc_ord, entry_ord, url FROM link_items
WHERE url NOT IN (SELECT url FROM art_items)""")
def q_not_stored(spark, sf):
    """HTML link items whose URL is not in a store, by the store's key index and the batch since."""
    from presswork.session import scratch_path
    from presswork.sources.store import append_store, fold_index, not_stored
    path = scratch_path(spark, "store")
    items = _article_items(spark, sf)
    stored = items.select(F.col("entry_ord").alias("arrival_id"), "source", "domain", "title", "url", F.lit(None).cast("string").alias("canonical_url"), "published_at",
                          *[F.lit(None).cast("string").alias(c) for c in ("content", "summary", "category", "severity", "soc_action")],
                          U.dedupe_key("title", "domain", "published_at").alias("dedupe_key"))
    append_store(stored.filter("arrival_id % 3 > 0"), path)
    fold_index(spark, path)
    append_store(stored.filter("arrival_id % 3 = 0"), path)
    return not_stored(_link_items(spark, sf).select("doc_ord", "entry_ord", "url"), path)


@register("latest_stored", _with(O.ARTICLES_FX, O.window(168), O.latest(25)) + "SELECT pos, arrival_id, published_at, title FROM latest")
def q_latest_stored(spark, sf):
    """The newest 25 of a week from a store of two batches, read from the dates that hold them."""
    from presswork.session import scratch_path
    from presswork.sources.store import append_store, latest_stored
    a = articles_fx(spark, sf)
    path = scratch_path(spark, "store")
    as_of = a.agg(F.max("published_at")).first()[0]
    for part in (0, 1):
        append_store(a.filter(f"arrival_id % 2 = {part}"), path)
    rows = report.latest_n(report.recent_window(latest_stored(spark, path, as_of, "7d", 25), as_of, "7d"), 25)
    return rows.select("pos", "arrival_id", "published_at", "title")


@register("trend_terms_stop_frame", _trend_sql("report", 10, "content").replace(", ".join(O.q(w) for w in R.STOPWORDS_REPORT), "SELECT DISTINCT lower(split_part(text, ' ', 1)) FROM documents"))
def q_trend_terms_stop_frame(spark, sf):
    """Trending terms without the first words of the documents, a stop list that grows with the data."""
    words = table(spark, sf, "documents").select(F.lower(F.substring_index("text", " ", 1)).alias("word"))
    return trends.trend_terms(articles_fx(spark, sf), "content", report.report_order_key(), "report", 10, stopwords=words)


def all_queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLE)
