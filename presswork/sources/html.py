"""Anchor extraction from landed HTML pages (a Spark column job, no parser library).

Comments and the content of scripts, styles and templates are removed
first; then anchors are matched (case-insensitive, across lines). A tag ends at the first ``>`` outside a quoted
attribute value. An anchor ends at its ``</a>``, or, if it has none, where the next anchor begins or the page ends.

Selectors: ``a`` (all anchors), ``a.<class>`` and ``a#<id>``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions._util import col_of, lit_str
from presswork.functions.text import clean_whitespace, html_unescape
from presswork.functions.urls import canonicalize_url, dedupe_key, get_domain, resolve_link

# attributes: everything up to a '>' that is not in a quoted value
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# an anchor's tag and what lies in it
ANCHOR_RE = rf"(?i)<a(?=[\s/>]){ATTRS}>[^<]*+(?:<(?!/?a[\s/>])[^<]*+)*+"
OPEN_ATTRS_RE = rf"(?i)^<a({ATTRS})>"
# the value of href with its opening quote; where there are several, the first
HREF_RE = r"""(?i)(?:^|\s)href\s*=\s*("[^"]*|'[^']*|[^\s"'>]+)"""
COMMENT_RE = r"(?s)<!--.*?(-->|$)"
SCRIPT_RE = r"(?is)<(?:script\b.*?(?:</script\s*>|$)|style\b.*?(?:</style\s*>|$)|template\b.*?(?:</template\s*>|$))"
MARKUP_RE = r"<[A-Za-z/!?][^>]*>"




def anchor_text(inner) -> Column:
    """Visible text of an element: markup -> ' ', entities decoded, whitespace cleaned."""
    x = F.regexp_replace(col_of(inner), lit_str(COMMENT_RE), F.lit(" "))
    x = F.regexp_replace(x, lit_str(MARKUP_RE), F.lit(" "))
    return clean_whitespace(html_unescape(x))


def _selector_filter(attrs: Column, selector: str) -> Column | None:
    m = re.fullmatch(r"a?(?:([.#])([A-Za-z0-9_-]+))?", selector.strip())
    if not m:
        raise NotImplementedError(f"unsupported selector {selector!r}: use a, a.<class> or a#<id>")
    kind, name = m.group(1), m.group(2)
    if kind is None:
        return None
    attr = "class" if kind == "." else "id"
    pat = rf"""(?is)(?:^|\s){attr}\s*=\s*["']?([^"'>]*\s)?{re.escape(name)}(\s[^"'>]*)?["'\s>]"""
    return F.concat(attrs, F.lit(">")).rlike(pat)


def scan_html_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html", selector: str = "a", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(page id, *keep, page_url, link_ord, href, title)`` for each selected anchor, in document order."""
    live = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), lit_str(COMMENT_RE), F.lit(" "))
    live = F.regexp_replace(live, lit_str(SCRIPT_RE), F.lit(" "))
    a = pages.select(F.col(id_col), *keep, F.col(url_col).alias("page_url"),
                     F.posexplode_outer(F.regexp_extract_all(live, lit_str(ANCHOR_RE), 0)).alias("link_ord", "_a")).filter(F.col("_a").isNotNull())
    a = a.withColumn("_attrs", F.regexp_extract(F.col("_a"), OPEN_ATTRS_RE, 1))
    cond = _selector_filter(F.col("_attrs"), selector)
    if cond is not None:
        a = a.filter(cond)
    a = a.withColumn("_value", F.regexp_extract("_attrs", HREF_RE, 1))
    href = F.when(F.left("_value", F.lit(1)).isin('"', "'"), F.substring("_value", 2, 1 << 30)).otherwise(F.col("_value"))
    # the anchor without its tag: what comes before the text is as long as the tag's name, attributes and two brackets
    inner = F.substr("_a", F.char_length("_attrs") + 4)
    return a.select(F.col(id_col), *keep, "page_url", F.col("link_ord").cast("bigint").alias("link_ord"),
                    html_unescape(href).alias("href"), anchor_text(inner).alias("title"))


def links_to_items(links: DataFrame, source: str | Column = "html", source_ord: int | Column = 0) -> DataFrame:
    """Anchor rows -> article items: drop empty href/title, resolve root-relative links,
    keep http(s) only, canonical URL, domain and undated key. Items of a page are ordered by
    (doc_ord, entry_ord), the page's id and the anchor's place."""
    src = F.lit(source) if isinstance(source, str) else source
    x = links.filter((F.col("href") != "") & (F.col("title") != ""))
    x = x.withColumn("_link", resolve_link(F.col("href"), F.col("page_url"))).filter(F.col("_link").startswith("http"))
    x = x.withColumn("url", canonicalize_url(F.col("_link")))
    return x.select(
        src.alias("source"),
        get_domain(F.col("url")).alias("domain"),
        F.left(F.col("title"), F.lit(400)).alias("title"),
        "url",
        F.lit(None).cast("timestamp_ntz").alias("published_at"),
        dedupe_key(F.col("title"), get_domain(F.col("url"))).alias("dedupe_key"),
        (source_ord if isinstance(source_ord, Column) else F.lit(source_ord)).cast("int").alias("source_ord"),
        F.col("page_id").cast("bigint").alias("doc_ord"), F.col("link_ord").cast("bigint").alias("entry_ord"),
    )
