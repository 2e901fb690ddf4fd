"""Crawl-admission filter over URL tables.

Rules are an input table ``(host, rule_ord, allow, path_prefix)``, one
group of ordered rules per host (the parsed robots files). A URL is
admitted by the first rule (lowest ``rule_ord``) of its host whose prefix
starts its path (path + '?query'); with no matching rule it is admitted.

Plan: the rules become one ordered array per host (as long as that host's
robots file) and one equi-join on ``host`` puts it beside each URL; the
first rule whose prefix fits decides inside the row. The rules table grows
with the number of hosts, so no broadcast is forced: AQE broadcasts it when
it is small and splits a hot host's URLs when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions.urls import URL_PARTS, get_domain

RULES_SCHEMA = "host string, rule_ord int, allow boolean, path_prefix string"


def rules_frame(spark, rules: list[tuple[str, int, bool, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def percent_decode(c) -> F.Column:
    """Decode %XX escapes only ('+' stays '+'); undecodable text is kept as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def url_path(url) -> F.Column:
    """Decoded path + '?query' of a URL ('/' when empty): the form rule prefixes are compared in."""
    u = F.coalesce(url, F.lit(""))
    path = F.regexp_extract(u, URL_PARTS, 4)
    query = F.regexp_extract(u, URL_PARTS, 5)
    p = percent_decode(F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))
    return F.when(p == "", F.lit("/")).otherwise(p)


def robots_allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` + ``allowed``. Every row is judged by itself: repeated rows and nulls in any column stay as they are."""
    host, path, own_host, own = fresh_names(urls, "_host", "_path", "_rhost", "_rules")
    ordered = rules.filter(F.col("path_prefix").isNotNull()).groupBy(F.lower("host").alias(own_host)).agg(
        F.sort_array(F.collect_list(F.struct("rule_ord", "allow", "path_prefix"))).alias(own))
    u = urls.withColumn(host, get_domain(F.col(url_col))).withColumn(path, url_path(F.col(url_col)))
    hits = F.filter(F.col(own), lambda r: F.startswith(F.col(path), r["path_prefix"]))
    verdict = F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))
    j = u.join(ordered, F.col(host) == F.col(own_host), "left")
    return j.select(*[F.col(c) for c in urls.columns], verdict.alias("allowed"))


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of ``df`` has."""
    used = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem in used:
            stem += "_"
        out.append(stem)
    return out


def robots_filter(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Only the admitted URLs."""
    return robots_allowed(urls, rules, url_col).filter("allowed").drop("allowed")


def rules_for_agent(robots: DataFrame, user_agent: str, host_col: str = "host", body_col: str = "body") -> DataFrame:
    """Landed robots files ``(host, body)`` -> the rules table that applies to ``user_agent``.

    Record grammar: ``User-agent`` lines open an entry, ``Allow``/``Disallow``
    lines add ordered rules (``Crawl-delay``/``Request-rate`` count as rule
    lines for grouping), an empty line closes the entry, ``#`` starts a
    comment, and an entry without rule lines is dropped. The first entry
    whose agent name occurs in our agent token (the part before '/',
    lower-cased) applies; otherwise the first ``*`` entry; otherwise nothing
    (everything allowed). An empty ``Disallow`` allows all.

    Each host's lines are ordered and grouped with windows partitioned by
    host, so no group exceeds one robots file.
    """
    token = user_agent.split("/")[0].lower()
    lines = robots.select(F.lower(F.col(host_col)).alias("host"),
                          F.posexplode(F.split(F.coalesce(F.col(body_col), F.lit("")), r"\r\n|\r|\n")).alias("n", "raw"))
    text = F.trim(F.regexp_replace(F.col("raw"), "#.*$", ""))
    key = F.lower(F.trim(F.substring_index(text, ":", 1)))
    val = F.trim(F.substr(text, F.instr(text, ":") + 1))
    kind = (F.when(F.col("raw") == "", F.lit("B"))
            .when(~text.contains(":"), F.lit(None))
            .when(key == "user-agent", F.lit("U"))
            .when(key.isin("allow", "disallow"), F.lit("R"))
            .when(key.isin("crawl-delay", "request-rate"), F.lit("C")))
    tok = (lines.select("host", "n", kind.alias("kind"), key.alias("key"),
                        percent_decode(val).alias("value"))
           .filter(F.col("kind").isNotNull()))
    w = Window.partitionBy("host").orderBy("n")
    prev = F.lag("kind").over(w)
    starts = (F.col("kind") == "B") | ((F.col("kind") == "U") & (prev.isNull() | (prev != "U")))
    tok = tok.withColumn("blk", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a block that starts with a user-agent line and holds a rule line is an entry
    blocks = tok.groupBy("host", "blk").agg(
        F.min_by("kind", "n").alias("first_kind"),
        F.max((F.col("kind") != "U").cast("int")).alias("has_rules"),
        F.collect_list(F.when(F.col("kind") == "U", F.lower("value"))).alias("agents"))
    entries = blocks.filter((F.col("first_kind") == "U") & (F.col("has_rules") == 1))
    is_star = F.array_contains("agents", "*")
    matches = F.exists("agents", lambda a: F.lit(token).contains(a))
    pick = entries.select("host", "blk", F.when(~is_star & matches, F.lit(0)).when(is_star, F.lit(1)).alias("pref"))
    chosen = (pick.filter(F.col("pref").isNotNull())
              .groupBy("host").agg(F.min(F.struct("pref", "blk")).alias("c"))
              .select("host", F.col("c.blk").alias("blk")))
    rules = tok.filter(F.col("key").isin("allow", "disallow")).join(chosen, ["host", "blk"])
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    return rules.select("host", F.col("n").cast("int").alias("rule_ord"), allow.alias("allow"),
                        F.col("value").alias("path_prefix"))
