"""Rule-based enrichment: categories, severity, SOC guidance.

Rule tables (see ``presswork.rules``) are compiled into a single
``CASE WHEN contains(..) OR .. THEN ..`` expression, so classification is
a narrow, whole-stage-codegen'd projection with no shuffle. The lowered
text is projected once and reused by every keyword test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork import rules as R
from presswork.functions._util import col_of
from presswork.functions.text import clamp_lines, html_to_text


def _any_contains(lowered: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in keywords])


def lowered(c) -> Column:
    return F.lower(F.coalesce(col_of(c), F.lit("")))


def categorize(text, rules: list[tuple[str, list[str]]] = R.CATEGORY_RULES_A,
               default: str = "general", already_lower: bool = False) -> Column:
    """First rule (in order) with any keyword as a substring of lower(text); else ``default``.

    One CASE expression (codegen'd, no shuffle) — right for rule tables of up
    to a few thousand keywords; for larger tables use :func:`categorize_by_join`.
    """
    t = col_of(text) if already_lower else lowered(text)
    out = None
    for label, kws in rules:
        cond = _any_contains(t, kws)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def severity_score(text, high: list[str] = R.SEVERITY_HIGH_A, med: list[str] = R.SEVERITY_MED_A,
                   w_high: int = R.SEVERITY_HIGH_WEIGHT, w_med: int = R.SEVERITY_MED_WEIGHT,
                   already_lower: bool = False) -> Column:
    """Sum of weights of keywords *present* (each counted once, overlaps add)."""
    t = col_of(text) if already_lower else lowered(text)
    terms = [F.when(F.contains(t, F.lit(k)), F.lit(w_high)).otherwise(F.lit(0)) for k in high]
    terms += [F.when(F.contains(t, F.lit(k)), F.lit(w_med)).otherwise(F.lit(0)) for k in med]
    return reduce(lambda a, b: a + b, terms, F.lit(0)).cast("int")


def severity_label(score, thresholds: list[tuple[int, str]] = R.SEVERITY_THRESHOLDS_A,
                   floor: str = R.SEVERITY_FLOOR) -> Column:
    s = col_of(score)
    out = None
    for th, label in thresholds:
        out = F.when(s >= th, F.lit(label)) if out is None else out.when(s >= th, F.lit(label))
    return F.lit(floor) if out is None else out.otherwise(F.lit(floor))


def severity_tier(text, tiers: list[tuple[str, list[str]]] = R.SEVERITY_TIERS_B,
                  default: str = "baja", already_lower: bool = False) -> Column:
    """First tier (in order) with any keyword present; else ``default``."""
    return categorize(text, tiers, default, already_lower)


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def action_lookup(category, table: dict[str, str] = R.SOC_ACTIONS_A,
                  default: str = R.SOC_ACTION_DEFAULT_A) -> Column:
    """Category -> guidance text, ``default`` when absent."""
    return _lookup(col_of(category), table, default)


def soc_action_a(category, severity) -> Column:
    """Category guidance + severity suffix."""
    suffix = _lookup(col_of(severity), R.SOC_SUFFIX_A, R.SOC_SUFFIX_DEFAULT_A)
    return F.concat(action_lookup(category), suffix)


def soc_action_b(category) -> Column:
    return action_lookup(category, R.SOC_ACTIONS_B, R.SOC_ACTION_DEFAULT_B)


def md_guidance(severity, line: int) -> Column:
    """Markdown guidance line 1 or 2, chosen by lower(severity) only."""
    s = F.lower(F.coalesce(col_of(severity), F.lit("")))
    out = None
    for labels, l1, l2 in R.MD_GUIDANCE:
        v = F.lit(l1 if line == 1 else l2)
        cond = s.isin(labels)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(F.lit(R.MD_GUIDANCE_DEFAULT[line - 1]))


def severity_rank(severity, strip: bool = False) -> Column:
    """critica/crítica 4, alta 3, media 2, baja 1, anything else 0 (case-insensitive)."""
    s = F.coalesce(col_of(severity), F.lit(""))
    if strip:
        s = F.trim(s)
    s = F.lower(s)
    out = None
    for k, v in R.SEVERITY_RANK.items():
        out = F.when(s == k, F.lit(v)) if out is None else out.when(s == k, F.lit(v))
    return out.otherwise(F.lit(0))


def rules_frame(spark, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Rule table as a (rule_ord, label, keyword) dimension frame."""
    rows = [(i, label, kw) for i, (label, kws) in enumerate(rules) for kw in kws]
    return spark.createDataFrame(rows, "rule_ord int, label string, keyword string")


#: Bytes of keywords that are sent to every task at once.
KEYWORD_BYTES = 16 << 20


def _gram_size(keyword: Column) -> Column:
    """Characters of a keyword's grams: one of any 2 * g - 1 characters in a row begins a gram of the text with g
    characters, and the gram lies among them. Up to 4."""
    n = F.char_length(keyword)
    return F.when(n == 0, 0).otherwise(F.least((n + 1).cast("int").bitwiseAND(-2) / 2, F.lit(4))).cast("int")


def _text_grams(text: Column, g: int) -> Column:
    """The different runs of g characters at every g-th place of a text."""
    return F.array(F.lit("")) if g == 0 else F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s).{{{g}}}"), 0))


def keyword_keys(keywords: DataFrame) -> DataFrame:
    """(keyword, gram, earlier): the grams that begin at the keyword's first g characters, and those before each."""
    g = _gram_size(F.col("keyword"))
    grams = F.when(g == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(g, F.lit(1))), lambda i: F.substring("keyword", i, g)))
    rows = keywords.select("keyword", grams.alias("_g")).select("keyword", "_g", F.posexplode("_g").alias("_i", "gram"))
    rows = rows.select("keyword", "gram", F.slice("_g", 1, F.col("_i")).alias("earlier"))
    return rows.filter(~F.array_contains("earlier", F.col("gram")))


def rule_match_join(df: DataFrame, id_col: str, text_col: str, rules) -> DataFrame:
    """Match evidence ``(id, rule_ord, label, keyword)``: which keywords of which rule occur.

    ``rules``: a list ``[(label, [keywords])]`` or a frame ``(rule_ord, label, keyword)``; both take the same way. A text is
    cut into grams of up to four characters, and these meet the grams of the keywords in a hash join: wherever a
    keyword lies in a text, one of its first grams lies at a cut. Only texts that hold such a gram are searched for the
    keyword, so that the work on a text does not grow with the number of keywords; of several grams that lead
    from a text to a keyword, the first one counts. The keywords are broadcast in blocks of at most about
    ``KEYWORD_BYTES``, one pass over the texts for each; texts are never shuffled. The hits then meet the rule table, in an
    equi-join. Null keywords match nothing, the empty keyword matches every text.
    """
    frame = rules if isinstance(rules, DataFrame) else rules_frame(df.sparkSession, rules)
    keywords = frame.select("keyword").filter("keyword IS NOT NULL").distinct()
    total, sizes = keywords.agg(F.coalesce(F.sum(4 * F.octet_length("keyword") + 64), F.lit(0)), F.collect_set(_gram_size(F.col("keyword")))).first()
    blocks = max(1, -(-total // KEYWORD_BYTES))
    keys = keyword_keys(keywords)
    docs = df.select(F.col(id_col).alias("_id"), lowered(text_col).alias("_lt"))
    own = F.concat(*[_text_grams(F.col("_lt"), g) for g in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    # an outer explode: of an inner one the optimizer infers a test of the array's size, for which the grams are made twice
    grams = docs.withColumn("_own", own).select("_id", "_lt", "_own", F.explode_outer("_own").alias("_gram"))
    first = ~F.arrays_overlap("_own", "earlier")
    hits = None
    for b in range(blocks):
        block = keys if blocks == 1 else keys.filter(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == b)
        met = grams.join(F.broadcast(block), F.col("_gram") == F.col("gram"))
        found = met.filter(F.contains("_lt", "keyword") & first).select("_id", F.col("keyword").alias("_kw"))
        hits = found if hits is None else hits.unionByName(found)
    return hits.join(frame, F.col("_kw") == F.col("keyword")).select(F.col("_id").alias(id_col), "rule_ord", "label", "keyword")


def rule_match_ngram(df: DataFrame, id_col: str, text_col: str, rules: DataFrame) -> DataFrame:
    """:func:`rule_match_join` with a rule frame."""
    return rule_match_join(df, id_col, text_col, rules)


def categorize_by_join(df: DataFrame, id_col: str, text_col: str,
                       rules: list[tuple[str, list[str]]] = R.CATEGORY_RULES_A,
                       default: str = "general") -> DataFrame:
    """Join form of :func:`categorize`: lowest matching rule per document, else default."""
    ev = rule_match_join(df, id_col, text_col, rules)
    best = ev.groupBy(id_col).agg(F.min(F.struct("rule_ord", "label")).alias("_b"))
    return (df.select(id_col).join(best, id_col, "left")
            .select(id_col, F.coalesce(F.col("_b.label"), F.lit(default)).alias("category")))


ENRICH_COLUMNS = ["category", "severity_score", "severity", "soc_action"]


def enrich_a_columns(categories=R.CATEGORY_RULES_A, high=R.SEVERITY_HIGH_A, med=R.SEVERITY_MED_A) -> dict[str, Column]:
    """The live enrichment as plain expressions over ``title``/``content``."""
    lt = lowered("title")
    ls = F.lower(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("\n"), F.coalesce(F.col("content"), F.lit(""))))
    cat = categorize(lt, categories, already_lower=True)
    score = severity_score(ls, high, med, already_lower=True).cast("bigint")
    sev = severity_label(score)
    return {"category": cat, "severity_score": score, "severity": sev, "soc_action": soc_action_a(cat, sev)}


def enrich_a(df: DataFrame, categories: list[tuple[str, list[str]]] = R.CATEGORY_RULES_A,
             high: list[str] = R.SEVERITY_HIGH_A, med: list[str] = R.SEVERITY_MED_A) -> DataFrame:
    """Live enrichment: category (title), severity (title + '\\n' + content), action.

    One projection: the repeated ``lower(...)`` and score sub-expressions are
    shared by codegen's subexpression elimination, and a single Project keeps
    ``orderBy().limit()`` + enrichment planned as a top-K
    (``TakeOrderedAndProject``) that enriches only the kept rows.
    """
    exprs = enrich_a_columns(categories, high, med)
    keep = [c for c in df.columns if c not in exprs]
    return df.select(*keep, *[e.alias(n) for n, e in exprs.items()])


def enrich_b(df: DataFrame, raw_col: str = "content", summarizer=None,
             categories: list[tuple[str, list[str]]] = R.CATEGORY_RULES_B,
             tiers: list[tuple[str, list[str]]] = R.SEVERITY_TIERS_B) -> DataFrame:
    """Second enrichment: html->text, (summarise), clamp 5 lines, rules B over title + summary.

    ``summarizer``: a plug-in ``Column -> Column`` applied to the cleaned text, such as
    ``summary.ExtractiveSummarizer()``; without one the cleaned text itself is clamped.
    """
    clean = html_to_text(F.col(raw_col))
    raw_summary = summarizer(clean) if summarizer is not None else clean
    out = df.withColumn("summary", clamp_lines(html_to_text(raw_summary), R.SUMMARY_LINES))
    basis = F.lower(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.col("summary")))
    return (out.withColumn("_lb", basis)
            .withColumn("category", categorize("_lb", categories, already_lower=True))
            .withColumn("severity", severity_tier("_lb", tiers, already_lower=True))
            .withColumn("soc_reco", soc_action_b("category"))
            .drop("_lb"))
