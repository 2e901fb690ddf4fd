"""Trending terms: three tokenisation variants, one aggregation.

Counting is a partial + final hash aggregate on the term (map-side
combine pre-aggregates hot terms), ties go to the term seen first in input
order — ``min(struct(row order…, token position))`` is carried through the
same aggregate — and the top-N is a ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork import rules as R
from presswork.functions.text import strip_token, tokens_alnum, tokens_ws

VARIANTS = ("report", "md", "regex")


def _exploded(df: DataFrame, tokens, name: str) -> DataFrame:
    """A row for each token with its place. An outer explode: of an inner one the optimizer infers a test of the array's
    size below it, for which every text would be cut into tokens twice."""
    return df.select("*", F.posexplode_outer(tokens).alias("_pos", name)).filter(F.col(name).isNotNull())


#: Words that a variant leaves out unless others are given.
STOPWORDS = {"report": R.STOPWORDS_REPORT, "md": R.STOPWORDS_MD, "regex": R.STOPWORDS_REGEX}


def stopword_filter(terms: DataFrame, stopwords, term_col: str = "term") -> DataFrame:
    """Rows whose term is no stop word. ``stopwords``: a list or a frame whose first column holds the words.

    An anti-join with the distinct words; whether these are broadcast is left to their size at run time. Null terms stay,
    null words and repeated ones change nothing."""
    if not isinstance(stopwords, DataFrame):
        stopwords = terms.sparkSession.createDataFrame([(w,) for w in stopwords], "word string")
    words = stopwords.select(F.col(stopwords.columns[0]).alias("_word")).distinct()
    return terms.join(words, F.col(term_col) == F.col("_word"), "left_anti")


def _tokens(df: DataFrame, text_col: str, variant: str, min_len: int):
    if variant == "regex":
        toks = tokens_alnum(F.col(text_col), min_len)
        return _exploded(df, toks, "term")
    raw = _exploded(df, tokens_ws(F.col(text_col)), "_raw")
    if variant == "md":
        # length tested on the raw token, punctuation stripped afterwards
        t = raw.filter(F.char_length("_raw") >= min_len).withColumn("term", strip_token(F.col("_raw")))
        return t.filter(F.col("term") != "")
    if variant == "report":
        t = raw.withColumn("term", strip_token(F.col("_raw")))
        return t.filter(F.char_length("term") >= min_len)
    raise ValueError(f"unknown trend variant {variant!r}; expected one of {VARIANTS}")


def trend_terms(df: DataFrame, text_col: str, order: list, variant: str = "report",
                n: int | None = R.TREND_N, min_len: int = 4, stopwords=None) -> DataFrame:
    """Top-``n`` terms ``(rank, term, cnt)`` by count desc, ties to first appearance.

    ``order``: ascending key columns (names or Columns) giving the input row
    order, e.g. :func:`presswork.operators.report.report_order_key`.
    ``n=None`` returns every term as ``(term, cnt)``, globally sorted the same
    way (a range-partitioned sort; no single-partition step).
    ``stopwords``: a list or frame of words to leave out in place of the variant's own, of any size: counted terms,
    of which there are fewer than tokens, meet it in an anti-join (:func:`stopword_filter`).
    """
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)]
    toks = _tokens(df.select(text_col, *keys), text_col, variant, min_len)
    if stopwords is None:
        toks = toks.filter(~F.col("term").isin(STOPWORDS[variant]))
    first = F.struct(*[F.col(f"_o{i}") for i in range(len(keys))], F.col("_pos"))
    agg = toks.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"), F.min(first).alias("_first"))
    if stopwords is not None:
        agg = stopword_filter(agg, stopwords)
    by = [F.col("cnt").desc(), F.col("_first").asc()]
    if n is None:
        return agg.orderBy(*by).select("term", "cnt")
    top = agg.orderBy(*by).limit(int(n))
    # at most n rows remain: a single-partition rank is bounded
    return top.select(F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("rank"), "term", "cnt")


def trends_line(trends: DataFrame) -> DataFrame:
    """One-row Markdown rendering: ```term`(cnt), ...`` or ``(sin datos)``."""
    items = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("`"), "term", F.lit("`("),
                                                                   F.col("cnt").cast("string"), F.lit(")")).alias("s"))))
    line = F.array_join(F.transform(items, lambda e: e["s"]), ", ")
    return trends.agg(F.when(F.count(F.lit(1)) > 0, line).otherwise(F.lit("(sin datos)")).alias("line"))
