"""Extractive summarisation as a Spark job.

Score of a sentence = sum of document-wide frequencies of its word tokens
(>= 3 chars) / sqrt(number of tokens); the top ``max_lines`` sentences
(ties: earlier sentence first) are emitted in document order, joined by
newlines. Empty text -> ''. Text without any word -> first 3 sentences
joined by a space. The normalisation by the document's maximum frequency
is a per-document constant and does not change the ranking, so integer
sums are ranked directly (deterministic across engines).

A document is scored inside its row: built-in functions cut it into
sentences and word tokens, an Arrow-batched function counts the batch's
tokens as integer codes and returns the best sentences. No text is
shuffled, rows need no id, and rows that need no summary send no text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions._util import col_of
from presswork.functions.text import clean_whitespace, tokens_alnum
from presswork.rules import SUMMARY_LINES

NO_WORD_SENTENCES = 3
#: Bytes of sentences and tokens that a Python worker gets at once; a batch of one row may be larger.
BATCH_BYTES = 8 << 20
#: Shuffle partitions for each scan partition where texts are cut into rows of tokens.
TOKEN_PARTITIONS = 16


def _bound_batches() -> None:
    """Arrow batches of the session are at most ``BATCH_BYTES``, whatever the number and length of the texts."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def term_freq(df: DataFrame, id_col: str, text_col: str, min_len: int = 3) -> DataFrame:
    """Per-document token frequency ``(id, term, cnt)`` and the document maximum ``max_cnt``."""
    toks = df.select(F.col(id_col), tokens_alnum(clean_whitespace(F.col(text_col)), min_len).alias("_terms"))
    # one exchange by id; the count and the maximum both run on it. Its partitions grow in number with the scan's, so that
    # a task's tokens do not grow with the table
    parts = max(df.sparkSession.sparkContext.defaultParallelism, TOKEN_PARTITIONS * df.rdd.getNumPartitions())
    toks = toks.repartition(parts, id_col).select(id_col, F.explode("_terms").alias("term"))
    tf = toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("cnt"))
    return tf.withColumn("max_cnt", F.max("cnt").over(Window.partitionBy(id_col)))


def _sentences(t: Column) -> Column:
    return F.filter(F.split(t, "(?<=[.!?]) "), lambda s: s != F.lit(""))


def _sentence_tokens(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: tokens_alnum(s))


def _best(tokens: pa.ListArray, k: int) -> list[np.ndarray]:
    """Per document (a list of token lists): its best ``k`` sentences' places, best first."""
    sentences = tokens.values
    words = sentences.values.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(sentences.values) else np.zeros(0, np.int64)
    ends = sentences.offsets.to_numpy()
    out = []
    for a, b in zip(tokens.offsets[:-1].to_pylist(), tokens.offsets[1:].to_pylist()):
        edges = ends[a: b + 1]
        sizes = np.diff(edges)
        on = np.flatnonzero(sizes)
        if not len(on):
            out.append(on)
            continue
        own = words[edges[0]: edges[-1]]
        _, place, count = np.unique(own, return_inverse=True, return_counts=True)
        sums = np.add.reduceat(count[place], edges[:-1][on] - edges[0])
        out.append(on[np.argsort(-(sums / np.sqrt(sizes[on])), kind="stable")[:k]])
    return out


def _whole(array: pa.Array) -> pa.ListArray:
    """A list array without nulls or an offset of its own."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return pa.concat_arrays([array]) if array.offset else array


def top_sentences(sentences: Column, k: int) -> Column:
    """Places (from 0) of the best ``k`` sentences of an array of sentences, best first."""

    @F.arrow_udf("array<int>")
    def places(tokens: pa.Array) -> pa.Array:
        return pa.array([x.tolist() for x in _best(_whole(tokens), k)], pa.list_(pa.int32()))

    _bound_batches()
    return places(_sentence_tokens(sentences))


def extractive(c, max_lines: int = SUMMARY_LINES) -> Column:
    """The extractive summary of a text column; null and empty texts give ''."""

    @F.arrow_udf("string")
    def summary(sentences: pa.Array, tokens: pa.Array) -> pa.Array:
        out = []
        for own, best in zip(sentences.to_pylist(), _best(_whole(tokens), max_lines)):
            out.append("\n".join(own[i] for i in sorted(best)).strip(" ") if len(best) else " ".join(own[:NO_WORD_SENTENCES]))
        return pa.array(out, pa.string())

    _bound_batches()
    sentences = _sentences(clean_whitespace(col_of(c)))
    return summary(sentences, _sentence_tokens(sentences))


def extractive_summary(df: DataFrame, id_col: str, text_col, max_lines: int = SUMMARY_LINES,
                       out_col: str = "summary", keep: list[str] | tuple = ()) -> DataFrame:
    """``(id, *keep, summary)`` for every row of ``df``, whatever its id."""
    return df.select(F.col(id_col), *keep, extractive(text_col, max_lines).alias(out_col))


def topk_sentences(df: DataFrame, id_col: str, text_col, k: int = SUMMARY_LINES) -> DataFrame:
    """Top-k sentences per document as rows ``(id, sent_idx, sentence, score_rank)``."""
    s = df.select(F.col(id_col), _sentences(clean_whitespace(col_of(text_col))).alias("_s"))
    return (s.select(F.col(id_col), "_s", top_sentences(F.col("_s"), k).alias("_top"))
            .select(F.col(id_col), "_s", F.posexplode("_top").alias("r", "i"))
            .select(F.col(id_col), F.col("i").cast("bigint").alias("sent_idx"), F.get("_s", F.col("i")).alias("sentence"),
                    (F.col("r") + 1).cast("bigint").alias("score_rank")))


def enrich_summary(df: DataFrame, max_lines: int = SUMMARY_LINES, only: Column | None = None, summarizer=None) -> DataFrame:
    """Fill ``summary`` where it is empty (and ``only`` holds), summarising content (else title).

    ``summarizer``: ``Column -> Column``; the extractive one by default. Rows that need no
    summary hand it a null and keep what they have; nothing is shuffled.
    """
    need = F.coalesce(F.col("summary"), F.lit("")) == ""
    if only is not None:
        need = need & F.coalesce(only, F.lit(False))
    src = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.col("content")).otherwise(F.col("title"))
    # the condition may hold a scalar subquery, which must stand in a column of its own
    staged = df.withColumn("_need", need).withColumn("_src", F.when(F.col("_need"), src))
    new = (summarizer or ExtractiveSummarizer(max_lines))(F.col("_src"))
    return staged.withColumn("summary", F.when(F.col("_need"), new).otherwise(F.col("summary"))).drop("_need", "_src")


class ExtractiveSummarizer:
    """The default summariser plug-in. A plug-in is any ``Column -> Column`` callable, built-in expressions
    or a ``pandas_udf`` alike; ``enrich_summary``, ``enrich_b`` and the daily run accept it."""

    def __init__(self, max_lines: int = SUMMARY_LINES):
        self.max_lines = max_lines

    def __call__(self, text: Column) -> Column:
        return extractive(text, self.max_lines)


class LeadSummarizer:
    """A plug-in that takes the first sentences of a text."""

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def __call__(self, text: Column) -> Column:
        return F.array_join(F.slice(_sentences(clean_whitespace(text)), 1, self.sentences), " ")
