"""Results must not depend on how the input happens to be partitioned or ordered."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from presswork.functions import text as T
from presswork.operators import dedup, summary, trends
from presswork.operators.report import latest_n, report_order_key
from presswork.sources.tables import articles_fx


def shuffled(df, n, seed):
    return df.repartition(n).orderBy(F.rand(seed))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_permuting_partitions_changes_nothing(spark):
    a = articles_fx(spark, SF_SMALL).withColumn("source_ord", F.lit(0)).withColumn("entry_ord", F.col("arrival_id"))
    variants = [a, shuffled(a, 7, 1), shuffled(a, 3, 2)]
    firsts = [rows(dedup.dedup_url(v).select("url", "arrival_id")) for v in variants]
    assert firsts[0] == firsts[1] == firsts[2]
    tops = [rows(trends.trend_terms(v, "title", report_order_key(), "report", 10)) for v in variants]
    assert tops[0] == tops[1] == tops[2]
    lat = [rows(latest_n(v, 25).select("pos", "arrival_id")) for v in variants]
    assert lat[0] == lat[1] == lat[2]
    sums = [rows(summary.extractive_summary(v.select("arrival_id", "content"), "arrival_id", "content")) for v in variants[:2]]
    assert sums[0] == sums[1]


def test_nbsp_and_unicode_spaces(spark):
    df = spark.createDataFrame([("a  b c　 d​",)], "x string")
    assert df.select(T.clean_whitespace("x")).first()[0] == "a b c d​"   # U+200B is not whitespace
