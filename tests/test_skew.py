"""A third of all rows on one key: results stay whole and the hot key is reduced before the shuffle."""

from pyspark.sql import functions as F

from presswork.operators import dedup, trends


def test_hot_url_first_wins(spark):
    n = 30_000
    df = (spark.range(n).withColumn("url", F.when(F.col("id") % 3 == 0, F.lit("https://hot.example/x"))
                                    .otherwise(F.concat(F.lit("https://e.example/"), F.col("id").cast("string"))))
          .withColumn("source_ord", F.lit(0)).withColumn("entry_ord", F.col("id")))
    out = dedup.dedup_url(df)
    assert out.count() == 1 + (n - n // 3)
    assert out.filter(F.col("url") == "https://hot.example/x").first().entry_ord == 0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_term_counts_whole(spark):
    n = 9_000
    df = spark.range(n).select(F.col("id").alias("o"),
                               F.when(F.col("id") % 3 == 0, F.lit("hotterm alpha")).otherwise(F.lit("other words here")).alias("t"))
    got = {r.term: r.cnt for r in trends.trend_terms(df, "t", ["o"], "report", None).collect()}
    assert got == {"hotterm": n // 3, "alpha": n // 3, "other": n - n // 3, "words": n - n // 3, "here": n - n // 3}
