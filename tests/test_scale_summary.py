"""What a task or a Python worker holds does not grow with the table."""

from pyspark.sql import functions as F

from presswork.operators import summary


def test_python_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([(1, "One two. Three four four.")], "doc_id int, text string")
    assert summary.topk_sentences(df, "doc_id", "text", 1).first().sentence == "Three four four."
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == summary.BATCH_BYTES
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert df.select(summary.extractive("text", 1).alias("s")).first().s == "Three four four."
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == summary.BATCH_BYTES


def test_token_partitions_grow_with_the_scan(spark):
    df = spark.range(0, 40, 1, 20).select((F.col("id") % 7).alias("doc_id"), F.lit("red red blue").alias("text"))
    tf = summary.term_freq(df, "doc_id", "text")
    assert tf.rdd.getNumPartitions() >= 20 * summary.TOKEN_PARTITIONS
    assert {(r.doc_id, r.term, r.cnt, r.max_cnt) for r in tf.filter("doc_id < 2").collect()} == {
        (0, "red", 12, 12), (0, "blue", 6, 12), (1, "red", 12, 12), (1, "blue", 6, 12)}
