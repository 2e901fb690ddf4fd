"""The article store: Parquet folders by publication date, listed by a manifest that is written last.

* ``append_store`` writes a batch to a folder of its own and publishes it.
* ``write_enrichment`` writes only rows whose enrichment changed, as a delta by arrival id; ``read_store`` joins the
  deltas when it reads. What a rule set has seen before is not evaluated again, so a run without news reads no texts.
* ``not_stored`` tells which rows of a batch are new, by an index of the stored keys in hash buckets: only the batch's
  own buckets and the batches since the last index run are read.
* ``fold_store`` merges the newest folders and the deltas in them, ``fold_index`` the keys of new batches, each with
  earlier ones no larger than twice themselves, so that a row is rewritten a logarithmic number of times.
* ``latest_stored`` leaves out dates that cannot hold one of the newest rows.
* ``report_sink`` and ``report_file`` write the Markdown report.

Arrival ids are dense: a batch is sorted by its arrival columns (a range-partitioned sort) and materialised; a row's id
is the first id of the batch, plus the rows in the partitions before its own, plus its place in its partition. The
first id follows the last one in the manifest. One ingest at a time; enrichment, folding and readers may run beside it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType, TimestampNTZType

from presswork.operators import enrich, summary
from presswork.operators.dedup import anti_existing
from presswork.operators.report import recent_window, window_start
from presswork.session import scratch_path
from presswork.sources import manifest
from presswork.sources.manifest import PLAIN, State, entry, extent, new_folder, publish

ARTICLE_SCHEMA = StructType([
    StructField("arrival_id", LongType(), False),
    StructField("source", StringType(), False),
    StructField("domain", StringType(), False),
    StructField("title", StringType(), False),
    StructField("url", StringType(), False),
    StructField("canonical_url", StringType(), True),
    StructField("published_at", TimestampNTZType(), True),
    StructField("content", StringType(), True),
    StructField("summary", StringType(), True),
    StructField("category", StringType(), True),
    StructField("severity", StringType(), True),
    StructField("soc_action", StringType(), True),
    StructField("dedupe_key", StringType(), False),
])
ARTICLE_COLUMNS = [f.name for f in ARTICLE_SCHEMA.fields]
STORE_SCHEMA = StructType(ARTICLE_SCHEMA.fields + [StructField("pub_date", DateType(), True)])
#: Article rows as stored: ``enr_version`` is the enrichment that is folded into a row.
DATA_SCHEMA = StructType(ARTICLE_SCHEMA.fields + [StructField("enr_version", LongType(), True), StructField("pub_date", DateType(), True)])
ENRICHED = ["category", "severity", "soc_action", "summary"]
DELTA_SCHEMA = "arrival_id bigint, version bigint, category string, severity string, soc_action string, summary string"
#: Columns whose values an ingest looks up, keys in one file of the index, and its most buckets.
KEYS = ("url", "dedupe_key")
INDEX_FILE_KEYS = 1 << 16
MAX_BUCKETS = 1 << 12
#: Rows since the last index run from which an ingest folds the index.
INDEX_EVERY = 1 << 20


def _folders(spark: SparkSession, path: str, entries: list, schema) -> DataFrame:
    """Rows of the folders of entries of one kind."""
    root = path.rstrip("/")
    own = [f"{root}/{e.folder}" for e in entries if e.folder != PLAIN]
    out = spark.createDataFrame([], schema)
    if own:  # the folders are partitions of one table
        out = spark.read.schema(schema).option("basePath", own[0].rpartition("/")[0]).parquet(*own).select(*out.columns)
    if len(own) < len(entries):
        plain = spark.read.schema(schema).option("basePath", root).parquet(f"{root}/pub_date=*")
        out = out.unionByName(plain) if own else plain
    return out


def _merged(spark: SparkSession, path: str, data: list, deltas: list) -> DataFrame:
    """Rows of data folders (``DATA_SCHEMA``) with their newest enrichment."""
    base = _folders(spark, path, data, DATA_SCHEMA)
    touching = [d for d in deltas if any(d.first_id < e.next_id and e.first_id < d.next_id for e in data)]
    if not touching:
        return base
    changes = _folders(spark, path, touching, DELTA_SCHEMA)
    result = F.struct("version", *ENRICHED)
    if len(touching) > 1:  # the newest for each row
        newest = changes.groupBy("arrival_id").agg(F.max_by(result, "version").alias("_new"))
    else:
        newest = changes.select("arrival_id", result.alias("_new"))
    newest = newest.withColumnRenamed("arrival_id", "_id")
    later = F.coalesce(F.col("_new.version") > F.coalesce("enr_version", F.lit(0)), F.lit(False))
    taken = {c: F.when(later, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in ENRICHED}
    taken["enr_version"] = F.when(later, F.col("_new.version")).otherwise(F.col("enr_version")).alias("enr_version")
    joined = base.join(newest, F.col("arrival_id") == F.col("_id"), "left")
    return joined.select(*[taken.get(c, F.col(c)) for c in base.columns])


def _dated(entries: list, since: dt.date | None) -> list:
    """Entries with rows that are undated or from ``since`` on."""
    return [e for e in entries if since is None or any(d.pub_date is None or d.pub_date >= since for d in e.dates or ())]


def read_store(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """The stored articles plus the ``pub_date`` partition column (empty frame when nothing was written yet).

    ``since``: leave out folders without undated rows or rows from that date on (a filter on ``pub_date`` or
    ``published_at`` prunes the rest)."""
    st = manifest.state(spark, path)
    return _merged(spark, path, _dated(st.of("data"), since), st.of("delta")).select(*STORE_SCHEMA.names)


def latest_stored(spark: SparkSession, path: str, as_of, since: str, n: int) -> DataFrame:
    """Stored rows that hold the newest ``n`` of the window: whole dates, newest first, until their rows suffice.

    The manifest counts the rows of each date, so the dates that are read are known before anything is read. The
    window's first date may lie in it only in part and is not counted; undated rows come last in a report, so that they
    are read only when the dated ones are too few."""
    st = manifest.state(spark, path)
    first = _at(spark, window_start(as_of, since)).date()
    per_date: dict = {}
    for e in st.of("data"):
        for d in e.dates or ():
            per_date[d.pub_date] = per_date.get(d.pub_date, 0) + d.n
    sure = 0
    for day in sorted((d for d in per_date if d is not None and d > first), reverse=True):
        sure += per_date[day]
        if sure >= n:
            holds = [e for e in st.of("data") if any(d.pub_date is not None and d.pub_date >= day for d in e.dates or ())]
            rows = _merged(spark, path, holds, st.of("delta")).select(*STORE_SCHEMA.names)
            return rows.filter(F.col("pub_date") >= F.lit(day))
    return recent_window(read_store(spark, path, first), as_of, since)


def next_arrival_id(spark: SparkSession, path: str) -> int:
    """The id after the largest one given out."""
    return manifest.state(spark, path).next_id


def assign_arrival_ids(batch: DataFrame, first_id: int, order: list[str]) -> DataFrame:
    """``batch`` with dense ids from ``first_id`` on, in arrival order. The sorted batch is written to the
    shared scratch folder once, so ids are never recomputed."""
    spark = batch.sparkSession
    place = F.monotonically_increasing_id()
    path = scratch_path(spark, "batch")
    batch.orderBy(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_at", place).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ids = F.lit(first_id) + F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(starts, F.col("_part") == F.col("_p")).withColumn("arrival_id", ids).drop("_at", "_part", "_p", "_start")


def insert_batch(fresh: DataFrame, store_path: str, order: list[str]) -> DataFrame:
    """Append the rows of a batch with new arrival ids; returns what was inserted."""
    spark = fresh.sparkSession
    rows = assign_arrival_ids(fresh, next_arrival_id(spark, store_path), order)
    append_store(rows, store_path)
    st = manifest.state(spark, store_path)
    if sum(e.n for e in st.of("data") if e.seq > st.indexed) >= INDEX_EVERY:
        fold_index(spark, store_path)
    return rows


def _put(rows: DataFrame, path: str) -> tuple[str, dict]:
    """Write article rows (``DATA_SCHEMA`` without the date) to a new folder; its name and extent. A rebalance by date
    keeps the files few; a date with many rows is split over several tasks."""
    spark, folder = rows.sparkSession, new_folder("data")
    target = f"{path.rstrip('/')}/{folder}"
    dated = rows.withColumn("pub_date", F.to_date("published_at"))
    dated.hint("rebalance", "pub_date").write.partitionBy("pub_date").parquet(target)
    return folder, extent(spark.read.schema(DATA_SCHEMA).parquet(target))


def append_store(batch: DataFrame, path: str) -> None:
    """Append article rows (``ARTICLE_SCHEMA`` columns): a folder of its own, then the commit. An empty batch makes none."""
    spark = batch.sparkSession
    folder, size = _put(batch.select(*ARTICLE_COLUMNS, F.lit(0).cast("bigint").alias("enr_version")), path)
    st = manifest.state(spark, path)
    adopted = [] if st.listed else st.entries
    if size["n"] or adopted:
        publish(spark, path, *adopted, entry("data", folder, seq=st.seq + 1, **size))


def fold_store(spark: SparkSession, path: str, everything: bool = False) -> bool:
    """Merge the newest folders, each with earlier ones of no more than twice the rows so far (or all), and put the
    enrichment into their rows; deltas that touch nothing else go. False if there was nothing to merge."""
    st = manifest.state(spark, path)
    taken, n = [], 0
    for e in sorted(st.of("data"), key=lambda e: -e.seq):
        if taken and e.n > 2 * n and not everything:
            break
        taken.append(e)
        n += e.n
    rest = [e for e in st.of("data") if e not in taken]
    inside = [d for d in st.of("delta") if all(d.next_id <= e.first_id or e.next_id <= d.first_id for e in rest)]
    if not taken or len(taken) < 2 and not inside:
        return False
    folder, size = _put(_merged(spark, path, taken, st.of("delta")).drop("pub_date"), path)
    publish(spark, path, *([] if st.listed else st.entries),
            entry("data", folder, seq=max(e.seq for e in taken), version=st.version, replaces=[e.folder for e in taken + inside], **size))
    return True


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def fold_index(spark: SparkSession, path: str) -> bool:
    """Put the keys of batches since the last index run into a new run, merged with earlier runs of no more than twice
    its keys. A run is partitioned by the hash of the key, about ``INDEX_FILE_KEYS`` keys to a bucket."""
    st = manifest.state(spark, path)
    recent = [e for e in st.of("data") if e.seq > st.indexed]
    if not recent:
        return False
    n, merged = sum(e.n for e in recent), []
    for run in sorted(st.of("index"), key=lambda e: -e.seq):
        if run.n > 2 * n:
            break
        merged.append(run)
        n += run.n
    buckets = min(MAX_BUCKETS, 1 << max(0, (n - 1) // INDEX_FILE_KEYS).bit_length())
    rows = _folders(spark, path, recent, DATA_SCHEMA)
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("key")) for k in KEYS])).alias("p")).select("p.*")
    for run in merged:
        pairs = pairs.unionByName(_index_run(spark, path, run).select("name", "key"))
    folder = new_folder("index")
    out = pairs.filter("key IS NOT NULL").withColumn("bucket", _bucket("key", buckets))
    out.hint("rebalance", "name", "bucket").write.partitionBy("name", "bucket").parquet(f"{path.rstrip('/')}/{folder}")
    publish(spark, path, *([] if st.listed else st.entries),
            entry("index", folder, n=n, seq=max(e.seq for e in recent), buckets=buckets, replaces=[r.folder for r in merged]))
    return True


def _index_run(spark: SparkSession, path: str, run) -> DataFrame:
    return spark.read.schema("key string, name string, bucket int").parquet(f"{path.rstrip('/')}/{run.folder}")


def stored_keys(spark: SparkSession, path: str, batch: DataFrame, key: str = "url", st: State | None = None) -> DataFrame:
    """Stored keys among which all of a batch's stored keys are: of each index run the buckets that the batch's keys fall
    into (the driver sees bucket numbers, at most ``MAX_BUCKETS``), and the keys of batches since."""
    st = st or manifest.state(spark, path)
    out = _folders(spark, path, [e for e in st.of("data") if e.seq > st.indexed], DATA_SCHEMA).select(key)
    touched: dict[int, list[int]] = {}
    for run in st.of("index"):
        if run.buckets not in touched:
            touched[run.buckets] = sorted(r[0] for r in batch.filter(F.col(key).isNotNull()).select(_bucket(key, run.buckets)).distinct().collect())
        own = _index_run(spark, path, run).filter(F.col("name") == key)
        if len(touched[run.buckets]) < run.buckets:
            own = own.filter(F.col("bucket").isin(touched[run.buckets]))
        out = out.unionByName(own.select(F.col("key").alias(key)))
    return out


def not_stored(batch: DataFrame, path: str, key: str = "url") -> DataFrame:
    """Rows of a batch whose key is not in the store: an exact anti-join with the keys that may be the batch's."""
    return anti_existing(batch, stored_keys(batch.sparkSession, path, batch, key), key)


def update_enrichment(store: DataFrame, as_of, since: str = "24h", summarizer=None, **rules) -> DataFrame:
    """Window rows get category/severity/action (overwritten) and a summary where empty;
    other rows pass unchanged. One pass over ``store``, no shuffle."""
    win = F.col("published_at").isNull() | (F.col("published_at") >= window_start(as_of, since))
    # the rules are projected once, and what is made of their results afterwards, so that no rule is tested twice
    # and the generated code stays small
    staged = store.withColumn("_win", F.coalesce(win, F.lit(False)))
    exprs = enrich.enrich_a_columns(**rules)
    staged = staged.withColumns({"_cat": exprs["category"], "_score": exprs["severity_score"]}).withColumn("_sev", enrich.severity_label("_score"))
    made = {"category": F.col("_cat"), "severity": F.col("_sev"), "soc_action": enrich.soc_action_a("_cat", "_sev")}
    cols = [F.when(F.col("_win"), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in store.columns]
    return summary.enrich_summary(staged.select(*cols, "_win"), only=F.col("_win"), summarizer=summarizer).drop("_win")


def affected_partitions(store: DataFrame, as_of, since: str = "24h") -> DataFrame:
    """Rows of the date partitions a window touches (undated partition included); the partition predicate prunes the scan."""
    start = F.to_date(window_start(as_of, since))
    return store.filter(F.col("pub_date").isNull() | (F.col("pub_date") >= start))


def rules_id(summarizer=None, **rules) -> str:
    """A name for a rule set and summariser: equal ones have the same; a plug-in that cannot be named gets a new one."""
    try:
        made = cloudpickle.dumps((summarizer, sorted(rules.items())))
    except Exception:  # a plug-in may hold what cannot be pickled; it is then never taken for another
        return uuid.uuid4().hex
    return hashlib.sha256(made).hexdigest()


def write_enrichment(spark: SparkSession, store_path: str, as_of, since: str = "24h", out_path: str | None = None,
                     summarizer=None, **rules) -> int:
    """Enrich the window and return the number of its rows.

    Rows that no run with the same rules has seen are evaluated; those whose enrichment differs from the stored one are
    written as a delta, which readers join, and the run is published. Rows appended meanwhile are left to the next run.
    ``out_path`` given: instead, a plain folder with the enriched rows of every touched date.
    """
    st = manifest.state(spark, store_path)
    start = _at(spark, window_start(as_of, since))
    data = _dated(st.of("data"), start.date())
    if out_path is not None:
        old = affected_partitions(_merged(spark, store_path, data, st.of("delta")), as_of, since)
        upd = update_enrichment(old, as_of, since, summarizer, **rules)
        (upd.select(*ARTICLE_COLUMNS, "pub_date").hint("rebalance", "pub_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("pub_date").parquet(out_path))
    window = lambda entries: recent_window(_merged(spark, store_path, entries, st.of("delta")), as_of, since)
    seen = recent_window(_folders(spark, store_path, data, DATA_SCHEMA).select("published_at", "pub_date"), as_of, since).count()
    if out_path is not None:
        return seen
    name = rules_id(summarizer, **rules)
    done = st.evaluated(name, start)
    todo = [e for e in data if e.seq > done]
    if not todo:
        return seen
    before = window(todo).select("*", *[F.col(c).alias(f"_{c}") for c in ENRICHED])
    # compared after the rules were applied: a column that is not a function of the row keeps the optimizer from putting
    # the rules into the comparison, where they would be tested again for every column
    upd = update_enrichment(before, as_of, since, summarizer, **rules).withColumn("_after", F.monotonically_increasing_id())
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ENRICHED]) & (F.col("_after") >= 0)
    folder, version = new_folder("delta"), st.version + 1
    target = f"{store_path.rstrip('/')}/{folder}"
    upd.filter(changed).select("arrival_id", F.lit(version).cast("bigint").alias("version"), *ENRICHED).write.parquet(target)
    n, low, high = spark.read.schema(DELTA_SCHEMA).parquet(target).agg(F.count(F.lit(1)), F.min("arrival_id"), F.max("arrival_id")).first()
    run = entry("run", None, rules=name, start=start, seq=st.seq, version=version)
    delta = [entry("delta", folder, n=n, first_id=low, next_id=high + 1, version=version)] if n else []
    publish(spark, store_path, *([] if st.listed else st.entries), *delta, run)
    return seen


def _at(spark: SparkSession, when) -> dt.datetime:
    """The value of a time column."""
    return spark.range(1).select(when.cast("timestamp_ntz")).first()[0]


def write_version(df: DataFrame, path: str) -> None:
    """Write a full table version to a new folder (never the folder being read)."""
    df.withColumn("pub_date", F.to_date("published_at")).write.mode("errorifexists").partitionBy("pub_date").parquet(path)


def report_sink(lines: DataFrame, path: str) -> None:
    """Write the (bounded) report lines in order as a single text file in a folder."""
    (lines.repartition(1).sortWithinPartitions("sec", "pos", "sub").select("line")
     .write.mode("overwrite").text(path))


def report_file(lines: DataFrame, path: str) -> None:
    """Write the (bounded) report lines in order as exactly the file ``path``.

    Spark writes them to a folder beside it; its one file is then renamed over an earlier report in one step, so that
    readers see the old or the new one. The folder goes."""
    spark = lines.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    stage = fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    report_sink(lines, stage.toString())
    conf = spark._jsc.hadoopConfiguration()
    context, local = fs.FileContext.getFileContext(target.toUri(), conf), target.getFileSystem(conf)
    (part,) = [f.getPath() for f in local.globStatus(fs.Path(stage, "part-*"))]
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, target, over)
    local.delete(stage, True)


__all__ = ["ARTICLE_SCHEMA", "read_store", "append_store", "assign_arrival_ids", "update_enrichment", "write_enrichment", "fold_store",
           "fold_index", "not_stored", "latest_stored", "write_version", "report_sink", "report_file", "recent_window"]
