"""Mixing sources to target weights by capped water-filling.

1. Every source gets its weight's share of the budget. Sources whose share exceeds ``max_epochs`` times their size
   are clamped there and the excess is shared among the others by weight; this repeats until no share is above its
   cap. A round is one aggregate over the table of sources.
2. A source whose target is ``e`` times its size plus a rest takes every document ``e`` times (whole repetitions)
   and, once more, documents worth the rest (the fractional repetition), chosen by a seeded hash order: the hash
   range is cut into buckets, buckets below the rest are taken whole, and the documents of the one bucket that the
   rest ends in are taken first fit in hash order, and a few of them are chosen anew so that the sum comes near.

A document is taken a whole number of times. Only (source, key, size) rows are shuffled, a hot source spreads over
its buckets, and reruns agree because all choices come from hashes of the key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import fresh, word_count, written

MAX_EPOCHS = 3.0
SEED = 20
#: A bucket of the hash range holds about this many documents, or the square root of the source's count if larger.
ROWS_PER_BUCKET = 1000
#: Documents on either side of a source's cut that are chosen anew.
POOL = 9
CYCLE = (5.0, 2.0, 1.0)


def cycled_weights(sources: DataFrame, source: str, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, weight): the weights of ``cycle`` in turn, sources by code point, null last.

    One row per distinct source is numbered, not one per document.
    """
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.select(source).distinct().select(source, F.get(weights, F.pmod(place, F.lit(len(cycle)))).alias("weight"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (total, weight, ...) with ``target``: the share of ``budget``, at most ``max_epochs * total``.

    Sources of weight 0 get nothing. When every source is at its cap, the targets add up to less than the budget.
    """
    total, weight = F.col("total").cast("double"), F.col("weight")
    cap = total * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = weight * F.lit(level) >= cap if clamped >= 0 else F.lit(False)
        s = sources.agg(F.sum(F.when(full, 0.0).otherwise(weight)).alias("free"),
                        F.sum(F.when(full, cap).otherwise(0.0)).alias("used"),
                        F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if s["n"] is None or s["n"] == clamped:
            break
        clamped = s["n"]
        if not s["free"]:
            return sources.withColumn("target", F.when(weight > 0, cap).otherwise(0.0))
        level = (budget - s["used"]) / s["free"]
    return sources.withColumn("target", F.least(cap, weight * F.lit(level)))


def _first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The units of one source's last bucket that its rest has room for (see the module's text)."""
    pdf = pdf.sort_values(["_h", "_key", "_size"], kind="stable")
    room, taken, left = float(pdf["_room"].iloc[0]), [], []
    sizes = pdf["_unit"].to_numpy()
    for i, size in enumerate(sizes):
        if size <= room:
            taken.append(i)
            room -= size
        else:
            left.append(i)
    if left and room > 0:
        # of all ways to choose again among the last that were taken and the first that were not, the nearest
        pool = taken[-POOL:] + left[:POOL]
        sums = np.zeros(1)
        for i in pool:
            sums = np.concatenate((sums, sums + sizes[i]))
        best = int(np.argmin(np.abs(sums - (room + sizes[taken[-POOL:]].sum()))))
        taken = [*taken[:-POOL], *(i for bit, i in enumerate(pool) if best >> bit & 1)]
    return pdf.iloc[sorted(taken)][["_source", "_key", "_size"]]


def plan(df: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text",
         weights=cycled_weights, budget: float | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
         rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per row of ``df``: key, source, size, source_size, target (its source's), times (whole repetitions).

    ``size`` defaults to the words of ``text`` (null: 0); ``budget`` to the sum of all sizes. ``weights`` maps the
    table of sources to (source, weight). A null source is a source of its own; documents without words are taken
    as often as their source's whole repetitions; rows that repeat a key with the same source and size are one
    unit and taken together; an empty table gives an empty result. Other columns are not returned.
    """
    size = word_count(F.col(text)) if size is None else size
    sized = df.select(F.col(source).alias("_source"), F.col(key).alias("_key"), size.cast("long").alias("_size"))
    sized = sized.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_key")))
    sized = written(sized, "mix-sizes")
    stats = written(sized.groupBy("_source").agg(F.sum("_size").alias("total"), F.count(F.lit(1)).alias("n")), "mix-sources")
    if budget is None:
        budget = float(stats.agg(F.sum("total")).first()[0] or 0)
    w = weights(stats.withColumnRenamed("_source", source), source).withColumnRenamed(source, "_wsource")
    sources = stats.join(w, F.col("_source").eqNullSafe(F.col("_wsource"))).drop("_wsource")
    targets = water_fill(sources, budget, max_epochs)
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("total"))
    per = F.greatest(F.lit(float(rows_per_bucket)), F.sqrt(F.col("n")))
    targets = targets.withColumn("buckets", F.ceil(F.col("n") / per))
    targets = written(targets.select(F.col("_source").alias("_tsource"), "total", "target", "epochs", "rest", "buckets"), "mix-targets")

    place = (F.col("_h").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    bucket = F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1)
    rows = sized.join(targets, F.col("_source").eqNullSafe(F.col("_tsource"))).withColumn("_bucket", bucket)
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (rows.groupBy("_source", "_bucket", "rest").agg(F.sum("_size").alias("in_bucket"))
               .withColumn("end", F.sum("in_bucket").over(upto)))
    last = buckets.filter((F.col("end") > F.col("rest")) & (F.col("end") - F.col("in_bucket") <= F.col("rest")))
    last = written(last.select(F.col("_source").alias("_bsource"), F.col("_bucket").alias("_last"),
                               (F.col("rest") - F.col("end") + F.col("in_bucket")).alias("_room")), "mix-last")
    in_last = F.col("_source").eqNullSafe(F.col("_bsource"))
    units = (rows.join(last, in_last & (F.col("_bucket") == F.col("_last")))
             .groupBy("_source", "_key", "_size", "_h", "_room").agg(F.sum("_size").cast("double").alias("_unit")))
    picks = units.groupBy("_source").applyInPandas(
        _first_fit, units.select("_source", "_key", "_size").schema)
    picks = written(picks.select(F.col("_source").alias("_psource"), F.col("_key").alias("_pkey"),
                                 F.col("_size").alias("_psize"), F.lit(1).alias("_picked")), "mix-picks")
    same = (F.col("_source").eqNullSafe(F.col("_psource")) & F.col("_key").eqNullSafe(F.col("_pkey"))
            & (F.col("_size") == F.col("_psize")))
    # a source whose rest reaches past its last bucket has no row in ``last``: it takes all of its buckets
    more = F.when(F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")), 1).otherwise(F.coalesce("_picked", F.lit(0)))
    more = F.when(F.col("rest") > 0, more).otherwise(0)
    out = rows.join(last, in_last, "left").join(picks, same, "left")
    return out.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"),
                      F.col("total").alias("source_size"), "target", (F.col("epochs") + more).cast("long").alias("times"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` as often as :func:`plan` takes them, with the columns of ``df``.

    A null or empty text has size 0, and its rows are taken no more often than :func:`plan` says; a null source is a
    source of its own, the last; rows that agree in key, source and size are taken equally often, so that repeated rows
    stay together; an empty table gives an empty result; other columns, whatever their names, come back as they are."""
    size, times, pkey, psource, psize, i = fresh(df, "_msize", "_times", "_pkey", "_psource", "_psize", "_i")
    taken = (plan(df, key, source, text=text, **options)
             .select(F.col(key).alias(pkey), F.col(source).alias(psource), F.col("size").alias(psize), F.col("times").alias(times))
             .filter(F.col(times) > 0).distinct())
    same = (F.col(key).eqNullSafe(F.col(pkey)) & F.col(source).eqNullSafe(F.col(psource)) & (F.col(size) == F.col(psize)))
    rows = df.withColumn(size, word_count(F.col(text))).join(taken, same)
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*df.columns)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every document."""
    return plan(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
