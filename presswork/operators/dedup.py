"""First-arrival-wins de-duplication, existence anti-join and source union.

``first_wins`` is ``row_number() = 1`` over the key ordered by arrival;
Spark plans it with a partial ``WindowGroupLimit`` *before* the shuffle, so
a hot key (one URL repeated millions of times) is reduced to one row per
map partition before it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions.urls import dedupe_key


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key by ``order`` (ties must be broken by ``order``)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def dedup_url(df: DataFrame, order: list = ("source_ord", "entry_ord"), url_col: str = "url") -> DataFrame:
    """First arrival per canonical URL (within the batch)."""
    return first_wins(df, [url_col], list(order))


def dedup_key(df: DataFrame, order: list = ("source_ord", "entry_ord"), key_col: str = "dedupe_key") -> DataFrame:
    """First arrival per title|domain|date key (the documented intent)."""
    if key_col not in df.columns:
        df = df.withColumn(key_col, dedupe_key("title", "domain", "published_at"))
    return first_wins(df, [key_col], list(order))


def anti_existing(new: DataFrame, store: DataFrame, key: str = "url", reduce: bool = True) -> DataFrame:
    """Rows of ``new`` whose key is not in ``store``; only the store's key column is read.

    ``reduce`` (semi-join reduction): the batch's distinct keys are semi-joined
    with the store first. A batch is small next to the history, so AQE
    broadcasts that key set (its runtime size is checked against the
    broadcast threshold) and the store is only scanned, never shuffled; the
    final anti-join then meets just the few stored keys that matched. Without
    ``reduce`` a plain anti-join is planned (AQE still chooses the strategy).
    """
    if not reduce:
        return new.join(store.select(key), key, "left_anti")
    keys = new.select(key).distinct()
    seen = store.select(key).join(keys, key, "left_semi")
    return new.join(seen, key, "left_anti")


def union_sources(*frames: DataFrame, ord_col: str = "kind_ord") -> DataFrame:
    """Union in priority order: ``kind_ord`` is the frame's number, so ordered by it first an
    earlier frame wins arrival ties (RSS before HTML)."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn(ord_col, F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def new_articles(batch: DataFrame, store: DataFrame | None, mode: str = "url",
                 order: list = ("source_ord", "entry_ord"), absent=None) -> DataFrame:
    """Rows of a landed batch to insert: first-wins within the batch, then not already stored.

    A URL is stored once in either mode; ``key`` also lets the first of each title|domain|date in. ``absent``: a
    function (rows, key) that leaves out stored rows; by default an anti-join with ``store``.
    """
    if mode not in ("url", "key"):
        raise ValueError(f"unknown dedup mode {mode!r}")
    if absent is None:
        absent = (lambda rows, key: rows) if store is None else (lambda rows, key: anti_existing(rows, store, key))
    fresh = absent(dedup_url(batch, order), "url")
    if mode == "key":
        fresh = absent(dedup_key(fresh, order), "dedupe_key")
    return fresh


def ingest_counts(seen: DataFrame, inserted: DataFrame, source_col: str = "source") -> DataFrame:
    """Items seen and rows inserted per source ``(source, items, inserted)``."""
    s = seen.groupBy(source_col).agg(F.count(F.lit(1)).alias("items"))
    i = inserted.groupBy(source_col).agg(F.count(F.lit(1)).alias("inserted"))
    return (s.join(i, source_col, "left")
            .select(source_col, "items", F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted")))
