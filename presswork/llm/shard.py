"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A row descends the tree. At every level each child draws ``-ln(u) / weight``, with ``u`` in (0, 1] taken from a
hash of the row's key and the child's path, and the smallest draw wins, so a child is chosen in proportion to its
weight. A child's draw depends on nothing but the key, its own path and its own weight: when weights change, a
row only moves into a subtree whose weight grew or out of one whose weight shrank, and rows in all other subtrees
stay. A node's weight is the sum of the shards below it.

Growing by :meth:`HashTree.grown` opens a new region with one rack for the new shard, hence all rows that move go
to the new shard itself.

Everything is a column expression; the slots need one shuffle of the (key, size) columns and no text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import fresh

HEX_DIGITS = 13  # 52 bits of an MD5, exact in a double
SPACE = float(1 << 52)
NULL_KEY = "\\N"
#: Rows that one sort of the slot numbering holds on average.
ROWS_PER_BUCKET = 4096


@dataclass(frozen=True)
class HashTree:
    """``leaves``: (region, rack, shard, weight). Shards of weight 0 get no rows."""

    leaves: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> "HashTree":
        """Equal weights, ``racks`` in a region, ``shards`` in a rack, numbered from 0."""
        n = regions * racks * shards
        return HashTree(tuple((s // (racks * shards), s // shards % racks, s, 1.0) for s in range(n)))

    def grown(self, weight: float = 1.0) -> "HashTree":
        """One more shard, in a region of its own."""
        region, shard = (max(x[i] for x in self.leaves) + 1 for i in (0, 2))
        return HashTree((*self.leaves, (region, 0, shard, weight)))

    def children(self, depth: int) -> dict[tuple[int, ...], list[tuple[int, str, float]]]:
        """By the path of a node at ``depth``: (number, path as text, weight) of its children that have weight."""
        weights: dict[tuple[int, ...], float] = {}
        for leaf in self.leaves:
            weights[leaf[: depth + 1]] = weights.get(leaf[: depth + 1], 0.0) + leaf[3]
        out: dict[tuple[int, ...], list[tuple[int, str, float]]] = {}
        for path, w in sorted(weights.items()):
            if w > 0:
                out.setdefault(path[:-1], []).append((path[-1], "/".join(map(str, path)), w))
        return out


def hash52(key: Column, salt: Column) -> Column:
    """An even hash of a key in [0, 2^52)."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), salt)), 1, HEX_DIGITS), 16, 10).cast("long")


def _draw(key: Column, path: Column, weight: Column) -> Column:
    return -F.ln((hash52(key, path) + F.lit(1)) / F.lit(SPACE)) / weight


def _choose(key: Column, children: Column) -> Column:
    """The winner of one level: children is an array of (num, path, weight)."""
    draws = F.transform(children, lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("d"), c["num"].alias("num")))
    return F.array_min(draws)["num"]


def _family(children: list[tuple[int, str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("num"), F.lit(p).alias("path"), F.lit(w).alias("weight")) for n, p, w in children])


def key_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(NULL_KEY))


def place(df: DataFrame, tree: HashTree, key: str, out: str) -> DataFrame:
    """``df`` with the shard of each row in column ``out`` (int). Nulls in ``key`` are one key of their own."""
    region, rack, k = fresh(df, "_region", "_rack", "_key")
    top, mid, low = (tree.children(d) for d in range(3))
    if not top:
        raise ValueError("a tree needs a shard of positive weight")

    def family(level, path_cols):
        families = sorted(level.items())
        expr = _family(families[-1][1])
        for path, members in reversed(families[:-1]):
            hit = F.lit(True)
            for c, v in zip(path_cols, path):
                hit = hit & (F.col(c) == v)
            expr = F.when(hit, _family(members)).otherwise(expr)
        return expr

    out_df = df.withColumn(k, key_text(F.col(key)))
    out_df = out_df.withColumn(region, _choose(F.col(k), _family(top[()])))
    out_df = out_df.withColumn(rack, _choose(F.col(k), family(mid, [region])))
    out_df = out_df.withColumn(out, _choose(F.col(k), family(low, [region, rack])).cast("int"))
    return out_df.drop(region, rack, k)


def number(df: DataFrame, shard: str, key: str, ties: list[str], out: str, n_rows: int, n_shards: int,
           rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Gapless row numbers from 0 in each shard, in the order of a hash of the key and ``ties``, then these themselves.

    The hash range is cut into buckets; a bucket's first number is the count of the rows in the buckets before
    it, so no task ever sorts a whole shard, nor all rows of one key. Rows that agree in all of these columns may swap
    their numbers.
    """
    order, bucket, n, start = fresh(df, "_order", "_bucket", "_n", "_start")
    buckets = max(1, math.ceil(n_rows / max(1, n_shards * rows_per_bucket)))
    keyed = df.withColumn(order, hash52(F.concat_ws("|", key_text(F.col(key)), *[F.col(t).cast("string") for t in ties]), F.lit("slot")))
    keyed = keyed.withColumn(bucket, F.floor(F.col(order) / F.lit(SPACE) * F.lit(buckets)).cast("long"))
    counts = keyed.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    own = Window.partitionBy(shard, bucket).orderBy(order, key, *ties)
    return (keyed.join(starts, [shard, bucket])
            .withColumn(out, F.col(start) + F.row_number().over(own) - 1)
            .drop(order, bucket, start))


def shard_rows(df: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and next shard of every row.

    Returns key, size (UTF-8 bytes of the text plus 16), text_crc32, law (``key``: key and tree alone decide),
    shard, slot (gapless from 0 in its shard) and grown_shard (where the row lives when the tree has one more
    shard). A null or empty text has no bytes; rows with a null key share one place; repeated rows are kept and
    numbered one by one; an empty table gives an empty result; other columns of the input are not returned, so
    their names cannot clash.
    """
    base = df.select(F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                     F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
                     F.lit("key").alias("law"))
    placed = place(place(base, tree, key, "shard"), tree.grown(), key, "grown_shard")
    slots = number(placed, "shard", key, ["size", "text_crc32"], "slot", df.count(), len(tree.leaves))
    return slots.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def shard_sql(tree: HashTree, table: str = "documents") -> str:
    """DuckDB SQL for :func:`shard_rows` on ``documents``."""

    def draw(path: str, w: float) -> str:
        return (f"struct_pack(d := -ln((('0x' || substr(md5(k || '|{path}'), 1, {HEX_DIGITS}))::BIGINT + 1) / {SPACE!r}) / {w!r}, "
                f"num := {path.rsplit('/', 1)[-1]})")

    def choose(members) -> str:
        return f"list_min([{', '.join(draw(p, w) for _, p, w in members)}]).num"

    def descend(t: HashTree, tag: str, source: str) -> str:
        top, mid, low = (t.children(d) for d in range(3))
        racks = " ".join(f"WHEN region = {r[0]} THEN {choose(m)}" for r, m in sorted(mid.items()))
        shards = " ".join(f"WHEN region = {r[0]} AND rack = {r[1]} THEN {choose(m)}" for r, m in sorted(low.items()))
        return (f"{tag}1 AS (SELECT *, {choose(top[()])} AS region FROM {source}), "
                f"{tag}2 AS (SELECT *, CASE {racks} END AS rack FROM {tag}1), "
                f"{tag}3 AS (SELECT * EXCLUDE (region, rack), (CASE {shards} END)::INT AS {tag} FROM {tag}2)")

    return f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '{NULL_KEY}') AS k, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])))::BIGINT AS text_crc32
  FROM {table}, crc),
{descend(tree, 'shard', 'base')},
{descend(tree.grown(), 'grown_shard', 'shard3')}
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || '|' || size || '|' || text_crc32 || '|slot'), 1, {HEX_DIGITS}))::BIGINT,
    doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot,
  grown_shard
FROM grown_shard3"""
