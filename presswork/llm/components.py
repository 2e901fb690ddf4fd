"""Connected components by alternating large-star and small-star.

Large-star links every neighbour larger than a node to the smallest of the node and its neighbours; small-star does
the same for the neighbours that are not larger. Alternating them turns every component into a star around its
smallest node. Each round is an aggregate (with map-side combine, so a hub costs nothing) and an equi-join that
Spark splits where a hub is hot; no task holds a component. The links of a round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, F.col("u") == F.col("mu"))
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small(links: DataFrame) -> DataFrame:
    """``links`` have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("ma"), "m")
    moved = links.join(least, F.col("a") == F.col("ma")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("ma").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) name; the root is the smallest node of the component."""
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        n = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == (n["n"], n["h"]):
            break
        mark = (n["n"], n["h"])
        now = written(_small(_large(now)), "cc")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "cc-labels")
