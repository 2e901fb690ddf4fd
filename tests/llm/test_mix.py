import random

import pytest
from pyspark.sql import functions as F

from presswork.llm import mix
from presswork.llm.common import table

from .conftest import frame

SF = "/root/testdata/sf0.001"


def water_fill(total, weight, budget, cap=3.0):
    """The targets by bisection of the water level."""
    lo, hi = 0.0, budget * 10 + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(cap * t, w * mid) for t, w in zip(total, weight)) < budget:
            lo = mid
        else:
            hi = mid
    return [min(cap * t, w * lo) for t, w in zip(total, weight)]


def test_targets_against_bisection(spark):
    rng = random.Random(1)
    for _ in range(4):
        total = [rng.choice([0, 5, 50, 1000, 20000]) for _ in range(9)]
        weight = [5.0, 2.0, 1.0] * 3
        df = spark.createDataFrame(list(zip(range(9), total, weight)), "s int, total long, weight double")
        got = [r.target for r in mix.water_fill(df, float(sum(total))).orderBy("s").collect()]
        assert got == pytest.approx(water_fill(total, weight, sum(total)), rel=1e-6, abs=1e-6)


def test_sources_come_near_their_targets(spark):
    docs = table(spark, SF, "documents")
    rows = mix.digest(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = {r.doc_id: r.taken for r in mix.digest(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    by = {}
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(sum(r.size for r in rows))
    for v in by.values():
        assert sum(r.size for r in v) == v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(0.02 * v[0].target, min(r.size for r in v))


def test_large_source_uses_many_buckets(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), "en", "hot" if i % 3 else "cold", 1) for i in range(9000)]
    out = mix.plan(frame(spark, tmp_path, rows), rows_per_bucket=50).groupBy("source").agg(
        F.sum(F.col("size") * F.col("times")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 2 for r in out)


def test_edge_cases(docs, no_docs):
    rows = mix.plan(docs).collect()
    assert len(rows) == docs.count()
    assert {r.source for r in rows} == {None, "a", "b", "c", "ä"}
    weights = {r.source: r.weight for r in mix.cycled_weights(docs, "source").collect()}
    assert weights == {"a": 5.0, "b": 2.0, "c": 1.0, "ä": 5.0, None: 2.0}
    assert all(r.size == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mix.plan(no_docs).count() == 0
    out = mix.mix(docs)
    assert out.columns == docs.columns
    times = {(r.doc_id, r.size): r.times for r in rows}
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    for (i, _), t in times.items():
        assert n.get(i, 0) == t * (2 if i == 20 else 1)
