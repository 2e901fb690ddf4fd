import math
import random

import numpy as np
import pytest

from presswork.llm import negatives, registry
from presswork.llm.common import table

from .conftest import duck, same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, _rid string, id string, vec string, scores string, rank string"


def brute(rows):
    """All pairs, by Python's whole numbers."""
    parts = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        parts.append((i, [math.floor(256 * float(x)) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(parts):
        if i is None or i % 100:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        own = sorted((-score(w), *last(j), j) for b, (j, w, other) in enumerate(parts) if other == label and b != a)[:5]
        for p, _, _, positive in own:
            fit = sorted((-score(w), *last(j), j) for j, w, other in parts if other != label and 30 * -p <= 100 * score(w) <= 90 * -p)
            out += [dict(anchor_id=i, positive_id=positive, rank=k + 1, negative_id=n[3], positive_score=-p, negative_score=-n[0]) for k, n in enumerate(fit[:10])]
    return out


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "c", "c", "c", "c", "c") for i, v, label in rows], SCHEMA).repartition(parts)


def near(rng, n=900, width=6, centres=12):
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.05))) for x in rng.choice(middle)], rng.randrange(10)) for i in range(n)]


def test_the_given_vectors(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = registry.op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert want
    same_rows(got, want)
    assert duck(negatives.DIGEST_SQL, embeddings=df)


def test_clusters_and_a_common_vector(spark):
    rng = random.Random(5)
    rows = near(rng) + [(1000 + i, [0.5, 0.25, -0.5, 1.0, 0.0, 0.75], rng.randrange(10)) for i in range(450)]
    rng.shuffle(rows)
    df = vectors(spark, rows)
    same_rows(negatives.digest(df), brute(rows))
    same_rows(negatives.digest(df), duck(negatives.DIGEST_SQL, embeddings=df.select("vec_id", "embedding", "label")))


def test_edge_rows(spark):
    rng = random.Random(6)
    rows = near(rng, 120, 3, 4)
    rows += [(100, [1.0, 0.5, 0.25], 3), (100, [1.0, 0.5, 0.25], 3), (200, None, 1), (300, [1.0, 2.0, 3.0], None), (400, [1.0, None, 2.0], 1),
             (500, [float("nan"), 1.0, 1.0], 2), (600, [float("inf"), 1.0, 1.0], 2), (None, [1.0, 0.5, 0.25], 4), (None, [1.0, 0.5, 0.25], 3),
             (700, [1.0, 0.5, 0.25], 9), (800, [], 9), (900, [1.0], 4), (-100, [0.5, 0.5, 0.5], 4), (1000, [0.0, 0.0, 0.0], 4)]
    same_rows(negatives.digest(vectors(spark, rows)), brute(rows))


def test_components_beyond_doubles(spark):
    rng = random.Random(7)
    rows = [(i, [float(np.float32(rng.choice((1, 3e5, 2e6)) * rng.gauss(0, 1))) for _ in range(4)], rng.randrange(3)) for i in range(300)]
    same_rows(negatives.digest(vectors(spark, rows)), brute(rows))


def test_empty(spark):
    assert negatives.digest(vectors(spark, [])).collect() == []
    assert negatives.digest(vectors(spark, [(100, [1.0], 1)])).collect() == []


def test_bounds_spare_scores():
    """Where anchors are near each other, most rows are placed by their parents' scores."""
    rng = np.random.default_rng(1)
    anchors = np.floor(256 * (rng.standard_normal(8) + 0.01 * rng.standard_normal((200, 8))))
    rows = np.floor(256 * rng.standard_normal((3000, 8)))
    order, parent, length = negatives.spanning_tree(anchors)
    place = np.empty(200, int)
    place[order] = np.arange(200)
    walk = negatives.Walk(rows, np.sqrt((rows ** 2).sum(1)), anchors[order])
    ids = np.arange(3000)
    for k, node in enumerate(order):
        walk.enter(k, int(place[parent[node]]), length[node])
        which, scores = walk.best(k, np.ones(3000, bool), -np.inf, np.inf, 5, ids)
        want = rows @ anchors[node]
        best = np.lexsort((ids, -want))[:5]
        assert which.tolist() == best.tolist() and scores.tolist() == want[best].tolist()
    assert walk.scored < 0.1 * 200 * 3000


def test_spanning_tree_is_least():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((40, 3))
    order, parent, length = negatives.spanning_tree(points)
    assert sorted(order) == list(range(40)) and length[0] == 0
    pairs = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(40) for j in range(i))
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for d, i, j in pairs:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert length.sum() == pytest.approx(total)
