import random
import re

import numpy as np
from pyspark.sql import functions as F

from presswork.llm import neardup
from presswork.llm.components import components

from .conftest import frame, words


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(rows):
    """Smallest id of every row's component, comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        least[k] = r[0] if least.get(k) is None else least[k] if r[0] is None else min(least[k], r[0])
    return [(r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_edge_cases(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.digest(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((*x, x[0] == x[2])) for x in brute(rows))
    assert neardup.digest(no_docs).count() == 0


def test_chains_around_the_threshold(spark, tmp_path):
    """Families whose members are linked only through some others, in groups larger than a star reaches."""
    rng = random.Random(9)
    rows, n = [], 0
    for family in range(4):
        base = [f"f{family}x{i}" for i in range(150)]
        members = [base]
        for _ in range(45):
            w = list(rng.choice(members[-12:] if family % 2 else [base]))
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = f"m{rng.randrange(60)}"
            members.append(w)
        for w in members:
            rows.append((n, " ".join(w), "en", "a", 1))
            n += 1
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in neardup.digest(frame(spark, tmp_path, rows)).collect()}
    want = {i: c for i, _, c in brute([r[:2] for r in rows])}
    assert got == want
    assert 8 < len(set(want.values())) < len(rows)


def test_rest_finds_what_stars_miss(spark, tmp_path, monkeypatch):
    """With no star pairs at all, the prefix join alone must link what shares a bucket."""
    rng = random.Random(4)
    base = words(rng, 150, 5000)
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    whole = neardup._compared
    monkeypatch.setattr(neardup, "_compared", lambda pairs, sets: whole(pairs.limit(0) if "a" in pairs.columns and pairs is stars[0] else pairs, sets))
    stars = [None]
    keep = neardup.written

    def spy(df, name):
        out = keep(df, name)
        if name == "near-stars":
            out = out.limit(0)
            stars[0] = out
        return out

    monkeypatch.setattr(neardup, "written", spy)
    got = {r.doc_id: r.component_id for r in neardup.digest(frame(spark, tmp_path, rows)).collect()}
    assert got == {i: c for i, _, c in brute([r[:2] for r in rows])}


def test_one_of_each_group_stays(docs):
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(str(r.doc_id) for r in kept.collect())
    assert got == sorted({str(r.doc_id) for r in neardup.digest(docs).filter("kept").collect()})


def test_rows_are_dropped_by_row_not_by_key(spark, tmp_path):
    """Null and repeated keys: unrelated texts all stay, near copies leave one, repeats of a row leave one."""
    rng = random.Random(12)
    own = [" ".join(words(rng, 60, 9000)) for _ in range(9)]
    near = own[0] + " tail"
    rows = [(1, own[0]), (2, near), (2, own[1]), (None, near), (None, own[2]), (None, own[3]), (5, own[4]), (5, own[5]), (6, own[6]), (6, own[6]),
            (6, own[6].upper()), (None, own[7]), (None, own[7]), (None, own[7] + " tail"), (None, ""), (None, None), (7, ""), (7, "")]
    rows = [(k, t, "en", "a", i) for i, (k, t) in enumerate(rows)]
    kept = neardup.keep_first(frame(spark, tmp_path, rows)).collect()
    ids = {r.n_chars for r in kept}
    assert len(ids) == len(kept)
    assert {0, 2, 4, 5, 6, 7, 14, 15, 16, 17} <= ids and not {1, 3} & ids
    assert len({8, 9, 10} & ids) == 1 and len({11, 12, 13} & ids) == 1 and len(kept) == 12


def test_components_by_brute_force(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(50)]
    links += [(7, 7), *links[:5]]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a != b:
            for x in (a, b):
                root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got[1070] == 1000


def test_plan_has_no_all_pairs_join(docs):
    plan = neardup.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert neardup.groups(docs).filter(F.col("_n") < 0).count() == 0


def test_bitmaps_never_part_similar_sets():
    """Places where two bitmaps differ are at most the shingles that one set alone has, for small and for huge sets."""
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 400, 30_000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for lost in (0, 1, n // 10, n // 2):
            other = np.sort(np.concatenate([base[lost:], rng.integers(0, 2**63, lost, dtype=np.uint64)]))
            differ = sum(int(x).bit_count() for x in (neardup._parities(np.sort(base)) ^ neardup._parities(other)).view(np.uint64))
            assert differ <= len(np.setxor1d(base, other))
            assert lost or not differ
    assert neardup._parities(base[:0]).tolist() == [0] * (neardup.PARITIES // 64)


def test_a_family_below_the_threshold_makes_few_pairs(spark, tmp_path, monkeypatch):
    """150 texts that share most words with one base, but hardly any pair of which is similar, share buckets and rare shingles."""
    rng = random.Random(21)
    base = words(rng, 150, 9000)
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(150), 4 if i < 20 else 8):
            w[j] = f"own{i}x{j}"
        rows.append((i, " ".join(w), "en", "a", 1))
    pairs, keep = [], neardup.written

    def spy(df, name):
        out = keep(df, name)
        if name == "near-rest":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", spy)
    got = {r.doc_id: r.component_id for r in neardup.digest(frame(spark, tmp_path, rows)).collect()}
    assert got == {i: c for i, _, c in brute([r[:2] for r in rows])}
    assert len(set(got.values())) > 50 and pairs[0] < 150 * 149 / 2 / 5
