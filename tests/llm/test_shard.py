from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from presswork.llm import shard
from presswork.llm.registry import SHARD_TREE

from .conftest import duck, frame, same_rows


def test_sql_on_edge_cases(docs):
    got = shard.shard_rows(docs, SHARD_TREE)
    want = duck(shard.shard_sql(SHARD_TREE), documents=docs.select("doc_id", "text"))
    same_rows(got, want)


def test_crc_and_gapless_slots(docs):
    rows = shard.shard_rows(docs, SHARD_TREE).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, crc32(raw))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_no_rows(no_docs):
    assert shard.shard_rows(no_docs, SHARD_TREE).count() == 0


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    return frame(spark, tmp_path_factory.mktemp("many"), [(i, f"t{i}", "en", "a", 1) for i in range(20_000)])


def _placed(df, tree):
    return {r.doc_id: r.s for r in shard.place(df, tree, "doc_id", "s").select("doc_id", "s").collect()}


def test_one_more_shard_takes_rows_only_into_itself(many):
    old, new = _placed(many, SHARD_TREE), _placed(many, SHARD_TREE.grown())
    moved = {i: new[i] for i in old if old[i] != new[i]}
    assert set(moved.values()) == {40}
    assert abs(len(moved) - len(old) / 41) < 5 * (len(old) / 41) ** 0.5
    counts = Counter(old.values())
    assert len(counts) == 40 and all(abs(n - 500) < 6 * 500**0.5 for n in counts.values())


def test_a_changed_weight_moves_rows_only_into_its_region(many):
    leaves = list(SHARD_TREE.leaves)
    old = _placed(many, SHARD_TREE)
    leaves[0] = (*leaves[0][:3], 3.0)  # a shard of region 0 grows
    new = _placed(many, shard.HashTree(tuple(leaves)))
    region = {s: r for r, _, s, _ in leaves}
    for i in old:
        if old[i] != new[i]:
            assert region[new[i]] == 0
            if region[old[i]] == 0:  # inside the region, only into the rack of the shard
                assert new[i] < 5
    assert Counter(new.values())[0] > 2 * 500


def test_weights(many):
    tree = shard.HashTree(((0, 0, 0, 1.0), (0, 1, 1, 2.0), (1, 0, 2, 0.0), (1, 1, 3, 5.0)))
    n = Counter(_placed(many, tree).values())
    assert n[2] == 0 and abs(n[0] / 20_000 - 1 / 8) < 0.02 and abs(n[3] / 20_000 - 5 / 8) < 0.02
    with pytest.raises(ValueError):
        shard.place(many, shard.HashTree(((0, 0, 0, 0.0),)), "doc_id", "s")


def test_rows_of_one_key_are_numbered_in_many_tasks(spark, tmp_path):
    """A third of the rows have no key: they share a shard, but no bucket of its slots."""
    rows = [(None if i % 3 == 0 else i, f"t{i}", "en", "a", 1) for i in range(9_000)]
    got = shard.shard_rows(frame(spark, tmp_path, rows), SHARD_TREE)
    few = shard.number(got.drop("slot"), "shard", "doc_id", ["size", "text_crc32"], "slot", 9_000, 40, rows_per_bucket=20)
    same_rows(few.select(*got.columns), [r.asDict() for r in got.collect()])
    parts = F.concat_ws("|", shard.key_text(F.col("doc_id")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    hot = got.filter("doc_id IS NULL").select((shard.hash52(parts, F.lit("slot")) / shard.SPACE * 100).cast("int").alias("b")).groupBy("b").count().collect()
    assert len(hot) == 100 and max(r["count"] for r in hot) < 70
