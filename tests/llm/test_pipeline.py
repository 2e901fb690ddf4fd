import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

from pyspark.sql import functions as F

from presswork.llm import decontaminate, mix, neardup, quality, tokens
from presswork.llm.common import table, written

from .conftest import CLASHES
from .test_neardup import brute

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_by_themselves_and_together(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out = out.cache()
        seen[name] = (docs, out)
        docs = out
    for name, (_, out) in list(seen.items())[:-1]:
        assert out.columns == columns, name

    before, after = seen["quality rules"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.digest(before).filter("kept").collect()}
    before, after = seen["near-dedup"]
    want = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in want})
    before, after = seen["decontamination"]
    clean = decontaminate.digest(before, table(spark, SF, "benchmark")).filter("NOT contaminated")
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in clean.collect()}
    before, after = seen["mixing"]
    times = {r.doc_id: r.times for r in mix.plan(before).collect()}
    n = {}
    for r in after.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n == {i: t for i, t in times.items() if t}

    before, after = seen["token output"]
    t = tokens.PieceEncoder(tokens.default_tokenizer()).tokenizer
    got = sorted(after.collect(), key=lambda r: r.start)
    at = 0
    for r, d in zip(got, sorted(before.collect(), key=lambda d: d.doc_id), strict=True):
        ids = np.array([*t.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)

    together = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert together == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got)
    assert neardup.keep_first(spark.createDataFrame([], before.schema)).count() == 0


def ids_of(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_on_edge_cases(spark, docs):
    """Nulls, repeated ids and rows, empty and long texts, and columns with the operators' own names."""
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, SF).cache() for name, stage in stages.items()}
    for name in list(stages)[:-1]:
        assert out[name].columns == docs.columns, name
        assert {r["part"] for r in out[name].collect()} <= {"clash"}, name
    all_ids = ids_of(docs)
    assert ids_of(out["quality rules"]) == ids_of(quality.digest(docs).filter("kept"))
    assert not {1, 2, 3} & set(ids_of(out["quality rules"]))
    assert ids_of(out["decontamination"]) == ids_of(decontaminate.digest(docs, table(spark, SF, "benchmark")).filter("NOT contaminated"))
    deduped = ids_of(out["near-dedup"])
    assert all(deduped[i] == all_ids[i] for i in (1, 2, 3, None)) and deduped[8] == 1
    assert not {9, 10, 20} & set(deduped)
    want = Counter()
    for r in mix.plan(docs).collect():
        want[r.doc_id] += r.times
    assert ids_of(out["mixing"]) == +want
    rows = sorted(out["token output"].collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in rows) == all_ids
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert rows[0].doc_id is None and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}


def test_stages_one_after_the_other_on_edge_cases(spark, docs):
    """With given documents too, of which some pass the rules, twice and without an id."""
    given = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    given = given.unionByName(given.filter("doc_id % 3 = 0")).unionByName(given.filter("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    df = written(docs.unionByName(given.withColumns({c: F.lit("clash") for c in CLASHES})), "edge")
    left = ids_of(df)
    for name, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, SF), "edge")
        now = ids_of(df)
        assert set(now) <= set(left), name
        left = now
    given_left = [i for i in left if i is not None]
    assert given_left and set(given_left) <= {r.doc_id for r in given.filter("doc_id IS NOT NULL").collect()}


def test_stages_without_rows(spark, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, SF)
        assert out.count() == 0, name
        assert "doc_id" in out.columns and (name == "token output" or out.columns == no_docs.columns), name
