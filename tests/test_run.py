"""End to end: landed feeds + pages -> store -> enrichment in place -> Markdown report; a rerun adds nothing."""

import datetime as dt
import glob
import os


from pyspark.sql import functions as F

from presswork.plans.run import run_once
from presswork.sources.store import read_store
from test_sources import ATOM, RSS, land

PAGE = '<html><body><a href="/news/1">Critical RCE exploited in the wild</a><a href="https://a.example.com/2">Second</a></body></html>'


def test_run_once_and_rerun(spark, tmp_dir):
    land(f"{tmp_dir}/feeds", "srcA/a.xml", RSS)
    land(f"{tmp_dir}/feeds", "srcB/b.xml", ATOM)
    pages = spark.createDataFrame([("site", 1, "https://h.example.com/", PAGE)], "source string, page_id long, url string, html string")
    store, rep = f"{tmp_dir}/store", f"{tmp_dir}/out/report_2026-02-15.md"
    as_of = dt.datetime(2026, 2, 15, 20, 0)
    r1 = run_once(spark, store, rep, as_of, "24h", 25, feeds_path=f"{tmp_dir}/feeds", pages=pages)
    counts = {r.source: (r.items, r.inserted) for r in r1.counts.collect()}
    assert counts == {"srcA": (3, 2), "srcB": (2, 2), "site": (2, 1)}   # 'Second' duplicates a feed URL
    rows = read_store(spark, store).collect()
    assert len(rows) == 5
    in_window = [r for r in rows if r.published_at is None or r.published_at >= dt.datetime(2026, 2, 14, 20)]
    assert in_window and all(r.category and r.severity and r.soc_action and r.summary for r in in_window)
    hot = [r for r in rows if r.title == "Critical RCE exploited in the wild"][0]
    assert hot.severity == "alta" and hot.category == "vulnerabilidades"
    assert r1.markdown.startswith("# Informe diario de ciberseguridad — 2026-02-15\n")
    assert "1. **Critical RCE exploited in the wild** " in r1.markdown
    assert open(rep, encoding="utf-8").read() == r1.markdown and os.listdir(f"{tmp_dir}/out") != []
    assert [f for f in os.listdir(f"{tmp_dir}/out") if not f.endswith(".crc")] == ["report_2026-02-15.md"]
    assert (r1.quarantined, r1.enriched) == (0, len(in_window))
    files = lambda: sorted(f for f in glob.glob(f"{store}/*/**/*.parquet", recursive=True) if "_manifest" not in f and "_quarantine" not in f)
    before = files()
    r2 = run_once(spark, store, rep, as_of, "24h", 25, feeds_path=f"{tmp_dir}/feeds", pages=pages)
    assert files() == before                                               # a run that changes nothing writes nothing
    assert r2.enriched == r1.enriched
    assert sum(r.inserted for r in r2.counts.collect()) == 0
    assert read_store(spark, store).count() == 5
    assert r2.markdown == r1.markdown


def test_command_line(spark, tmp_dir, capsys):
    import pytest

    from presswork.__main__ import main, parse_args

    land(f"{tmp_dir}/feeds", "srcA/a.xml", RSS)
    rc = main(["run", "--store", f"{tmp_dir}/store", "--output", f"{tmp_dir}/out", "--feeds", f"{tmp_dir}/feeds",
               "--since", "48h", "--limit", "10", "--as-of", "2026-02-15T20:00:00"], spark=spark)
    assert rc == 0
    assert "srcA: items=3 inserted=2" in capsys.readouterr().out
    assert os.path.isfile(f"{tmp_dir}/out/report_2026-02-15.md")
    with pytest.raises(SystemExit):
        parse_args(["run"])                                               # --store/--output missing
    with pytest.raises(ValueError):
        parse_args(["run", "--store", "s", "--output", "o", "--limit", "201"])
    with pytest.raises(ValueError):
        parse_args(["run", "--store", "s", "--output", "o", "--since", "3w"])


def test_write_enrichment_new_version_touches_window_partitions_only(spark, tmp_dir):
    from conftest import SF_SMALL
    from presswork.sources.store import append_store, write_enrichment
    from presswork.sources.tables import articles_fx

    store, out = f"{tmp_dir}/store", f"{tmp_dir}/v2"
    a = articles_fx(spark, SF_SMALL)
    append_store(a, store)
    as_of = a.agg(F.max("published_at")).first()[0]
    write_enrichment(spark, store, as_of, "24h", out_path=out)
    parts = sorted(d for d in os.listdir(out) if d.startswith("pub_date="))
    start = (as_of - dt.timedelta(hours=24)).date().isoformat()
    assert parts and all(p == "pub_date=__HIVE_DEFAULT_PARTITION__" or p >= f"pub_date={start}" for p in parts)
    v2 = read_store(spark, out)
    win = v2.filter(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(as_of - dt.timedelta(hours=24))))
    assert win.count() > 0 and win.filter(F.col("category").isNull() | F.col("summary").isNull()).count() == 0
