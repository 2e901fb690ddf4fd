"""Every registered query vs its DuckDB formulation on the small fixture."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import canon, duck  # noqa: E402
from conftest import SF_SMALL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(df.columns, df.collect()) == canon(ocols, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "arrival_id", "title", "url", "published_at", "category", "severity", "severity_score"]
    assert 0 < df.count() <= 5


def test_every_query_of_the_engine_has_an_oracle():
    from presswork.plans import registry

    missing = set(registry.all_queries()) - set(registry.all_oracles())
    assert missing == set(), missing
    assert set(registry.all_queries()) <= set(E.queries())
