"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from vicinal.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "N" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Pushdown and bounded heaps where they belong."""
    plan = lambda n: registry.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n_chars,1000)" in plan("filter_typed_pushdown") and "EqualTo(lang,fr)" in plan("filter_typed_pushdown") and "TakeOrderedAndProject" in plan("topk_cosine") and "BatchEvalPython" not in plan("topk_cosine")
    assert "WindowGroupLimit" in plan("knn_join")
