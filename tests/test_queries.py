"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import duckdb
import pytest

from siftmill.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df):
    names = sorted(df.columns)
    return sorted(map(tuple, df[names].astype(object).where(df[names].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", ["scan_decisions", "chunk_hashes", "rule_eval", "api_params", "relevance_top20"])
def test_no_python_in_the_plan(spark, name):
    plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(__spark_entry__.queries())
