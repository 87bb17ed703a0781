"""Every driver query of the engine against its DuckDB SQL, on the smallest tables."""

import os

import pytest

from sparkshards.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr([int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in rows.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(queries.ORACLE_SQL[name]).df())


def test_plans(spark):
    """Filters and columns reach the scan; seeded samples need no exchange."""
    plan = queries.QUERIES["select"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_totalprice), EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert "Exchange" not in queries.QUERIES["rsample_md5"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in queries.QUERIES["to_tuple"](spark, SF)._jdf.queryExecution().executedPlan().toString()
