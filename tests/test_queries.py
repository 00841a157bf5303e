"""Every registered query against its SQL on the given tables, plus plan checks."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from coverlay.queries import CHECKS, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in df.collect())
    result = sql.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_module(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() == 25


def test_plans_stay_lean(spark):
    """No cross join anywhere; a count reads only the columns it needs."""
    for name in ("points_in_zones", "buildings_intersect_zones", "line_clip_length", "quantiles", "null_profile"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = QUERIES["points_in_zones"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
