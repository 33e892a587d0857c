"""Shading and depth queries: equal to their SQL where a ridge's steps are even, and no plan sends rows of pictures through the driver."""

from pathlib import Path

import duckdb
import pytest

from ridgeway.plans import oracles, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
EVEN = [206, 210, 215, 218, 612]  # views with three rows at even ratios, where the last digit of a logarithm decides


@pytest.fixture(scope="module")
def even(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("even"))
    spark.createDataFrame([(k,) for k in EVEN], "s_suppkey bigint").write.parquet(f"{folder}/supplier.parquet")
    return folder


def equal(spark, even, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW supplier AS SELECT * FROM '{even}/supplier.parquet/*.parquet'")
    got, want = registry.queries()[name](spark, even).toPandas(), duck.sql(oracles.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_edge_strength_where_steps_are_even(spark, even):
    equal(spark, even, "edge_strength")


def test_ink_spread_where_steps_are_even(spark, even):
    equal(spark, even, "ink_spread")


@pytest.mark.parametrize("name", ["edge_strength", "ink_spread", "shaded_column", "supersample_avg", "depth_delta", "depth_roundtrip"])
def test_no_picture_is_broadcast(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
