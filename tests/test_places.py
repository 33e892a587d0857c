"""Views and peaks at one place meet once: pairs of single rows are never shuffled, and all of them are there."""

from pathlib import Path

import duckdb
import pytest

from ridgeway.plans import oracles, registry

PEAKS = ["peak_candidates", "peak_projection", "peak_bracketing", "peak_visibility", "peak_dominance", "peak_topk", "peak_counts", "peak_far"]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """40 views at two places and 60 peaks at six: each place has many."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    spark.createDataFrame([(k + 400 * i,) for k in (110, 131) for i in range(20)], "s_suppkey bigint").write.parquet(f"{folder}/supplier.parquet")
    near = "SELECT p FROM (SELECT id AS p, 20 + pmod(id * 7919, 6000) / 1e5 AS x, 49 + pmod(id * 104729, 4000) / 1e5 AS y FROM range(12000)) WHERE abs(x - 20.0105) < 0.004 AND abs(y - 49.0055) < 0.004 ORDER BY p LIMIT 6"
    keys = [r.p for r in spark.sql(near).collect()]
    assert len(keys) == 6
    spark.createDataFrame([(k + 12000 * i, "n", "t", 1) for k in keys for i in range(10)], "p_partkey bigint, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return folder


def shuffled(spark) -> int:
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", PEAKS)
def test_crowded_places(spark, crowded, name):
    duck = duckdb.connect()
    for t in ("supplier", "part"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{crowded}/{t}.parquet/*.parquet'")
    before = shuffled(spark)
    got, want = registry.queries()[name](spark, crowded).toPandas(), duck.sql(oracles.oracle_sql()[name]).df()
    moved = shuffled(spark) - before
    cols = sorted(got.columns)
    assert len(want) >= 40 and sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
    # 40 views, 60 peaks and the 12 pairs of places pass a few shuffles, the 2,400 pairs of rows none
    assert moved < 1200


def test_candidates_meet_by_place(spark, crowded):
    """The costly part, distances and bearings, is done for 12 pairs of places."""
    m = registry.Meeting(spark, crowded)
    assert m.projected().count() <= 12 < 2400 / 10
    assert m.spread(m.projected().select("view", "osm_id")).count() == registry.queries()["peak_candidates"](spark, crowded).count()
