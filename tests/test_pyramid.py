"""The stored pyramid: order, pruned reads, copies of blocks that many ask, and what a killed build leaves."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ridgeway.functions import geo
from ridgeway.operators import dem, march, rays
from ridgeway.sources import pyramid


def cells(spark, n, x0=0, y0=0, level=14, value=None):
    x, y = F.lit(x0) + F.col("id") % n, F.lit(y0) + F.floor(F.col("id") / n)
    return spark.range(n * n).select(F.lit(level).alias("level"), x.alias("x"), y.alias("y"), (F.lit(7000) + (x * 3 + y) % 50 if value is None else value).cast("int").alias("v"))


def metrics(df):
    """The scan's metrics after a run."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().head()
    return "number of files read: " + str(leaf.metrics().apply("numFiles").value())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_morton_order(spark):
    rng = random.Random(1)
    some = [(rng.randrange(8, 15), rng.randrange(1 << 13), rng.randrange(1 << 13)) for _ in range(200)]
    got = spark.createDataFrame(some, "level int, bx int, by int").select("*", pyramid.morton(F.col("level"), F.col("bx"), F.col("by")).alias("k")).collect()
    for level, bx, by, k in got:
        assert k == (level << 52) | sum(((bx >> b & 1) << 2 * b) | ((by >> b & 1) << 2 * b + 1) for b in range(13))


def test_ranges_cover_all_keys_and_are_few(spark):
    rng = random.Random(2)
    keys = sorted({rng.randrange(1 << 26) | rng.choice([12, 14]) << 52 for _ in range(3000)})
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    for most in (1, 7, 100, 10_000):
        found = pyramid.ranges(table, most)
        assert 0 < len(found) <= most and all(any(a <= k <= b for a, b in found) for k in keys)
    assert pyramid.ranges(table.limit(0)) == []


def test_a_view_reads_the_blocks_around_it(spark, tmp_path):
    """Blocks of 8 cells, 96 x 96 of them: a small disc opens few directories and pushes its ranges to the scan."""
    side, n = 8, 768
    x0, y0 = 2329600 // 2048 * 2048, 1439232 // 2048 * 2048
    pyramid.write(cells(spark, n, x0, y0), f"{tmp_path}/p", side)
    surface = dem.Pyramid.open(spark, f"{tmp_path}/p", side)
    far = spark.sql(f"SELECT 1L AS view, {(x0 + 400.5)}D AS px, {(y0 + 400.5)}D AS py")
    res = geo.resolution(14)
    view = far.select("view", geo.lon_of(F.col("px") * res - geo.ORIGIN).alias("lon"), geo.lat_of(geo.ORIGIN - F.col("py") * res).alias("lat"), F.lit(300.0).alias("eye"))
    seen = march.samples(view, surface, march.Cast(16, 150.0), "view", "ray", "d", "h")
    text = plan(seen)
    assert "GreaterThanOrEqual(key" in text and "LessThanOrEqual(key" in text and re.search(r"PartitionFilters: \[[^\]]*cell", text)
    steps = sum(n for *_, n in rays.ladder(view.first()["lat"], 150.0, False))
    assert seen.count() == 16 * steps
    around = surface._around(march.sectors(view, march.Cast(16, 150.0)), march.Cast(16, 150.0)).select(*dem.BLOCK_OF).withColumn("key", pyramid.morton(*map(F.col, dem.BLOCK_OF)))
    some, most = pyramid.within(surface.blocks, pyramid.ranges(around)), surface.blocks.count()
    assert around.join(some, "key", "left_semi").count() == some.count() <= around.count() < most // 20
    scanned = int(re.search(r"number of files read: (\d+)", metrics(some)).group(1))
    assert scanned <= len(surface.blocks.inputFiles()) // 4


@pytest.mark.parametrize("points, pieces", [(1 << 14, 128), (3, 1)])
def test_copies_of_a_block_change_nothing(spark, tmp_path, monkeypatch, points, pieces):
    monkeypatch.setattr(dem, "POINT_COPY", points)
    monkeypatch.setattr(dem, "PIECE_COPY", pieces)
    path = f"{tmp_path}/{pieces}"
    pyramid.write(cells(spark, 64, value=F.lit(7000)), path, 16)
    surface = dem.Pyramid.open(spark, path, 16)
    places = spark.range(300).select("id", (F.col("id") % 70 - 3.0).alias("px"), (F.col("id") % 67 - 2.0).alias("py"), F.lit("x").alias("level"), F.lit(5).alias("copies"))
    res = 2 * 3.141592653589793 * 6378137 / 256 / 2**14
    got = surface.nearest(places, F.lit(14), F.col("px") * res - 20037508.342789244 + res / 2, F.lit(20037508.342789244) - F.col("py") * res - res / 2).collect()
    assert len(got) == 300
    for r in got:
        inside = 0 <= r["px"] < 64 and 0 <= r["py"] < 64
        assert (r["h"] == pytest.approx(200.0)) if inside else r["h"] is None


def test_a_build_shows_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/p"

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(pyramid, "move", die)
        with pytest.raises(RuntimeError):
            pyramid.write(cells(spark, 16), path, 16)
    assert not (tmp_path / "p").exists()
    pyramid.write(cells(spark, 16), path, 16)
    assert dem.Pyramid.open(spark, path, 16).levels == [14]
    with pytest.raises(FileExistsError):
        pyramid.write(cells(spark, 16, value=F.lit(1)), path, 16)
    assert len(list(tmp_path.iterdir())) == 2  # the pyramid, and what the killed build left beside it
