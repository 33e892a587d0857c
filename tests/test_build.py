"""Layer A builds: a plain model of small tiles, what killed builds leave, second builds, sources by priority."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.functions import geo
from ridgeway.operators import build, dem
from ridgeway.sources import pyramid

GRID = geo.Grid(tile_px=32, block_px=8, finest=14, coarsest=12)
RES = geo.resolution(14)
TX, TY = 72000, 44000


def source(name="s", **more):
    """One whose cells are the pixels of tiles from (TX, TY) on."""
    return build.Source(name, "EPSG:3857", TX * GRID.span - geo.ORIGIN, geo.ORIGIN - TY * GRID.span, RES, 14, **more)


def raster(spark, v, name="s"):
    rows = [(name, x, y, float(v[y, x])) for y in range(v.shape[0]) for x in range(v.shape[1]) if not np.isnan(v[y, x])]
    return spark.createDataFrame(rows, "source_id string, x int, y int, v double")


def plan(spark, tiles, name="s"):
    return spark.createDataFrame([(name, TX + i, TY + j) for i, j in tiles], "source_id string, tx int, ty int")


def found(spark, root):
    """{(source, level): {(x, y): code}}, places counted from the first tile."""
    out = {}
    for r in build.cells_of(build.read(spark, root), GRID.block_px).collect():
        cut = 14 - r["level"]
        out.setdefault((r["source_id"], r["level"]), {})[r["x"] - (TX * 32 >> cut), r["y"] - (TY * 32 >> cut)] = r["v"]
    return out


def halves(v):
    four = v.reshape(v.shape[0] // 2, 2, -1, 2).astype(float)
    n = (four > 0).sum(axis=(1, 3))
    return np.where(n > 0, np.floor(four.sum(axis=(1, 3)) / np.maximum(n, 1) + 0.5), 0)


def test_tiles_equal_a_plain_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "LEVELS_A_GROUP", 1)  # two groups one after another
    rng = np.random.default_rng(3)
    v = np.round(rng.uniform(-600, 4000, (64, 64)), 2)
    v[rng.random(v.shape) < 0.3] = -9999
    v[10:30, 10:30] = -9999
    v[:, 28:36] = np.nan  # over an edge of tiles: each side fills from its own tile
    runs = build.build(raster(spark, v), [source(nodata=-9999.0, fill=3)], plan(spark, [(0, 0), (1, 0), (0, 1)]), f"{tmp_path}/a", GRID)
    assert 1 <= len(runs) <= 4
    want = np.zeros((64, 64), int)
    for y in range(64):
        for x in range(64):
            if x >= 32 and y >= 32:
                continue  # not planned
            here = v[y, x]
            if np.isnan(here) or here == -9999:
                some = [(np.hypot(i, j) ** -1, v[y + j, x + i]) for j in range(-3, 4) for i in range(-3, 4) if 0 < i * i + j * j <= 9 and (y + j) // 32 == y // 32 and (x + i) // 32 == x // 32 and 0 <= y + j and 0 <= x + i]
                some = [(w, h) for w, h in some if h != -9999 and not np.isnan(h)]
                if not some:
                    continue
                here = sum(w * h for w, h in some) / sum(w for w, _ in some)
            want[y, x] = min(65535, max(0, np.floor(round((here + 500) * 10, 4) + 0.5)))
    got = found(spark, f"{tmp_path}/a")
    for level in (14, 13, 12):
        assert got["s", level] == {(x, y): want[y, x] for y, x in zip(*np.nonzero(want))}
        want = halves(want)


def test_a_killed_build_shows_nothing_and_the_next_goes_on(spark, tmp_path, monkeypatch):
    root, v = f"{tmp_path}/a", np.full((32, 64), 100.0)
    cells, tiles = raster(spark, v), plan(spark, [(0, 0), (1, 0), (5, 5)])
    go = lambda: build.build(cells, [source()], tiles, root, GRID, 1)
    commit, done = build.commit, []

    def die(*of):
        if done:
            raise RuntimeError("killed")
        done.append(commit(*of))

    with monkeypatch.context() as m:
        m.setattr(build, "commit", die)  # between the blocks and the manifest of the second tile
        with pytest.raises(RuntimeError):
            go()
    assert build.built(spark, root).count() == 1 and len(found(spark, root)["s", 14]) == 32 * 32
    assert len(go()) == 2 and len(found(spark, root)["s", 14]) == 2 * 32 * 32
    assert {(r["tx"] - TX, r["ty"] - TY): r["blocks"] for r in build.built(spark, root).collect()} == {(0, 0): 21, (1, 0): 21, (5, 5): 0}
    files = sorted(p for p in (tmp_path / "a").rglob("*.parquet"))
    assert go() == [] and sorted((tmp_path / "a").rglob("*.parquet")) == files
    assert len(build.sweep(spark, root)) == 1 and build.sweep(spark, root) == []
    assert len(found(spark, root)["s", 14]) == 2 * 32 * 32


def test_two_builds_at_once_count_once(spark, tmp_path, monkeypatch):
    root, cells, tiles = f"{tmp_path}/a", raster(spark, np.full((32, 32), 7.0)), plan(spark, [(0, 0)])
    with monkeypatch.context() as m:
        m.setattr(build, "built", lambda spark, root: spark.createDataFrame([], build.MANIFEST).select(*build.TILE))
        for _ in range(2):
            build.build(cells, [source()], tiles, root, GRID)
    assert spark.read.parquet(f"{root}/manifest").count() == 2
    assert build.built(spark, root).count() == 1 and build.read(spark, root).filter("level = 14").count() == 16


def test_unknown_sources_and_grids_fail(spark, tmp_path):
    cells = raster(spark, np.ones((2, 2)))
    with pytest.raises(KeyError, match="t"):
        build.build(cells, [source()], plan(spark, [(0, 0)], "t"), f"{tmp_path}/a", GRID)
    with pytest.raises(ValueError, match="smaller than a block"):
        build.build(cells, [source()], plan(spark, [(0, 0)]), f"{tmp_path}/a", geo.Grid(32, 8, 14, 11))
    with pytest.raises(ValueError, match="projection"):
        build.Source("s", "EPSG:5514", 0, 0, 1, 14)
    assert build.build(cells.limit(0), [source()], plan(spark, []), f"{tmp_path}/a", GRID) == [] and build.read(spark, f"{tmp_path}/a").count() == 0


def test_a_region_beneath_a_source_becomes_a_pyramid(spark, tmp_path):
    """From rasters to a surface: a fallback in degrees under a source that covers a part of it."""
    lon, lat = (TX + 0.5) * GRID.span / geo.ORIGIN * 180 - 180, 49.0
    ty = int((geo.ORIGIN - np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * geo.MERCATOR_RADIUS) / GRID.span)
    under = build.Source("under", "EPSG:4326", lon - 0.01, lat + 0.01, 0.0001, 13, resampling="bilinear")
    over = build.Source("over", "EPSG:3857", TX * GRID.span - geo.ORIGIN, geo.ORIGIN - ty * GRID.span, RES, 14)
    root = f"{tmp_path}/a"
    build.region(raster(spark, np.full((200, 200), 300.0), "under"), under, (lon - 0.005, lat - 0.005, lon + 0.005, lat + 0.005), root, GRID)
    build.build(raster(spark, np.full((32, 32), 800.0), "over"), [over], spark.createDataFrame([("over", TX, ty)], "source_id string, tx int, ty int"), root, GRID)
    cells = build.cells_of(build.read(spark, root), GRID.block_px).withColumn("priority", F.when(F.col("source_id") == "over", 20).otherwise(10)).withColumnRenamed("v", "value")
    pyramid.write(dem.mosaic(cells, "level", "x", "y").withColumnRenamed("value", "v"), f"{tmp_path}/p", GRID.block_px)
    surface = dem.Pyramid.open(spark, f"{tmp_path}/p", GRID.block_px)
    at = spark.createDataFrame([(0, (TX + 0.5) * GRID.span - geo.ORIGIN, geo.ORIGIN - (ty + 0.5) * GRID.span), (1, (TX - 0.5) * GRID.span - geo.ORIGIN, geo.ORIGIN - (ty + 0.5) * GRID.span)], "k int, x double, y double")
    got = {r["k"]: (r["h"], r["z"]) for r in surface.with_height(at, ["k"], F.lit(14), F.col("x"), F.col("y"), found="z").collect()}
    assert got == {0: (pytest.approx(800.0), 14), 1: (pytest.approx(300.0), 13)}
