"""Whole panoramas and viewsheds."""

import dataclasses
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.operators import dem, march, paint, shade, views
from ridgeway.sources import pyramid, sinks


def unpacked(png):
    """The samples of a PNG written without filters."""
    w, h, depth, kind = struct.unpack(">IIBB", png[16:26])
    data = b"".join(png[at + 8 : at + 8 + n] for at, n in chunks(png) if png[at + 4 : at + 8] == b"IDAT")
    bands = {0: 1, 2: 3, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, -1)[:, 1:]
    return raw.view(">u2").reshape(h, w) if depth == 16 else raw.reshape(h, w, bands)


def chunks(png):
    at = 8
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        yield at, n
        at += n + 12


SPEC = views.Panorama(fov=90.0, step=5.0, alt_min=-10.0, alt_max=10.0, limit=900.0, ssx=2, ssy=2, most_peaks=3, depth_step=4)


@pytest.fixture(scope="module")
def shown(spark):
    v = spark.createDataFrame([(1, 20.001, 49.001), (2, 20.004, 49.003)], "view long, lon double, lat double")
    peaks = spark.createDataFrame([(k, f"p{k}", "peak", None, 20.0005 + k * 0.0004, 49.0 + k * 0.0003) for k in range(20)], "osm_id long, name string, type string, ele_osm string, plon double, plat double")
    return {k: d.toPandas() for k, d in views.panorama(v, dem.AnalyticSurface(), SPEC, peaks).items()}


def test_every_pixel_is_there_once(shown):
    for part in ("pixels", "depth"):
        p = shown[part]
        assert len(p) == 2 * SPEC.width * SPEC.height == len(p[["view", "col", "row"]].drop_duplicates())
    assert shown["pixels"][list("rgb")].stack().between(0, 255).all()
    assert shown["status"].status.tolist() == ["ok", "ok"] and shown["stats"].sky.between(0, 1).all()
    sky = shown["depth"].groupby("view").q.apply(lambda q: (q == 0).mean())  # a pixel with any ground isn't sky
    assert (sky.sort_index().to_numpy() <= shown["stats"].set_index("view").sky.sort_index().to_numpy() + 1e-9).all()


def test_peaks_are_ranked_by_dominance_within_the_frame(shown):
    p = shown["peaks"].sort_values(["view", "rank"])
    assert len(p) and p.groupby("view").size().max() <= 3 and p.visible.all() and p.x.between(0, SPEC.width).all() and p.y.between(0, SPEC.height).all()
    assert all(g.dominance.is_monotonic_decreasing for _, g in p.groupby("view"))


@pytest.mark.parametrize("spec", [dataclasses.replace(SPEC, alt_min=-70.0), dataclasses.replace(SPEC, ssx=3, ssy=1, eye_level=True, ridge=(200.0, 10.0, 0.0), ridge_width=3.0, alt_max=2.0, alt_min=-48.0, limit=2500.0)])
def test_sectors_paint_what_rows_say(spark, spec, monkeypatch):
    """The pixels of whole sectors against the operators over rows of sub-pixels."""
    monkeypatch.setattr(paint, "SECTOR_PIXELS", 500)
    v = spark.createDataFrame([(1, 20.001, 49.001, 700.0), (2, 20.004, 49.003, 900.0)], "view long, lon double, lat double, eye double")
    surface, cast = dem.AnalyticSurface(), spec.cast
    got = paint.painted(v, surface, spec).toPandas().sort_values(["view", "col", "row"]).reset_index(drop=True)
    cells = march.filled(march.samples(v, surface, cast, *march.FILLING)).cache()
    edges = shade.edge_strength(shade.full_columns(cells, v, cast.rays, cast.frame.height), spec.edge_ratio, spec.hidden_ref)
    inks = shade.ink(edges, spec.ridge_strength, 0.5 * spec.ridge_width * spec.ssy, cast.frame.height)
    fine = shade.shaded(edges, inks, spec.alt_max, cast.frame.alt_step, spec.ground, spec.ridge, spec.eye_level)
    want = shade.pixels(shade.box_average(fine, spec.ssx, spec.ssy), spec.dither).join(shade.nearest_depth(cells, spec.ssx, spec.ssy), ["view", "col", "row"], "left")
    want = want.toPandas().sort_values(["view", "col", "row"]).reset_index(drop=True)
    assert len(got) == len(want) == 2 * spec.width * spec.height and (got[["view", "col", "row"]] == want[["view", "col", "row"]]).all().all()
    assert (got[list("rgb")] == want[list("rgb")]).all().all()
    assert (got.code == want.code.fillna(0).astype(int)).all() and got.grounds.sum() == cells.count() and got.code.nunique() > 2


def test_images_hold_the_pixels(spark, shown):
    p = spark.createDataFrame(shown["pixels"])
    got = {r["view"]: unpacked(bytes(r["png"])) for r in sinks.images(p, SPEC.width, SPEC.height).collect()}
    for r in shown["pixels"].itertuples():
        assert tuple(got[r.view][r.row, r.col]) == (r.r, r.g, r.b)
    d = spark.createDataFrame(shown["depth"])
    deep = {r["view"]: unpacked(bytes(r["png"])) for r in sinks.depth_images(d, SPEC.width, SPEC.height).collect()}
    for r in shown["depth"].itertuples():
        assert deep[r.view][r.row, r.col] == r.q


def test_viewshed_of_sparse_ground(spark, tmp_path):
    """One viewpoint stands on stored ground, the other on none."""
    x, y = int((20.0 + 180) / 360 * 2**22), 1440416
    pyramid.write(spark.range(120 * 120).select(F.lit(14).alias("level"), (x - 60 + F.col("id") % 120).alias("x"), (y - 60 + F.floor(F.col("id") / 120)).alias("y"), F.lit(7000).alias("v")), f"{tmp_path}/p")
    v = spark.createDataFrame([(1, 20.0, 49.0), (2, 21.0, 49.0)], "view long, lon double, lat double")
    got = {k: d.toPandas() for k, d in views.viewshed(v, dem.Pyramid.open(spark, f"{tmp_path}/p"), 300.0, 20.0).items()}
    assert dict(zip(got["status"].view, got["status"].status)) == {1: "ok", 2: "no elevation data"}
    assert got["bounds"].view.tolist() == [1] and set(got["pixels"].view) == {1}
    assert len(got["pixels"]) > 500 and (got["pixels"].a > 0).all()  # flat ground is seen all around
    with pytest.raises(ValueError, match="no blocks"):
        pyramid.write(spark.createDataFrame([], "level int, x long, y long, v int"), f"{tmp_path}/e")
        dem.Pyramid.open(spark, f"{tmp_path}/e")


def test_overviews_average_what_is_there(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 5, (8, 8)) * 1000
    df = spark.createDataFrame([(14, x, y, int(v[y, x])) for y in range(8) for x in range(8)], "level int, x long, y long, v int")
    got = {(r["x"], r["y"]): r["v"] for r in dem.overviews(df, 13).filter("level = 13").collect()}
    for y in range(4):
        for x in range(4):
            some = [k for k in v[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].ravel() if k]
            assert got.get((x, y)) == (int(np.floor(np.mean(some) + 0.5)) if some else None)


def test_warped_cells_are_means_of_what_they_cover(spark):
    df = spark.createDataFrame([(x, y, 10 * x + y + 1) for x in range(6) for y in range(6)], "x long, y long, v int")
    got = {(r["x"], r["y"]): r["v"] for r in dem.resample_average(df, 3).collect()}
    assert got == {(i, j): 10 * (3 * i + 1) + 3 * j + 1 + 1 for i in range(2) for j in range(2)}


def test_frames_and_casts():
    p = views.Panorama(step=0.1, ssx=3, ssy=2)
    assert (p.width, p.height, p.cast.rays, p.cast.frame.height) == (3600, 380, 10800, 760)
    assert p.cast.sector_rays() * 8000 <= 2 * march.rays.SECTOR_SAMPLES


def test_a_cancelled_request_ends_and_others_go_on(spark):
    import threading
    import time

    from pyspark import InheritableThread

    from ridgeway.operators import cancel

    ended = {}

    def ask(name, rows):
        with cancel.cancellable(spark, name):
            try:
                ended[name] = spark.range(rows, numPartitions=2).selectExpr("sum(sin(id) * cos(id) * tan(id)) AS s").first() is not None
            except Exception as e:
                ended[name] = "cancel" in str(e).lower()

    slow = InheritableThread(target=ask, args=("slow", 10**12))
    slow.start()
    time.sleep(3)
    quick = InheritableThread(target=ask, args=("quick", 1000))
    quick.start()
    quick.join(60)
    assert slow.is_alive() and ended == {"quick": True}
    cancel.cancel(spark, "slow")
    slow.join(60)
    assert not slow.is_alive() and ended["slow"] and isinstance(slow, threading.Thread)
