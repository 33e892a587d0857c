"""Rays, horizons, blocks and peaks against models written from their definitions."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeway.functions import geo
from ridgeway.operators import dem, march, peaks, rays, shade
from ridgeway.sources import pyramid, sinks

FRAME = march.Frame(6.0, 1.0, 12)
QUIET = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def written(d, angle, frame, first):
    """{row: (distance, cover)} of one ray: each row belongs to the first sample that reaches into it."""
    f = np.maximum(0.0, (frame.alt_max - angle) / frame.alt_step)
    owner = {r: next((k for k in range(len(d)) if math.floor(f[k]) <= r), None) for r in range(frame.height)}
    owners = sorted({k for k in owner.values() if k is not None})
    out = {}
    for r, k in owner.items():
        if k is not None and r < f[k]:
            out[r] = (d[k], r + 1 - f[k])
        elif k is not None:
            whole = [q for q in owner if owner[q] == k and q >= f[k]]
            nearer = d[owners[owners.index(k) - 1]] if owners.index(k) else first
            share = whole.index(r) / len(whole)
            out[r] = (d[k] + (nearer - d[k]) * share if d[k] <= 1.05 * nearer else d[k], 1.0)
    return out


@QUIET
@given(st.integers(0, 10**6))
def test_columns_are_filled_by_the_first_sample_to_reach_a_row(spark, seed):
    rng = random.Random(seed)
    cast = march.Cast(25, 200.0, frame=FRAME)
    s = rays.Sector(cast, 1, 20.0, 49.0, 500.0, 0, 25)
    angle = np.array([[rng.choice([rng.uniform(-8, 8), float(rng.randint(-6, 7))]) for _ in s.d] for _ in s.ray])
    lost = np.array([[rng.random() < 0.1 for _ in s.d] for _ in s.ray])
    drop = s.d**2 * (1 - geo.REFRACTION) / (2 * geo.EARTH_RADIUS)
    h = np.where(lost, np.nan, s.eye + drop + s.d * np.tan(np.radians(angle)))
    made = rays.samples(s, h, [*march.FILLING, "alpha", "horizon"])
    table = made.to_pandas()
    got = {k: {r["row"]: (r["dist"], r["cover"]) for _, r in g.iterrows()} for k, g in march.filled(spark.createDataFrame(pa.Table.from_batches([made]))).toPandas().groupby("ray")}
    for i in range(25):
        d, a = s.d[~lost[i]], angle[i][~lost[i]]
        want = written(d, a, FRAME, s.d[0])
        have = got.get(i, {})
        assert sorted(have) == sorted(want)
        assert all(math.isclose(have[r][0], want[r][0], rel_tol=1e-7) and abs(have[r][1] - want[r][1]) < 1e-6 for r in want)
        full = np.flatnonzero(a > FRAME.alt_max - 1)  # the sample that fills the column is the last
        mine = table[table.ray == i]
        assert len(mine) == (full[0] + 1 if len(full) else len(a))
        assert np.allclose(mine.horizon.to_numpy()[1:], np.maximum.accumulate(a)[: len(mine) - 1], atol=1e-8) and np.isnan(mine.horizon.to_numpy()[:1]).all()


def test_full_columns_are_not_sampled_on(monkeypatch):
    """A wall near the eye: rays into it ask no ground behind it, and the samples are those of whole rays."""
    monkeypatch.setattr(rays, "STRETCH", 16)
    cast, asked = march.Cast(24, 3000.0, frame=march.Frame(20.0, 1.0, 40)), []

    def ground(s, ray, step):
        asked.append(len(ray) * len(step))
        x, y = np.meshgrid(ray, step, indexing="ij")
        return np.where((x < 18) & (y == 20), 4000.0, 300.0 + x + y % 7)

    s = rays.Sector(cast, 1, 20.0, 49.0, 400.0, 0, 24)
    part = rays.outwards(s, ground)
    n, asked[:] = sum(asked), []
    whole = ground(s, np.arange(24), np.arange(len(s.d)))
    assert n < 0.4 * whole.size and np.isnan(part[:18, 32:]).all() and not np.isnan(part[18:]).any()
    names = ["ray", "d", "h", "alpha", "horizon", "f", "prev", "lv", "d0", "h0"]
    assert rays.samples(s, part, names).equals(rays.samples(s, whole, names))
    assert rays.marks(s, part).equals(rays.marks(s, whole))


def test_horizon_questions_are_strict_and_meet_two_rays():
    at, rise, ends = np.array([15.0, 25.0, 10.0]), np.array([1.0, 3.0, 5.0]), np.array([0, 2, 3, 3])
    ask = lambda first, d, t, low=0, n=3, wraps=False: peaks._horizon(at, rise, ends, np.array(first), low, np.array(d), np.array(t), n, wraps).tolist()
    assert ask([0, 0, 0, 1], [15.0, 25.0, 25.1, 99.0], [0.25] * 4) == [5.0, 2.0, 3.5, 5.0]
    assert np.isnan(ask([0, 2], [9.0, 99.0], [0.5, 0.5])).all()  # no ground before; ray 3 is outside the frame
    assert ask([-1], [99.0], [0.5]) == [3.0] and ask([5], [99.0], [0.5], 4, 100) == [5.0]


def test_marks_hold_all_rises_and_the_highest_ground_of_bins():
    s = rays.Sector(march.Cast(7, 900.0), 3, 20.0, 49.0, 600.0, 2, 7)
    h = np.random.default_rng(5).uniform(300, 900, (5, len(s.d)))
    h[3] = np.nan
    made = rays.marks(s, h).to_pylist()[0]
    top, ends = np.frombuffer(made["__top"], np.float32).reshape(5, -1), made["__ends"]
    t = [{"ray": 2 + i, "at": made["__at"][ends[i] : ends[i + 1]], "rise": made["__rise"][ends[i] : ends[i + 1]], "top": [None if np.isnan(v) else v for v in top[i]]} for i in range(5)]
    plain = rays.samples(s, h, ["ray", "d", "step", "alpha", "h"]).to_pandas()
    for row in t:
        p = plain[plain.ray == row["ray"]]
        for ask in (s.d[0], 50.0, 333.3, 2000.0):
            known = p[p.d + p.step < ask]
            assert max((a for at, a in zip(row["at"], row["rise"]) if at < ask), default=None) == (known.alpha.max() if len(known) else None)
        share = np.clip(np.log(np.maximum(p.d, 10) / 10) / math.log(40000), 0, 1)
        tops = p.h.groupby(np.floor(share * 255).astype(int)).max()
        assert {k: v for k, v in enumerate(row["top"]) if v is not None} == pytest.approx(tops.to_dict(), rel=1e-6)


@QUIET
@given(st.integers(0, 10**6))
def test_dominance_is_the_drop_to_the_higher_of_the_two_lows(seed):
    rng = random.Random(seed)
    columns, step = rng.randint(3, 15), 5.0
    ground = [rng.choice([None, rng.randint(200, 260) * 5]) for _ in range(columns)]
    asked = [(k, rng.randrange(columns), rng.randint(200, 260) * 5, rng.choice([4000.0, 20000.0])) for k in range(20)]
    tops = np.repeat(np.array([[-np.inf if g is None else g] for g in ground], np.float32), geo.PROFILE_BINS, axis=1)
    e, d, c = (np.array([p[i] for p in asked], float) for i in (2, 3, 1))
    window = np.array([round(min(20.0, max(1.0, math.degrees(math.atan(3000 / x)))) / step) for x in d])
    lo = np.array([rng.randrange(200) for _ in asked])
    got = peaks._walked(peaks._range_maxima(tops), e, c.astype(int), window, lo, lo + np.array([rng.randrange(56) for _ in asked]))
    for k, c, e, d in asked:
        reach = round(min(20.0, max(1.0, math.degrees(math.atan(3000 / d)))) / step)
        lows = []
        for side in (ground[max(0, c - reach):c][::-1], ground[c + 1:c + 1 + reach]):
            known = [g for g in side if g is not None]
            higher = [i for i, g in enumerate(known) if g > e]
            if known:
                lows.append(min(known[: higher[0] + 1] if higher else known))
        assert got[k] == (e - max(lows) if lows else 0.0)


def test_blocks_are_read_as_single_cells_say(spark, tmp_path):
    """Rays over small blocks of three levels with holes, two of them far out, against a lookup of each corner."""
    side, grid, rng = 16, geo.Grid(), np.random.default_rng(3)
    lon, lat = 20.0, 49.0
    x0, y0 = lon / 180 * geo.ORIGIN, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * geo.MERCATOR_RADIUS
    cells = {}
    for z, reach in ((14, 700.0), (13, 0.0), (12, 24000.0)):
        res = geo.resolution(z)
        cx, cy = (x0 + geo.ORIGIN) / res, (geo.ORIGIN - y0) / res
        for dx in [*range(int(-reach / res) - 1, int(reach / res) + 2), *(range(900, 1300) if z == 13 else ())]:
            for dy in range(-48 if z == 14 else -3, 48 if z == 14 else 4):
                if rng.random() < (0.97 if z != 12 else 0.999) or (z == 14 and abs(dx) < 50):
                    cells[z, int(cx) + dx, int(cy) + dy] = int(rng.integers(6000, 9000))
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "level int, x long, y long, v int")
    pyramid.write(df, f"{tmp_path}/p", side)
    surface = dem.Pyramid.open(spark, f"{tmp_path}/p", side)
    assert surface.levels == [14, 13, 12] and spark.read.parquet(f"{tmp_path}/p/hidden").count() > 0

    def corner(z, x, y):
        code = cells.get((z, x, y), 0)
        return None if code == 0 else code * 0.1 - 500.0

    def height(want, x, y):
        for z in (14, 13, 12):
            if z <= want:
                fx, fy = (round(float(v[0]), 6) for v in rays.pixel_of(np.array([x]), np.array([y]), z, 0.5))
                i, j = math.floor(fx), math.floor(fy)
                v = [corner(z, i + a, j + b) for b in (0, 1) for a in (0, 1)]
                if None not in v:
                    return (v[0] * (1 - fx + i) + v[1] * (fx - i)) * (1 - fy + j) + (v[2] * (1 - fx + i) + v[3] * (fx - i)) * (fy - j)
                if v[0] is not None:
                    return v[0]
        return None

    views = spark.createDataFrame([(7, lon, lat, 300.0)], "view long, lon double, lat double, eye double")
    cast = march.Cast(4, 20000.0, grid=grid)
    s = rays.Sector(cast, 7, lon, lat, 300.0, 0, 4)
    x, y = s.places()
    want = {(i, round(float(d), 6)): height(int(z), x[i, j], y[i, j]) for j, (d, z) in enumerate(zip(s.d, s.level)) for i in range(4)}
    got = {(r["ray"], round(r["d"], 6)): r["h"] for r in march.samples(views, surface, cast, "ray", "d", "h").collect()}
    assert set(got) == {k for k, v in want.items() if v is not None} and {k[0] for k in got if k[1] > 15000} == {1, 3}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)
    points = spark.createDataFrame([(k, int(s.level[k % len(s.d)]), float(x[1, k % len(s.d)]), float(y[1, k % len(s.d)])) for k in range(0, len(s.d), 9)], "k long, z int, x double, y double")
    for r in surface.with_height(points, ["k"], F.col("z"), F.col("x"), F.col("y")).collect():
        expect = height(r["z"], r["x"], r["y"])
        assert (r["h"] is None) == (expect is None) and (expect is None or math.isclose(r["h"], expect, abs_tol=1e-6))


def test_samples_over_a_formula_are_not_shuffled_and_over_blocks_once(spark, tmp_path):
    views = spark.createDataFrame([(1, 20.001, 49.001, 600.0)], "view long, lon double, lat double, eye double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(march.samples(views, dem.AnalyticSurface(), march.Cast(16, 300.0), "view", "ray", "alpha"))
    assert text.count("Exchange") == 1 and text.index("MapInArrow") < text.index("Exchange")
    pyramid.write(spark.createDataFrame([(14, 5, 5, 7000)], "level int, x long, y long, v int"), f"{tmp_path}/q")
    text = plan(march.samples(views, dem.Pyramid.open(spark, f"{tmp_path}/q"), march.Cast(16, 300.0), "view", "ray", "alpha"))
    assert text[: text.rindex("MapInArrow")].count("FlatMapGroupsInArrow") == 1 and text[: text.index("MapInArrow")].count("Exchange") == 1


def test_peaks_are_selected_in_order(spark):
    rows = [(0, 1, True, 3, -50.0, 10.0), (0, 2, True, 3, 200.0, 10.0), (0, 3, True, None, 900.0, 10.0), (0, 4, False, 3, 900.0, 10.0), (0, 5, True, 3, 20.0, 600.0), (0, 6, True, 3, 20.0, 601.0)]
    df = spark.createDataFrame(rows, "view long, osm_id long, visible boolean, column int, dominance double, y double")
    ids = lambda *a: [r["osm_id"] for r in march.select_peaks(df, *a, 600).orderBy("rank").collect()]
    assert ids(-1000.0, 0) == [2, 5, 1] and ids(-1000.0, 2) == [2, 5] and ids(0.0, 0) == [2, 5]


def test_ladder_grows_with_the_cells(spark):
    """Each step is a cell of the coarsest level that is fine enough there, in both forms of the ladder."""
    for lat, inclusive in ((49.0, True), (12.5, False)):
        runs = spark.range(1).select(F.explode(march.ladder(F.lit(lat), 90000.0, inclusive)).alias("r")).select("r.*").collect()
        d = np.concatenate([r["start"] + np.arange(r["n"]) * r["step"] for r in runs])
        level = np.repeat([r["level"] for r in runs], [r["n"] for r in runs])
        cell = {z: geo.resolution(z) * math.cos(math.radians(lat)) for z in range(8, 15)}
        assert math.isclose(d[0], cell[14]) and (d[-1] <= 90000.0) and d[-1] + cell[level[-1]] > 90000.0 - 1e-6
        assert np.allclose(np.diff(d), [cell[z] for z in level[:-1]])
        fine = [max([14 - z for z in cell if cell[z] <= x * geo.CELL_PER_METRE * (1 + 1e-9)], default=0) for x in d]
        assert [14 - z for z in level] == fine
        mine = rays.ladder(lat, 90000.0, inclusive)
        assert [(r["level"], r["n"]) for r in runs] == [(z, n) for z, _, _, n in mine] and np.allclose([r["start"] for r in runs], [a for _, _, a, _ in mine])


def test_range_maxima():
    rng = np.random.default_rng(9)
    tops = rng.integers(0, 99, (3, geo.PROFILE_BINS)).astype(np.float32)
    tops[rng.random(tops.shape) < 0.7] = -np.inf
    tables = peaks._range_maxima(tops)
    for _ in range(200):
        lo = int(rng.integers(0, 256))
        hi = int(rng.integers(lo, 256))
        j = int(np.log2(hi - lo + 1))
        assert (np.maximum(tables[j][:, lo], tables[j][:, hi - (1 << j) + 1]) == tops[:, lo : hi + 1].max(axis=1)).all()


@QUIET
@given(st.lists(st.lists(st.integers(0, 65535), min_size=5, max_size=5), min_size=1, max_size=4), st.sampled_from([1, 3, 50, 1000]))
def test_depth_rows_round_trip(spark, codes, step):
    df = spark.createDataFrame([(0, c, r, v) for r, row in enumerate(codes) for c, v in enumerate(row)], "view long, col int, row int, code int")
    deltas = shade.delta_rows(df, step)
    assert shade.undelta_rows(deltas).filter("back <> q").count() == 0
    data = sinks.packed_depth(deltas.select("view", "col", "row", "delta"), 5, len(codes)).first()["bytes"]
    q = sinks.unpacked_depth(bytes(data), 5, len(codes)).astype(int)
    v = np.array(codes)
    assert ((q == 0) == (v == 0)).all() and (((v - q >= 0) & (v - q < step) & ((q - 1) % step == 0)) | (v == 0)).all()


def test_mosaic_takes_the_highest_priority_with_data(spark):
    df = spark.createDataFrame([(0, 5, 10), (0, None, 30), (0, 0, 20), (1, None, 10), (2, 7, 10), (2, 8, 20)], "p int, value int, priority int")
    assert {r["p"]: (r["value"], r["priority"]) for r in dem.mosaic(df, "p").collect()} == {0: (5, 10), 2: (8, 20)}


def test_every_visible_pixel_lies_on_a_ray_that_sees_it(spark):
    views = spark.createDataFrame([(1, 20.001, 49.001, 600.0)], "view long, lon double, lat double, eye double")
    shed = march.viewshed(views, dem.AnalyticSurface(), 300.0, 20.0)
    cast = march.Cast(march.ray_count(300.0, 20.0), 300.0, True)
    v = march.visible(march.samples(views, dem.AnalyticSurface(), cast, "view", "ray", "alpha", "horizon", "sx", "sy")).filter("visible").toPandas()
    proj = 20.0 / math.cos(math.radians(49.001))
    x0, y0 = 20.001 / 180 * geo.ORIGIN - 15 * proj, math.log(math.tan(math.pi / 4 + math.radians(49.001) / 2)) * geo.MERCATOR_RADIUS + 15 * proj
    want = {(math.floor((x - x0) / proj), math.floor((y0 - y) / proj)) for x, y in zip(v.sx, v.sy)}
    assert {(r["ix"], r["iy"]) for r in shed.collect()} == {k for k in want if 0 <= k[0] < 30 and 0 <= k[1] < 30}


def test_png_and_multipart():
    data = sinks.png(np.zeros((2, 3, 3)))
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND\xaeB`\x82")
    head, body = sinks.multipart([("meta", None, "application/json", b"{}"), ("image", "a.png", "image/png", data)], 3)
    assert head["x-queue-depth"] == "3" and body.count(b"--panorama-parts") == 3 and data in body
