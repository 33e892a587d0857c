"""Closed-form functions: properties that follow from their definitions, and round trips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeway.functions import geo

RNG = random.Random(11)


def column(spark, values, f, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_depth_codes_are_logarithmic_between_their_ends(spark):
    share = [k / 40 for k in range(41)]
    codes = column(spark, [10 * 40000.0**t for t in share], geo.encode_depth)
    assert codes == pytest.approx([1 + t * 65534 for t in share], abs=0.51)
    assert column(spark, [-3.0, 9.99, 4.1e5, 1e9], geo.encode_depth) == [1, 1, 65535, 65535]
    assert column(spark, [None, float("nan"), float("inf")], geo.encode_depth) == [0, 0, 0]
    back = column(spark, codes, geo.decode_depth, "int")
    assert back == pytest.approx([10 * 40000.0**t for t in share], rel=1e-4) and column(spark, [0], geo.decode_depth, "int") == [None]


def test_quantised_codes_are_the_lower_ends_of_steps(spark):
    codes = sorted(RNG.sample(range(1, 65536), 60))
    for step in (0, 1, 6, 40, 999):
        q = column(spark, [0, *codes], lambda c: geo.quantise_depth(c, F.lit(step)), "int")
        low = max(step, 1)
        assert q[0] == 0 and q[1:] == [max(s for s in range(1, v + 1, low)) for v in codes]


def test_profile_bins_part_the_logarithm_evenly(spark):
    mids = [10 * math.exp((k + 0.5) / 255 * math.log(40000)) for k in range(255)]
    assert column(spark, mids, geo.profile_bin) == list(range(255))
    assert column(spark, [0.0, 3.3, 4.1e5, 7e7], geo.profile_bin) == [0, 0, 255, 255]


def test_bracketing_rays_enclose_the_position(spark):
    cases = [(RNG.uniform(0, n), n, w) for n in (1, 5, 36) for w in (True, False) for _ in range(12)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p double, n int, w boolean").orderBy("i")
    for r in rows.select("p", "n", "w", geo.bracket(F.col("p"), F.col("n"), F.col("w")).alias("b"), geo.bracket_weight(F.col("p")).alias("t")).collect():
        low = r["p"] - 0.5 - r["t"]  # ray k looks along k + 0.5
        assert 0 <= r["t"] < 1 and math.isclose(low, round(low), abs_tol=1e-9)
        want = [round(low), round(low) + 1]
        want = [k % r["n"] for k in want] if r["w"] else [k if 0 <= k < r["n"] else None for k in want]
        assert [x["ray"] for x in r["b"]] == want


def test_dither_is_centred_and_bounded(spark):
    grid = spark.range(150 * 90).select((F.col("id") % 150).alias("x"), F.floor(F.col("id") / 150).alias("y"))
    v = [r[0] for r in grid.select(geo.dither(F.col("x"), F.col("y"))).collect()]
    assert abs(sum(v) / len(v)) < 0.01 and max(map(abs, v)) <= 1 and len(set(v)) > 1000
    near = sum(abs(x) < 0.25 for x in v) / len(v)  # a triangle holds 7/16 of its mass there
    assert abs(near - 7 / 16) < 0.04


def test_colours_of_three_and_six_digits(spark):
    good = {"#12aBcd": (18, 171, 205), "fedcba": (254, 220, 186), " #9f3 ": (153, 255, 51), "##808080": (128, 128, 128)}
    bad = ["#", "a", "#abcd", "red", "#12345g", "12345678"]
    got = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string")
    rows = [tuple(r) for r in got.select(*geo.parse_colour(F.col("s")).values()).collect()]
    assert rows == [*good.values(), *[(None,) * 3] * len(bad)]


def test_destinations_lie_at_their_distance_and_bearing(spark):
    pts = [(RNG.uniform(-170, 170), RNG.uniform(-70, 70), RNG.uniform(0, 360), RNG.uniform(100, 3e5)) for _ in range(40)]
    df = spark.createDataFrame(pts, "a double, b double, az double, d double")
    lon, lat = geo.destination(F.col("a"), F.col("b"), F.col("az"), F.col("d"))
    df = df.select("*", lon.alias("x"), lat.alias("y"))
    way = (F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    for r in df.select("az", "d", geo.great_circle(*way).alias("d2"), geo.initial_bearing(*way).alias("az2")).collect():
        assert math.isclose(r["d"], r["d2"], rel_tol=1e-6) and abs((r["az"] - r["az2"] + 180) % 360 - 180) < 1e-6
    quarter = spark.range(1).select(geo.great_circle(*map(geo.num, (0, 0, 90, 0)))).first()[0]
    assert math.isclose(quarter, math.pi / 2 * 6371000)


def test_curvature_is_quadratic_and_weakened_by_refraction(spark):
    d = [1000.0, 3000.0, 12000.0]
    assert column(spark, d, geo.curvature_drop) == pytest.approx([x * x / (2 * 6371000) * 0.87 for x in d])


def test_levels_are_the_coarsest_that_suffice(spark):
    for lat in (0.0, 49.0, 66.0):
        d = [RNG.uniform(1, 4e5) for _ in range(50)]
        cell = {z: geo.resolution(z) * math.cos(math.radians(lat)) for z in range(8, 15)}
        want = [min([z for z in cell if cell[z] <= x * 0.00087], default=14) for x in d]
        assert column(spark, d, lambda c, at=lat: geo.level_for(c, geo.num(at), geo.Grid())) == want


def test_texts(spark):
    row = spark.sql("SELECT 'two words' AS s, 'plain_1.txt' AS t, ' -12' AS p, '1e3' AS q")
    got = row.select(geo.shell_quote(F.col("s")), geo.shell_quote(F.col("t")), geo.priority_of(F.col("p")), geo.priority_of(F.col("q")), geo.content_type(F.lit("d.gz"))).first()
    assert tuple(got) == ("'two words'", "plain_1.txt", -12, 0, "application/gzip")


def test_nodata_is_shown_in_its_shortest_form(spark):
    cases = {None: "none", -9999.0: "-9999", 0.5: "0.5", 1e6: "1e6", -32768.0: "-32768", 1234567.0: "1.234567e6", -3.4028234663852886e38: "-3.4028234663852886e38"}
    assert column(spark, list(cases), geo.nodata_text) == list(cases.values())
    small = {0.0001: "0.0001", -0.000125: "-0.000125", 3e-7: "0.0000003", 0.00099: "0.00099", 0.001: "0.001", 0.0: "0", 1.5e-10: "0.00000000015"}
    assert column(spark, list(small), geo.nodata_text) == list(small.values())


def test_snap_rounds_halves_away_from_zero(spark):
    assert column(spark, [0.125, -0.125, 2.4449, float("nan")], lambda c: geo.snap(c, 2))[:3] == [0.13, -0.13, 2.44]
