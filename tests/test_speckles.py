"""Speckles: the query's whole rasters and their growth, and fills across the borders of blocks."""

import random

import numpy as np
import pytest

from ridgeway.operators import dem
from ridgeway.plans import registry
from ridgeway.sources import fixtures

ORDERS = 30000


def plain(v, there, r):
    """The raster with its holes (there, v = 0) filled from shifted copies of it."""
    near = np.pad(np.where(there, v, 0).astype(float), r)
    total, weight = np.zeros(v.shape), np.zeros(v.shape)
    for j in range(-r, r + 1):
        for i in range(-r, r + 1):
            if 0 < i * i + j * j <= r * r:
                part = near[r + j : r + j + v.shape[0], r + i : r + i + v.shape[1]]
                total += part * (i * i + j * j) ** -0.5
                weight += (part != 0) * (i * i + j * j) ** -0.5
    hole = there & (v == 0) & (weight > 0)
    return np.where(hole, np.floor(total / np.where(weight > 0, weight, 1) + 0.5), v).astype(int)


def test_query_takes_the_whole_window_and_every_line(spark, tmp_path):
    n = ORDERS * 3  # more lines than a raster of 320 x 240 has cells
    line = spark.range(n).selectExpr("id div 3 AS l_orderkey", "id * 31 % 1000 AS l_partkey", "id * 7919 % 1013 AS l_suppkey", "cast(1 + id % 3 * 3 AS int) AS l_linenumber")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.speckle_fill(spark, str(tmp_path)).toArrow()
    x, y, v = (got[c].to_numpy() for c in "xyv")
    size = fixtures.WINDOW
    assert len(v) == size * size + n

    wy, wx = np.mgrid[fixtures.WINDOW_Y : fixtures.WINDOW_Y + size, fixtures.WINDOW_X : fixtures.WINDOW_X + size]
    window = np.where((wx * 7 + wy * 3) % 11 == 0, 0, fixtures.surface_codes(wx, wy))
    i = np.arange(n)
    order, number = i // 3, 1 + i % 3 * 3
    s = (i * 7919 % 1013) * 37 + number
    at = 7 * (order // size) + number - 1, order % size
    lines, there = np.zeros((7 * (ORDERS // size + 1), size), int), np.zeros((7 * (ORDERS // size + 1), size), bool)
    lines[at], there[at] = np.where(s % 10 == 0, 0, 5000 + s % 3000), True
    assert (window == 0).sum() > 200000 and (lines[at] == 0).sum() > n / 12

    far = x >= fixtures.WINDOW_X
    out = np.full(window.shape, -1)
    out[y[far] - fixtures.WINDOW_Y, x[far] - fixtures.WINDOW_X] = v[far]
    assert (out == plain(window, np.ones_like(window, bool), 5)).all()
    out = np.zeros(lines.shape, int)
    out[y[~far], x[~far]] = v[~far]
    assert (out == plain(lines, there, 5)).all()


@pytest.mark.parametrize("radius", [1, 5, 150])
def test_fills_cross_borders_of_blocks(spark, radius):
    rng = random.Random(radius)
    edge = dem.FILL_SIDE
    some = {(rng.randrange(-8, 8) + e * edge, rng.randrange(-8, 8) + f * edge) for e in (-1, 0, 1) for f in (0, 1) for _ in range(60)}
    cells = [(x, y, rng.choice([0, 0, None, *range(-50, 6000, 7)])) for x, y in sorted(some)] + [(9 * edge, 9 * edge, 0)]
    cells += [next(c for c in cells if c[2]), (None, 3, 0), (None, 3, 7), (edge, None, 0), (None, None, None)]  # a cell twice, and cells without a place
    want = []
    for x, y, v in cells:
        f = v
        if v == 0 and None not in (x, y):
            near = [((x - a) ** 2 + (y - b) ** 2, c) for a, b, c in cells if c and None not in (a, b)]
            near = [(d**-0.5, c) for d, c in near if 0 < d <= radius * radius]
            f = int(np.floor(abs(m := sum(w * c for w, c in near) / sum(w for w, _ in near)) + 0.5) * np.sign(m)) if near else v
        want.append((x, y, f))
    got = dem.fill_speckles(spark.createDataFrame(cells, "x bigint, y bigint, v int"), radius)
    assert got.schema.simpleString() == "struct<x:bigint,y:bigint,v:int>"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
