"""Finished pixels of a sector of rays: fill, silhouettes, ink, haze, eye line, box average, dither and depth on the sector's arrays.

The same picture as ``shade`` makes of rows, where every sub-pixel is a row that passes joins and windows.  Sectors are as wide as whole pixels, so
none needs another's rays, and only pixels leave the task.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import geo
from . import march, rays
from .shade import FADE_MORE, FADE_NEAR, LEAST_RATIO, LINE_ADD, LINE_SHARE, WHOLE

SCHEMA = "view bigint, col int, row int, r int, g int, b int, code int, grounds int"
AVERAGES = "view bigint, col int, row int, r double, g double, b double, dist double"
#: Sub-pixels of a sector.
SECTOR_PIXELS = 1 << 18


def painted(views: DataFrame, surface, spec) -> DataFrame:
    """SCHEMA of every pixel of the views with an eye: colours, depth code (0: sky) and how many of its sub-pixels show ground.

    ``spec`` is a ``views.Panorama``.
    """
    return _along(views, surface, spec, _pixels, SCHEMA)


def averaged(views: DataFrame, surface, spec) -> DataFrame:
    """AVERAGES of every pixel of the views with an eye: colours before dither, and the nearest ground of its sub-pixels (null: sky)."""
    return _along(views, surface, spec, _averages, AVERAGES)


def subpixels(views: DataFrame, surface, spec, *columns: str) -> DataFrame:
    """(view, ray, row) of every sub-pixel of the views with an eye, with the wanted columns of dist (null: sky), cover, edge, ink, r, g, b."""
    return _along(views, surface, spec, partial(_subpixels, columns=columns), "view bigint, ray int, row int" + "".join(f", {c} double" for c in columns))


def _along(views: DataFrame, surface, spec, emit, schema: str) -> DataFrame:
    cast = spec.cast
    most = max(1, SECTOR_PIXELS // cast.frame.height // spec.ssx) * spec.ssx
    return surface.along(march.sectors(views, cast, per=min(most, max(spec.ssx, cast.sector_rays() // spec.ssx * spec.ssx))), cast, partial(emit, spec=spec), schema)


def columns(sector: rays.Sector, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, cover) of all rows of the sector's columns; sky has distance NaN and cover 0."""
    frame = sector.cast.frame
    dist, cover = np.full((len(sector.ray), frame.height), np.nan), np.zeros((len(sector.ray), frame.height))
    s = rays.samples(sector, h, ["ray", "d", "f", "prev", "lv"])
    ray, d, f, prev, lv = (s[c].to_numpy(zero_copy_only=False) for c in ("ray", "d", "f", "prev", "lv"))
    some = np.floor(f) < prev
    ray, d, f, prev, lv = (x[some] for x in (ray, d, f, prev, lv))
    first = np.floor(f).astype(np.int64)
    n = prev - first
    which = np.repeat(np.arange(len(n)), n)
    row = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
    top, d, lv, f = np.ceil(f)[which], d[which], lv[which], f[which]
    ramp = d + (lv - d) * (row - top) / np.maximum(prev[which] - top, 1)
    partial = row < f
    at = (ray[which] - sector.ray[0], row)
    dist[at] = np.where(~partial & (d <= lv * 1.05), ramp, d)
    cover[at] = np.where(partial, row + 1 - f, 1.0).astype(np.float32)
    return dist, cover


def _log(x: np.ndarray) -> np.ndarray:
    """Logarithms of what is positive, else NaN, by the C library: numpy's own are off in some last digits, and a ridge's step up may equal its step down."""
    out, some = np.full(x.shape, np.nan), x > 0
    out[some] = np.fromiter(map(math.log, x[some].tolist()), float)
    return out


def edges(dist: np.ndarray, ratio: float, hidden_ref: float) -> np.ndarray:
    """How much the silhouette at a sub-pixel hides, gated by how far the step up exceeds the step down."""
    with np.errstate(invalid="ignore", over="ignore"):
        here = _log(dist)
        beside = np.pad(here, ((0, 0), (1, 1)), constant_values=np.nan)
        up, down = beside[:, :-2] - here, np.fmax(0.0, here - beside[:, 2:])
        gate = np.clip((up - down) / math.log(max(ratio, LEAST_RATIO)), 0, 1)
        edge = np.where(up <= 0, 0.0, gate * np.sqrt(np.clip(dist * np.expm1(up) / hidden_ref, 0, 1)))
    edge = np.where(np.isnan(beside[:, :-2]), 1.0, edge)
    edge[:, 0] = 1.0
    return np.where(np.isnan(dist), 0.0, edge)


def ink(dist: np.ndarray, cover: np.ndarray, edge: np.ndarray, strength: float, half_width: float) -> np.ndarray:
    """Strokes of a width around each edge's sub-pixel height, spread by overlap."""
    out, height = np.zeros(dist.shape), dist.shape[1]
    i, row = np.nonzero(edge > 0)
    fade = FADE_NEAR + FADE_MORE * (1 - np.exp(-dist[i, row] / geo.HAZE))
    amount, at = edge[i, row] * (1 - fade) * strength, row + (1 - cover[i, row])
    low, high = at - half_width, at + half_width
    first = np.maximum(0, np.floor(low)).astype(np.int64)
    last = np.minimum(np.ceil(high), height).astype(np.int64)
    for k in range(int((last - first).max(initial=0))):
        y = first + k
        over = np.minimum(high, y + 1.0) - np.maximum(low, y)
        go = (y < last) & (over > 0)
        np.add.at(out, (i[go], y[go]), amount[go] * over[go])
    return out


def _sky(row: np.ndarray, alt_max: float, alt_step: float) -> np.ndarray:
    t = np.clip((alt_max - (row + 0.5) * alt_step) / 30.0, 0, 1)
    return np.stack([a + (b - a) * t for a, b in zip(geo.SKY_LOW, geo.SKY_HIGH)], axis=-1)


def _surface(dist: np.ndarray, sky: np.ndarray, ground: tuple[float, float, float]) -> np.ndarray:
    t = 1 - np.exp(-dist / geo.HAZE)[..., None]
    return np.where(np.isnan(t), sky, np.array(ground) + (sky - np.array(ground)) * t)


def colours(dist: np.ndarray, cover: np.ndarray, strokes: np.ndarray, spec) -> np.ndarray:
    """(rays, rows, 3) colours of sub-pixels."""
    frame, rows = spec.cast.frame, np.arange(dist.shape[1])
    sky = _sky(rows, frame.alt_max, frame.alt_step)[None]
    front = _surface(dist, sky, spec.ground)
    behind = np.pad(dist, ((0, 0), (1, 0)), constant_values=np.nan)[:, :-1]
    back = _surface(behind, _sky(rows - 1, frame.alt_max, frame.alt_step)[None], spec.ground)
    back[:, 0] = sky[:, 0]
    out = np.where((~np.isnan(dist) & (cover < WHOLE))[..., None], back + (front - back) * cover[..., None], front)
    out = out + (np.array(spec.ridge) - out) * np.clip(strokes, 0, 1)[..., None]
    if spec.eye_level:
        line = np.abs(frame.alt_max - (rows + 0.5) * frame.alt_step) < frame.alt_step * 0.5
        out[:, line] = out[:, line] * LINE_SHARE + LINE_ADD
    return out


def _noise(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    inner = u * 0.06711056 + v * 0.00583715
    outer = 52.9829189 * (inner - np.floor(inner))
    return outer - np.floor(outer)


def levels(mean: np.ndarray, col: np.ndarray, row: np.ndarray, strength: float) -> np.ndarray:
    """Eight-bit levels: dithered, clamped, rounded."""
    noise = _noise(col, row) - _noise(row * 1.7 + 11.0, col * 0.9 + 23.0)
    return np.floor(np.clip(np.round(mean, 6) + noise[..., None] * strength, 0, 255) + 0.5).astype(np.int32)


def depth_codes(near: np.ndarray) -> np.ndarray:
    """Depth codes of distances; NaN and infinity are sky."""
    share = np.clip(np.log(np.maximum(near, geo.DEPTH_NEAR) / geo.DEPTH_NEAR) / geo.DEPTH_SPAN, 0, 1)
    return np.where(np.isfinite(near), 1 + np.floor(np.where(np.isfinite(near), share, 0) * 65534.0 + 0.5), 0).astype(np.int32)


def _stroked(sector: rays.Sector, h: np.ndarray, spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distance, cover, edge, ink) of all sub-pixels of the sector."""
    dist, cover = columns(sector, h)
    edge = edges(dist, spec.edge_ratio, spec.hidden_ref)
    return dist, cover, edge, ink(dist, cover, edge, spec.ridge_strength, 0.5 * spec.ridge_width * spec.ssy)


def _subpixels(sector: rays.Sector, h: np.ndarray, spec, columns: tuple[str, ...]) -> pa.RecordBatch:
    made = dict(zip(("dist", "cover", "edge", "ink"), _stroked(sector, h, spec)))
    if {"r", "g", "b"} & set(columns):
        made |= zip("rgb", np.moveaxis(colours(made["dist"], made["cover"], made["ink"], spec), -1, 0))
    ray, row = np.meshgrid(sector.ray.astype(np.int32), np.arange(made["dist"].shape[1], dtype=np.int32), indexing="ij")
    flat = [np.full(ray.size, sector.view), ray.ravel(), row.ravel(), *(made[c].ravel() for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(x, mask=np.isnan(x) if x.dtype == float else None) for x in flat], names=["view", "ray", "row", *columns])


def _reduced(sector: rays.Sector, h: np.ndarray, spec) -> tuple[np.ndarray, ...]:
    """(col, row, mean colours, nearest distance or infinity, sub-pixels with ground) of all pixels of the sector."""
    dist, cover, _, strokes = _stroked(sector, h, spec)
    blocks = (len(sector.ray) // spec.ssx, spec.ssx, spec.height, spec.ssy)
    mean = colours(dist, cover, strokes, spec).reshape(*blocks, 3).mean(axis=(1, 3))
    near = np.where(np.isnan(dist), np.inf, dist).reshape(blocks).min(axis=(1, 3))
    col, row = np.meshgrid(sector.ray[0] // spec.ssx + np.arange(blocks[0]), np.arange(spec.height), indexing="ij")
    return col, row, mean, near, (~np.isnan(dist)).reshape(blocks).sum(axis=(1, 3))


def _averages(sector: rays.Sector, h: np.ndarray, spec) -> pa.RecordBatch:
    col, row, mean, near, _ = _reduced(sector, h, spec)
    flat = [np.full(col.size, sector.view), *(x.ravel().astype(np.int32) for x in (col, row)), *(x.ravel() for x in np.moveaxis(mean, -1, 0))]
    arrays = [*(pa.array(x) for x in flat), pa.array(near.ravel(), mask=np.isinf(near.ravel()))]
    return pa.RecordBatch.from_arrays(arrays, names=["view", "col", "row", "r", "g", "b", "dist"])


def _pixels(sector: rays.Sector, h: np.ndarray, spec) -> pa.RecordBatch:
    col, row, mean, near, grounds = _reduced(sector, h, spec)
    rgb = levels(mean, col.astype(float), row.astype(float), spec.dither)
    flat = [np.full(col.size, sector.view), *(x.ravel().astype(np.int32) for x in (col, row, *np.moveaxis(rgb, -1, 0), depth_codes(near), grounds))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["view", "col", "row", "r", "g", "b", "code", "grounds"])
