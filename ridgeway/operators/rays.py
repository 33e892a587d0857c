"""Rays as array arithmetic inside Arrow batches: ladder, places, horizons.

Spark deals the sectors (a view's consecutive rays, sized so that rays times steps stay below ``SECTOR_SAMPLES``) to tasks;
a helper here turns one sector into its samples.  Nothing in this module knows where heights come from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from ..functions import geo

SECTOR_SAMPLES = 1 << 18
#: Steps sampled before full columns are looked for.
STRETCH = 512
GRID = geo.Grid()


@dataclass(frozen=True)
class Frame:
    """An image's rows: row r shows the angles between ``alt_max - (r + 1) * alt_step`` and ``alt_max - r * alt_step``."""

    alt_max: float
    alt_step: float
    height: int


@dataclass(frozen=True)
class Cast:
    """How a view's rays are cast.

    Without ``step`` they go all around from north; with it, ray k looks along the middle of the k-th step from ``first``.
    With a ``frame`` a ray ends at the sample that fills its column.  With a ``target`` height only samples are returned
    where a target standing on the ground shows above all ground before it.
    """

    rays: int
    limit: float
    inclusive: bool = False
    first: float = 0.0
    step: float | None = None
    frame: Frame | None = None
    target: float | None = None
    grid: geo.Grid = field(default=GRID)

    def azimuth(self, ray: np.ndarray) -> np.ndarray:
        return 360.0 * ray / self.rays if self.step is None else self.first + (ray + 0.5) * self.step

    def sector_rays(self) -> int:
        """Rays of a sector.  Cells shrink towards the poles, so the bound is taken at 60 degrees; at the grid's end a sector has six times as many samples."""
        steps = sum(n for *_, n in ladder(60.0, self.limit, self.inclusive, self.grid))
        return max(1, min(self.rays, SECTOR_SAMPLES // max(steps, 1)))


def ground_res(level: int, lat: float) -> float:
    return geo.resolution(level) * math.cos(math.radians(lat))


def ladder(lat: float, limit: float, inclusive: bool, grid: geo.Grid = GRID) -> list[tuple[int, float, float, int]]:
    """Runs (level, step, start, n) of equal steps; a level ends where the next coarser one is fine enough."""
    at, runs = ground_res(grid.finest, lat), []
    for z in range(grid.finest, grid.coarsest - 1, -1):
        step = ground_res(z, lat)
        until = ground_res(z - 1, lat) / geo.CELL_PER_METRE if z > grid.coarsest else 1e300
        steps = round((min(until, limit) - at) / step, 9)
        n = max(0, math.floor(steps) + 1 if until > limit and inclusive else math.ceil(steps))
        if n:
            runs.append((z, step, at, n))
        at += n * step
    return runs


class Sector:
    """Consecutive rays of one view: arrays by (ray, step)."""

    def __init__(self, cast: Cast, view: int, lon: float, lat: float, eye: float, low: int, high: int):
        self.cast, self.view, self.lon, self.lat, self.eye = cast, view, lon, lat, eye
        self.ray = np.arange(low, high)
        runs = ladder(lat, cast.limit, cast.inclusive, cast.grid)
        count = [n for *_, n in runs]
        self.level = np.repeat(np.array([z for z, *_ in runs], np.int32), count)
        self.step = np.repeat(np.array([s for _, s, _, _ in runs], float), count)
        self.d = np.concatenate([start + np.arange(n) * step for _, step, start, n in runs]) if runs else np.empty(0)
        self.azimuth = cast.azimuth(self.ray)

    def places(self, rays: np.ndarray | None = None, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Projected x and y: of all samples, or of single ones (position among the rays, position on the ladder)."""
        t, r = np.radians(self.azimuth), self.d / geo.EARTH_RADIUS
        return self._projected(*((t[:, None], r[None, :]) if rays is None else (t[rays], r[steps])))

    def crossing(self, rays: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projected x and y of all samples that some rays have at some steps."""
        return self._projected(np.radians(self.azimuth)[rays][:, None], (self.d / geo.EARTH_RADIUS)[steps][None, :])

    def _projected(self, t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, east = math.radians(self.lat), np.sin(r)
        sine = math.sin(p) * np.cos(r) + math.cos(p) * east * np.cos(t)
        turn = np.arctan2(np.sin(t) * east * math.cos(p), np.cos(r) - math.sin(p) * sine)
        lon, lat = self.lon + np.degrees(turn), np.degrees(np.arcsin(sine))
        return lon / 180.0 * geo.ORIGIN, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2.0)) * geo.MERCATOR_RADIUS


def pixel_of(x: np.ndarray, y: np.ndarray, level: np.ndarray | int, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """World pixel positions, less ``shift``, rounded at a millionth as the column form does."""
    res = geo.resolution(0) / np.exp2(level)
    return np.round((x + geo.ORIGIN) / res - shift, 6), np.round((geo.ORIGIN - y) / res - shift, 6)


def outwards(sector: Sector, sampled: Callable) -> np.ndarray:
    """Heights by (ray, step), asked of ``sampled(sector, rays, steps)`` stretch by stretch: a ray whose column is full isn't asked again (NaN)."""
    n, frame = len(sector.d), sector.cast.frame
    if frame is None:
        return sampled(sector, np.arange(len(sector.ray)), np.arange(n))
    h, open_, best = np.full((len(sector.ray), n), np.nan), np.arange(len(sector.ray)), np.full(len(sector.ray), -np.inf)
    for a in range(0, n, STRETCH):
        steps = np.arange(a, min(n, a + STRETCH))
        h[np.ix_(open_, steps)] = sampled(sector, open_, steps)
        tangent = angles(sector, h[open_][:, steps], at=steps)
        best[open_] = np.fmax(best[open_], np.fmax.reduce(np.round(np.degrees(np.arctan(tangent)), 9), axis=1))
        open_ = open_[row_of(best[open_], frame) >= 1]
        if not len(open_):
            break
    return h


def earlier(best: np.ndarray) -> np.ndarray:
    """The running maximum of strictly earlier samples, -inf where there are none."""
    out = np.full_like(best, -np.inf)
    np.maximum.accumulate(best[:, :-1], axis=1, out=out[:, 1:])
    return out


def last_before(mask: np.ndarray) -> np.ndarray:
    """For each sample the position of the last earlier one in the mask, -1 where there is none."""
    at = np.where(mask, np.arange(mask.shape[1]), -1)
    out = np.full(mask.shape, -1)
    np.maximum.accumulate(at[:, :-1], axis=1, out=out[:, 1:])
    return out


def row_of(alpha: np.ndarray, frame: Frame) -> np.ndarray:
    """The fractional row of an angle, 0 above the frame."""
    return np.maximum(0.0, np.round((frame.alt_max - alpha) / frame.alt_step, 9))


def angles(sector: Sector, h: np.ndarray, extra: float = 0.0, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Tangents to the eye of ground (of the steps ``at``) raised by ``extra``; rounded at 12 digits, so that engines agree where tangents tie."""
    d = sector.d[at]
    drop = d * d * (1 - geo.REFRACTION) / (2 * geo.EARTH_RADIUS)
    return np.round((h + extra - sector.eye - drop) / d, 12)


TYPES = {"view": pa.int64(), "ray": pa.int32(), "level": pa.int32(), "prev": pa.int32()}  # all others are doubles
SPARK_TYPES = {"view": "bigint", "ray": "int", "level": "int", "prev": "int"}


def schema(columns: list[str]) -> str:
    return ", ".join(f"{c} {SPARK_TYPES.get(c, 'double')}" for c in columns)


def samples(sector: Sector, h: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """The sector's samples with data (h isn't NaN), as a batch of the wanted columns.

    Of the possible columns ``horizon`` and ``skyline`` are the highest angle and tangent of strictly earlier samples,
    ``d0`` and ``h0`` the sample before, and with a frame ``f`` the fractional row of the angle, ``prev`` the first row
    already written and ``lv`` the distance of the last earlier sample that wrote rows (the first step's, if none did).
    """
    cast, frame = sector.cast, sector.cast.frame
    have = ~np.isnan(h)
    tangent = angles(sector, h)
    alpha = np.round(np.degrees(np.arctan(tangent)), 9)
    horizon = earlier(np.where(have, alpha, -np.inf))
    out = have
    if frame:
        before = row_of(horizon, frame)
        out = have & (before >= 1)
    skyline = earlier(np.where(have, tangent, -np.inf)) if cast.target is not None or "skyline" in columns else None
    if cast.target is not None:
        out = out & (angles(sector, h, cast.target) > skyline)
    i, j = np.nonzero(out)
    made: dict[str, np.ndarray] = {"view": np.full(len(i), sector.view), "lon": np.full(len(i), sector.lon), "lat": np.full(len(i), sector.lat), "ray": sector.ray[i], "azimuth": sector.azimuth[i]}
    made |= {"level": sector.level[j], "step": sector.step[j], "d": sector.d[j], "h": h[i, j], "tangent": tangent[i, j], "alpha": alpha[i, j], "horizon": horizon[i, j]}
    if skyline is not None:
        made["skyline"] = skyline[i, j]
    if {"sx", "sy"} & set(columns):
        made["sx"], made["sy"] = sector.places(i, j)
    if {"d0", "h0"} & set(columns):
        k = last_before(have)[i, j]
        made["d0"], made["h0"] = (np.where(k >= 0, v, -np.inf) for v in (sector.d[k], h[i, k]))
    if frame:
        f = row_of(alpha, frame)
        prev = np.minimum(frame.height, np.floor(before))
        wrote = last_before(out & (np.floor(f) < prev))[i, j]
        made |= {"f": f[i, j], "prev": prev[i, j].astype(np.int32), "lv": np.where(wrote >= 0, sector.d[wrote], ground_res(cast.grid.finest, sector.lat))}
    arrays = [pa.array(made[c], TYPES.get(c, pa.float64()), mask=np.isneginf(made[c]) if c in ("horizon", "skyline", "d0", "h0") else None) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, columns)


MARKS = "view bigint, __low int, __ends array<int>, __at array<double>, __rise array<double>, __top binary"


def marks(sector: Sector, h: np.ndarray) -> pa.RecordBatch:
    """One row of what peaks ask of a sector: the rises of its rays' horizons (d + step, angle; ray r's from ``__ends[r]`` on), and the highest ground
    of each ray's distance bins (single precision, NaN: none)."""
    s = samples(sector, h, ["ray", "d", "step", "alpha", "horizon", "h"])
    ray, d, step, alpha, horizon, high = (s[c].to_numpy(zero_copy_only=False) for c in ("ray", "d", "step", "alpha", "horizon", "h"))
    up = np.isnan(horizon) | (alpha > horizon)
    share = np.clip(np.log(np.maximum(d, geo.DEPTH_NEAR) / geo.DEPTH_NEAR) / geo.DEPTH_SPAN, 0, 1)
    key = (ray - sector.ray[0]).astype(np.int64) * geo.PROFILE_BINS + np.floor(share * (geo.PROFILE_BINS - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))  # samples come by ray and distance, so bins come in order
    top = np.full(len(sector.ray) * geo.PROFILE_BINS, np.nan, np.float32)
    if len(first):
        top[key[first]] = np.maximum.reduceat(high.astype(np.float32), first)
    ends = np.searchsorted(ray[up], np.append(sector.ray, sector.ray[-1] + 1))
    lists = [pa.array([v], pa.list_(t)) for v, t in ((ends.astype(np.int32), pa.int32()), ((d + step)[up], pa.float64()), (alpha[up], pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array([sector.view], pa.int64()), pa.array([sector.ray[0]], pa.int32()), *lists, pa.array([top.tobytes()], pa.binary())], ["view", "__low", "__ends", "__at", "__rise", "__top"])


def sectors_of(cast: Cast, batch: pa.RecordBatch) -> Iterator[Sector]:
    """The sectors of a batch with view, lon, lat, eye, low, high."""
    for row in zip(*(batch[c].to_pylist() for c in ("view", "lon", "lat", "eye", "low", "high"))):
        yield Sector(cast, *row)
