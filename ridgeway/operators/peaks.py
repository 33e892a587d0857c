"""Peaks against rays: visibility and dominance of projected peaks, answered where a sector's horizon and a view's profile are at hand.

A peak asks the two rays beside it.  Sectors reach one ray further than they are wide, so one sector answers both: its horizons come
first, packed in a row, then the peaks that ask it, in any number; each is a binary search.  Nothing is stored and no ray is paired
with peaks.  For dominance the sectors pass their profiles on to their view's task, where maxima over ranges of distance bins come from a
table of maxima over powers of two, and both sides of all peaks of a batch are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import march, rays
from .dem import tasks_for
from .rays import Cast

#: Peaks times columns looked at once.
WALKED = 1 << 20


def judged(pairs: DataFrame, views: DataFrame, surface, cast: Cast, per_column: int, wraps: bool, step: float | None = None, radius: float = 3000.0) -> DataFrame:
    """Projected pairs in the frame, with ``visible`` and, if the columns' ``step`` is given, ``dominance`` (0 where not visible).

    A peak is visible if its angle reaches the horizon interpolated between the two rays beside it.  A ray without ground before the peak has no
    horizon and lets the other decide; if both have none the peak is seen.

    Dominance is how far a summit stands above the lower of the cols at its sides: a side is walked outwards until higher ground at the peak's
    depth, that ground included; columns without ground at that depth are passed over; the frame's edge ends it.
    """
    own = pairs.columns
    position = geo.snap(F.col("x") * per_column, 6)
    first = F.floor(position - 0.5).cast("int")
    first = F.pmod(first, F.lit(cast.rays)) if wraps else first
    per, inside = cast.sector_rays(), lambda r: F.greatest(F.lit(0), F.least(F.lit(cast.rays - 1), r))
    asks = pairs.filter("column IS NOT NULL").withColumn("__low", (F.floor(inside(first) / per) * per).cast("int"))
    marks = surface.along(march.sectors(views, cast, 1), cast, rays.marks, rays.MARKS)
    met = _led(asks.unionByName(marks, allowMissingColumns=True), F.col("__ends"), "view", "__low")
    # what follows from the columns at hand is made after the shuffle
    met = met.withColumns({"__first": first, "__t": geo.bracket_weight(position)})
    carried = asks.columns
    fields = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema} | {"visible": "visible boolean", "__top": "__top binary", "dominance": "dominance double"}
    schema = lambda names: ", ".join(fields[c] for c in names)
    if step is None:
        return met.mapInArrow(partial(_visible, cast=cast, wraps=wraps, names=[*own, "visible"]), schema([*own, "visible"]))
    near = F.greatest(F.col("distance") - radius, F.col("distance") * 0.5)
    far = F.least(F.col("distance") + radius, F.col("distance") * 2.0)
    window = {"__window": geo.dominance_window(F.col("distance"), step, radius), "__lo": geo.profile_bin(near), "__hi": geo.profile_bin(far)}
    seeing = partial(_visible, cast=cast, wraps=wraps)
    judging = partial(_dominant, columns=cast.rays // per_column, per_column=per_column, names=[*own, "visible"])
    if per >= cast.rays:  # a view is one sector, its profile is at hand
        names = [*carried, *window, "visible", "__top"]
        return met.withColumns(window).mapInArrow(lambda batches: judging(seeing(batches, names=names)), schema([*own, "visible", "dominance"]))
    seen = met.mapInArrow(partial(seeing, names=[*carried, "visible", "__top"]), schema([*carried, "visible", "__top"]))
    return _led(seen, F.col("__top"), "view").withColumns(window).mapInArrow(judging, schema([*own, "visible", "dominance"]))


def _led(rows: DataFrame, leads: Column, *key: str) -> DataFrame:
    """``rows`` dealt by ``key``; in each task those of one key come together, the leading ones (``leads`` isn't null) first.

    They are sorted by one number, which Spark does by radix: comparing several columns took most of the time.  Keys whose hash is the same come mixed.
    """
    order = F.xxhash64(*key).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(leads.isNull(), 1).otherwise(0).cast("bigint"))
    return rows.repartition(tasks_for(rows.sparkSession), *key).withColumn("__order", order).sortWithinPartitions("__order").drop("__order")


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), n]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _visible(batches: Iterator[pa.RecordBatch], cast: Cast, wraps: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    held, asked = {}, False
    for batch in batches:
        view, low = (batch.column(c).to_numpy() for c in ("view", "__low"))
        first, t, distance, altitude = (_numbers(batch, c) for c in ("__first", "__t", "distance", "altitude"))
        marks = batch.column("__ends")
        level, leads = np.full(batch.num_rows, np.nan), marks.is_valid().to_numpy(zero_copy_only=False)
        for a, b in _runs(view, low, leads):
            key = (view[a], low[a])
            if leads[a]:
                held = {} if asked else held
                held[key] = [np.array(batch.column(c)[a].values.to_numpy()) for c in ("__at", "__rise", "__ends")]
            elif key in held:
                level[a:b] = _horizon(*held[key], first[a:b].astype(np.int64), int(low[a]), distance[a:b], t[a:b], cast.rays, wraps)
            asked = not leads[a]
        made = {"visible": pa.array(np.isnan(level) | (altitude >= level))}
        out = pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)
        yield out if "__top" in names else out.filter(marks.is_null())


def _horizon(at: np.ndarray, rise: np.ndarray, ends: np.ndarray, first: np.ndarray, low: int, distance: np.ndarray, t: np.ndarray, n: int, wraps: bool) -> np.ndarray:
    """The angle to reach at each position; NaN without ground before it.  ``ends`` bounds each ray's rises."""
    beside = np.full((2, len(first)), np.nan)
    for slot in (0, 1):
        ray = first + slot - low
        fits = (ray >= 0) & (ray < len(ends) - 1)
        if not wraps:
            fits &= (first + slot >= 0) & (first + slot < n)
        for r in np.unique(ray[fits]):
            ask = np.flatnonzero(fits & (ray == r))
            # of samples that end before the peak the last rise is the highest
            k = np.searchsorted(at[ends[r] : ends[r + 1]], distance[ask])
            beside[slot, ask[k > 0]] = rise[ends[r] + k[k > 0] - 1]
    a, b = beside
    scale = 10.0**9 * (1 + 2.0**-52)
    both = np.rint((a + (b - a) * t) * scale) / 10.0**9
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, both))


def _dominant(batches: Iterator[pa.RecordBatch], columns: int, per_column: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    tops, maxima, asked = {}, {}, False
    for batch in batches:
        view, low = (batch.column(c).to_numpy() for c in ("view", "__low"))
        marks, seen = batch.column("__top"), batch.column("visible").to_numpy(zero_copy_only=False)
        ele, column, window, lo, hi = (_numbers(batch, c) for c in ("ele", "column", "__window", "__lo", "__hi"))
        out, leads = np.zeros(batch.num_rows), marks.is_valid().to_numpy(zero_copy_only=False)
        for a, b in _runs(view, leads):
            if leads[a]:
                tops, maxima = ({}, {}) if asked else (tops, maxima)
                whole = tops.setdefault(view[a], np.full((columns * per_column, geo.PROFILE_BINS), -np.inf, np.float32))
                for i in range(a, b):
                    rows = np.frombuffer(marks[i].as_py(), np.float32).reshape(-1, geo.PROFILE_BINS)[:-1][: len(whole) - low[i]]  # without the ray beyond
                    whole[low[i] : low[i] + len(rows)] = np.where(np.isnan(rows), -np.inf, rows)
            elif view[a] in tops:
                if view[a] not in maxima:
                    maxima[view[a]] = _range_maxima(tops[view[a]].reshape(columns, per_column, -1).max(axis=1))
                ask = a + np.flatnonzero(seen[a:b])
                c0 = np.minimum(column[ask] // per_column, columns - 1).astype(np.int64)
                out[ask] = _walked(maxima[view[a]], ele[ask], c0, window[ask].astype(np.int64), lo[ask].astype(np.int64), hi[ask].astype(np.int64))
            asked = not leads[a]
        made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], names=[*names, "dominance"])
        yield made.filter(marks.is_null())


def _range_maxima(tops: np.ndarray) -> list[np.ndarray]:
    """Table j holds the maximum of 2^j bins from each bin on."""
    tables = [tops]
    while 1 << len(tables) <= tops.shape[1]:
        half = 1 << len(tables) - 1
        tables.append(np.maximum(tables[-1][:, :-half], tables[-1][:, half:]))
    return tables


def _walked(maxima: list[np.ndarray], ele: np.ndarray, c0: np.ndarray, window: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The dominance of summits at columns ``c0`` over bins [lo, hi]."""
    out, n = np.zeros(len(ele)), len(maxima[0])
    each = max(1, WALKED // max(1, int(window.max(initial=1))))
    power = np.floor(np.log2(np.maximum(hi - lo + 1, 1))).astype(np.int64)
    for i in range(0, len(ele), each):
        some = slice(i, i + each)
        k = np.arange(1, int(window[some].max(initial=1)) + 1)
        cols = np.full(len(ele[some]), -np.inf)
        for way in (-1, 1):
            col = c0[some, None] + way * k
            ok = (k <= window[some, None]) & (col >= 0) & (col < n) & (hi[some] >= lo[some])[:, None]
            ground = np.full(col.shape, -np.inf)
            for j in np.unique(power[some]):
                p, q = np.nonzero(ok & (power[some] == j)[:, None])
                table, c = maxima[j], col[p, q]
                ground[p, q] = np.maximum(table[c, lo[some][p]], table[c, hi[some][p] - (1 << j) + 1])
            over = ground > ele[some, None]
            end = np.where(over.any(axis=1), over.argmax(axis=1), len(k))
            walked = np.isfinite(ground) & (np.arange(len(k)) <= end[:, None])
            side = np.where(walked, ground, np.inf).min(axis=1)
            cols = np.maximum(cols, np.where(np.isfinite(side), side, -np.inf))
        out[some] = np.where(np.isfinite(cols), ele[some] - cols, 0.0)
    return out
