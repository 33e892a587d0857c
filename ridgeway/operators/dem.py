"""Raster operators over long tables: sampling, level fallback, priority mosaic, overviews, resampling, speckle fill."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import geo
from ..sources import pyramid as store
from ..sources import stage
from ..sources.fixtures import surface_code, surface_codes
from . import rays

GRID = geo.Grid()
BLOCK_OF = ["__level", "__bx", "__by"]
#: Questions to one copy of a block: points, and pieces of sectors.
POINT_COPY, PIECE_COPY = 1 << 14, 128
#: Cells along a block in which speckles are filled.
FILL_SIDE = 128


def tasks_for(spark: SparkSession) -> int:
    """Tasks for rows that are few and much work, which adaptive merging leaves alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def pixel(x: Column, y: Column, level: Column) -> tuple[Column, Column]:
    """World pixel of a projected point (rounded at a millionth, so that engines agree at edges)."""
    res = geo.level_res(level)
    return F.floor(geo.snap((x + geo.ORIGIN) / res, 6)), F.floor(geo.snap((geo.num(geo.ORIGIN) - y) / res, 6))


class AnalyticSurface:
    """A surface given by a formula, with data everywhere: sampling is arithmetic, nothing is joined or shuffled."""

    def code(self, level: Column, px: Column, py: Column) -> Column:
        up = F.pow(geo.num(2), 13 - level)
        full = lambda p: F.when(level >= 14, p).otherwise(((2 * p + 1) * up).cast("long"))
        return surface_code(full(px), full(py))

    def with_height(self, df: DataFrame, key: list[str], level: Column, x: Column, y: Column, name: str = "h") -> DataFrame:
        # pixel columns of their own: inlined, the formula would repeat all that leads to them
        px, py = pixel(x, y, level)
        df = df.withColumns({"__px": px, "__py": py}).withColumn("__code", self.code(level, F.col("__px"), F.col("__py")))
        return df.withColumn(name, geo.elevation(F.col("__code"))).drop("__px", "__py", "__code")

    def along(self, sectors: DataFrame, cast: rays.Cast, emit: Callable, schema: str) -> DataFrame:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in rays.sectors_of(cast, batch):
                    yield emit(s, rays.outwards(s, self.sampled))

        return sectors.mapInArrow(one, schema)

    @staticmethod
    def sampled(s: rays.Sector, ray: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Heights of some rays of a sector at some steps."""
        px, py = (np.floor(p).astype(np.int64) for p in rays.pixel_of(*s.crossing(ray, step), s.level[step]))
        up = np.exp2(13 - s.level[step])
        px, py = (np.where(s.level[step] >= 14, p, ((2 * p + 1) * up).astype(np.int64)) for p in (px, py))
        return surface_codes(px, py) * 0.1 - 500.0


class Pyramid:
    """A stored pyramid as a surface: bilinear between cell centres, from the finest level with data not finer than asked.

    Where one of the four cells around a point is missing the nearest of them by position (the first) stands.

    Whatever asks for heights first says which blocks it may need; a bounded number of key ranges of them prunes the scan (a small job that
    runs when the plan is made).  Blocks and questions are then dealt by block; a block that many ask is copied once for so many of
    its questions, and a task holds one block at a time, however many questions follow it.
    """

    def __init__(self, blocks: DataFrame, hidden: DataFrame, levels: list[int], side: int = GRID.block_px):
        self.blocks, self.hidden, self.levels, self.side = blocks, hidden, sorted(levels, reverse=True), side

    @classmethod
    def open(cls, spark: SparkSession, path: str, side: int = GRID.block_px) -> Pyramid:
        """The pyramid that ``pyramid.write`` stored; without any level it raises."""
        blocks = spark.read.schema(store.BLOCK).parquet(f"{path}/blocks")
        levels = store.levels(spark, path)
        if not levels:
            raise ValueError(f"no blocks under {path}")
        return cls(blocks, spark.read.schema("level int, bx int, by int").parquet(f"{path}/hidden"), levels, side)

    def level(self, z: int) -> DataFrame:
        """One level's blocks: a partition filter."""
        return self.blocks.filter(F.col("level") == z)

    def candidates(self, want: int) -> list[int]:
        """The levels tried in turn; if all are finer than asked, the coarsest."""
        return [z for z in self.levels if z <= want] or self.levels[-1:]

    def _read(self, asking: DataFrame, wanted: DataFrame, read: Callable, schema: str, each: int) -> DataFrame:
        """``read`` over ``asking``, whose rows name a block (BLOCK_OF) and a number ``__mix`` that spreads those of one block.

        ``wanted`` has the blocks that may be asked, each once, and about how often (``n``); questions to others are lost.  ``read`` gets batches with
        ``__cells`` besides: the codes in a block's own row, which comes before its questions, null in theirs.
        """
        spark = asking.sparkSession
        wanted = stage.stored(wanted.select(*BLOCK_OF, store.morton(*map(F.col, BLOCK_OF)).alias("key"), F.ceil(F.col("n") / each).cast("int").alias("__copies")), "wanted-blocks")
        there = wanted.filter("__bx >= 0 AND __by >= 0")
        some = store.within(self.blocks, store.ranges(there)).select("key", F.col("cells").alias("__cells"))
        some = some.join(there, "key").select(*BLOCK_OF, F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("__copy"), "__cells")
        asks = asking.join(wanted.select(*BLOCK_OF, "__copies"), BLOCK_OF).withColumn("__copy", F.pmod("__mix", F.col("__copies")).cast("int")).drop("__copies")
        both = asks.unionByName(some, allowMissingColumns=True)
        dealt = both.repartition(tasks_for(spark), *BLOCK_OF, "__copy").sortWithinPartitions(*BLOCK_OF, "__copy", F.col("__cells").isNull())
        return dealt.mapInArrow(read, schema)

    def _sampled(self, df: DataFrame, level: Column, fx: Column, fy: Column, name: str) -> DataFrame:
        """Rows with the bilinear height ``name`` at a world pixel of a level, null where there is none."""
        side, own = self.side, df.columns
        place = lambda p: F.coalesce(F.floor(F.col(p) / side), F.lit(-1)).cast("int")
        asking = df.withColumns({"__fx": fx.cast("double"), "__fy": fy.cast("double"), "__level": level.cast("int")}).withColumns({"__bx": place("__fx"), "__by": place("__fy"), "__mix": F.xxhash64("__fx", "__fy")})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, cells = None, None
            for batch in batches:
                block = list(zip(*(batch.column(c).to_pylist() for c in (*BLOCK_OF, "__copy"))))
                x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__fx", "__fy"))
                h, blocks = np.full(batch.num_rows, np.nan), batch.column("__cells")
                cuts = [0, *(i for i in range(1, len(block)) if block[i] != block[i - 1]), len(block)]
                for i, j in zip(cuts[:-1], cuts[1:]):
                    if i < j and blocks[i].is_valid:
                        held, cells = block[i], np.frombuffer(blocks[i].as_py(), ">u2").reshape(-1, side + 1)
                        i += 1
                    if i < j and block[i] == held:
                        h[i:j] = _bilinear(cells, x[i:j] - held[1] * side, y[i:j] - held[2] * side)
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(h, mask=np.isnan(h))], names=[*own, name])
                yield out.filter(blocks.is_null())

        wanted = asking.groupBy(*BLOCK_OF).agg(F.count(F.lit(1)).alias("n"))
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
        return self._read(asking, wanted, read, ", ".join([*fields, f"`{name}` double"]), POINT_COPY)

    def nearest(self, df: DataFrame, level: Column, x: Column, y: Column, name: str = "h") -> DataFrame:
        """The height of the cell a point lies in, at one level."""
        return self._sampled(df, level, *pixel(x, y, level), name)

    def bilinear(self, df: DataFrame, level: Column, x: Column, y: Column, name: str = "h") -> DataFrame:
        """Bilinear height at one level: one block a point, since it repeats its neighbours' first line; null off the grid."""
        res = geo.level_res(level)
        return self._sampled(df, level, geo.snap((x + geo.ORIGIN) / res - 0.5, 6), geo.snap((geo.num(geo.ORIGIN) - y) / res - 0.5, 6), name)

    def with_height(self, df: DataFrame, key: list[str], level: Column, x: Column, y: Column, name: str = "h", found: str = "__z") -> DataFrame:
        """Rows, unique by ``key``, with the height and the level it was found at: all candidate levels in one pass."""
        tries = F.filter(F.array(*map(F.lit, self.levels)), lambda z: z <= level)
        out = df.withColumn(found, F.explode(F.when(F.size(tries) > 0, tries).otherwise(F.array(F.lit(self.levels[-1])))))
        out = self.bilinear(out, F.col(found), x, y, name)
        best = out.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key))).agg(F.max_by(F.struct(*out.columns), F.when(F.col(name).isNotNull(), F.col(found)).otherwise(-1)).alias("__s"))
        best = best.select("__s.*").withColumn(found, F.when(F.col(name).isNotNull(), F.col(found)))
        return best.drop("__z")

    def _around(self, sectors: DataFrame, cast: rays.Cast) -> DataFrame:
        """(BLOCK_OF, n): the blocks of each level that a sector's view may ask, by the box around the disc in which the level is tried."""
        lat, lon, out = F.col("lat"), F.col("lon"), None
        views = sectors.groupBy("view", "lon", "lat").agg(F.count(F.lit(1)).alias("k"))
        edge = geo.LIMIT_LATITUDE
        for z in self.levels:
            # the ladder leaves a level where the next is fine enough; cells are largest at the equator
            reach = cast.limit if z in (cast.grid.coarsest, self.levels[-1]) else min(cast.limit, geo.resolution(z - 1) / geo.CELL_PER_METRE)
            arc = (reach + geo.resolution(z)) / geo.EARTH_RADIUS
            wide = F.degrees(F.asin(F.least(geo.num(1), F.try_divide(F.lit(math.sin(min(arc, math.pi / 2))), F.cos(F.radians(lat))))))
            high = math.degrees(arc)
            x = [(geo.merc_x(lon + s * wide) + geo.ORIGIN) / geo.resolution(z) for s in (-1, 1)]
            y = [(geo.num(geo.ORIGIN) - geo.merc_y(F.greatest(geo.num(-edge), F.least(geo.num(edge), lat + s * high)))) / geo.resolution(z) for s in (1, -1)]
            most = math.ceil(2 * geo.ORIGIN / geo.resolution(z) / self.side)
            line = lambda p: F.sequence(*(F.greatest(F.lit(-1), F.least(F.lit(most), F.floor((c + d) / self.side))).cast("int") for c, d in zip(p, (-2, 2))))
            here = views.select("k", F.explode(line(x)).alias("__bx"), F.lit(z).alias("__level"), line(y).alias("l")).select("k", "__level", "__bx", F.explode("l").alias("__by"))
            out = here if out is None else out.unionByName(here)
        return out.groupBy(*BLOCK_OF).agg(F.sum("k").alias("n"))

    def along(self, sectors: DataFrame, cast: rays.Cast, emit: Callable, schema: str) -> DataFrame:
        """Rays meet blocks as pieces (consecutive steps of a ray in one block): what is shuffled towards the blocks is a row
        per sector and block, and back come the heights, packed: a sample is exchanged once.

        Pieces at coarser levels than the finest asked for are only read where finer blocks leave something open.
        """
        run, side, where = self, self.side, "view bigint, lon double, lat double, eye double, low int, high int"
        pieces = f"{where}, first boolean, __level int, __bx int, __by int, ray binary, at binary, n binary"
        heights = f"{where}, __level int, ray binary, at binary, n binary, h binary"

        def crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, s in zip(batch.to_pylist(), rays.sectors_of(cast, batch)):
                    x, y = s.places()
                    found = []
                    for z in levels:
                        rank = np.array([candidates[w].index(z) if z in candidates[w] else -1 for w in s.level])
                        for first in (True, False):
                            steps = np.flatnonzero(rank == 0 if first else rank > 0)
                            found += [row | {"first": first, "__level": z, **piece} for piece in _pieces(*rays.pixel_of(x[:, steps], y[:, steps], z, 0.5), steps, side)]
                    yield from pa.Table.from_pylist(found, piece_schema).to_batches(256)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, cells, sectors = None, None, {}
            for batch in batches:
                out, blocks = [], batch.column("__cells")
                for i, row in enumerate(batch.drop_columns("__cells").to_pylist()):
                    block = tuple(row[c] for c in (*BLOCK_OF, "__copy"))
                    if blocks[i].is_valid:
                        held, cells = block, np.frombuffer(blocks[i].as_py(), ">u2").reshape(-1, side + 1)
                    elif block == held:
                        one = tuple(row[c] for c in ("view", "lon", "lat", "eye", "low", "high"))
                        if one not in sectors:
                            sectors = {} if len(sectors) > 64 else sectors
                            sectors[one] = rays.Sector(cast, *one)
                        fx, fy = rays.pixel_of(*sectors[one].places(*_unpacked(row)), row["__level"], 0.5)
                        out.append({k: row[k] for k in height_schema.names[:-1]} | {"h": _bilinear(cells, fx - held[1] * side, fy - held[2] * side).tobytes()})
                yield from pa.Table.from_pylist(out, height_schema).to_batches()

        def combine(rows: pa.Table) -> pa.Table:
            s = next(rays.sectors_of(cast, rows.slice(0, 1).combine_chunks().to_batches()[0]))
            h = np.full((len(s.ray), len(s.d)), np.nan)
            for row in rows.filter(pc.greater(pc.binary_length(rows["h"]), 0)).sort_by("__level").to_pylist():  # finer levels overwrite
                (i, j), v = _unpacked(row), np.frombuffer(row["h"])
                good = ~np.isnan(v)
                h[i[good], j[good]] = v[good]
            return pa.Table.from_batches([emit(s, h)])

        levels, candidates = run.levels, {w: run.candidates(w) for w in range(cast.grid.coarsest, cast.grid.finest + 1)}
        arrow = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        piece_schema, height_schema = (pa.schema([(f.split()[0], arrow[f.split()[1]]) for f in text.split(", ")]) for text in (pieces, heights))
        sectors = stage.stored(sectors, "sectors")  # asked twice
        asked = sectors.repartition(tasks_for(sectors.sparkSession), "view", "low").mapInArrow(crossings, pieces)
        if len(levels) > 1:
            under = self.hidden.select(*(F.col(c).alias(f"__{c}") for c in ("level", "bx", "by")), F.lit(True).alias("__hidden"))
            asked = asked.join(under, BLOCK_OF, "left").filter(F.col("first") | F.col("__hidden").isNull()).drop("__hidden")
        asked = asked.withColumn("__mix", F.xxhash64("view", "low"))
        none = F.lit(b"")
        bare = sectors.select(*(f.split()[0] for f in where.split(", ")), F.lit(0).alias("__level"), *(none.alias(c) for c in ("ray", "at", "n", "h")))  # a sector without heights is there, too
        return self._read(asked, self._around(sectors, cast), read, heights, PIECE_COPY).unionByName(bare).groupBy("view", "low").applyInArrow(combine, schema)


def _pieces(fx: np.ndarray, fy: np.ndarray, steps: np.ndarray, side: int) -> Iterator[dict]:
    """Per block the pieces (ray, first step, steps) of rays in it; points off the grid are in none."""
    if not fx.size:
        return
    bx, by = np.floor(fx / side).astype(np.int64), np.floor(fy / side).astype(np.int64)
    block = np.where((fx >= 0) & (fy >= 0), by * (1 << 32) + bx, -1)
    new = np.ones(block.shape, bool)
    new[:, 1:] = (block[:, 1:] != block[:, :-1]) | (np.diff(steps) != 1)
    ray, start = np.nonzero(new)
    flat = np.flatnonzero(new.ravel())
    n = np.diff(np.append(flat, block.size))
    owner = block[ray, start]
    order = np.argsort(owner, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
        if owner[group[0]] >= 0:
            place = {"__bx": int(owner[group[0]] & 0xFFFFFFFF), "__by": int(owner[group[0]] >> 32)}
            yield place | {k: v[group].astype(np.int32).tobytes() for k, v in (("ray", ray), ("at", steps[start]), ("n", n))}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ray, step) of every sample of a row's pieces."""
    ray, at, n = (np.frombuffer(row[k], np.int32) for k in ("ray", "at", "n"))
    return np.repeat(ray, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)


def _bilinear(v: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Heights between the codes of one block; without all four around a point, its first."""
    i, j = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    tx, ty = fx - i, fy - j
    corners = (v[j, i], v[j, i + 1], v[j + 1, i], v[j + 1, i + 1])
    a, b, c, d = (np.where(k == 0, np.nan, k * 0.1 - 500.0) for k in corners)
    top, low = a + (b - a) * tx, c + (d - c) * tx
    mean = top + (low - top) * ty
    return np.where(np.isnan(mean), a, mean)


def mosaic(samples: DataFrame, *pixel_key: str) -> DataFrame:
    """The value of the highest priority with data, per pixel: ``samples`` has value (0 or null: none) and priority."""
    live = samples.filter("value IS NOT NULL AND value <> 0")
    return live.groupBy(*pixel_key).agg(F.max_by("value", "priority").alias("value"), F.max("priority").alias("priority"))


def overview(cells: DataFrame) -> DataFrame:
    """The next coarser level of (level, x, y, v): the mean of each 2 x 2 without missing cells, as codes."""
    half = cells.filter("v <> 0").groupBy((F.col("level") - 1).alias("level"), F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"))
    return half.agg(F.round(F.sum("v") / F.count("v")).cast("int").alias("v"))


def overviews(cells: DataFrame, coarsest: int) -> DataFrame:
    """A level and all its overviews down to ``coarsest``."""
    out, level = cells, cells
    for _ in range(GRID.finest - coarsest):
        level = overview(level)
        out = out.unionByName(level)
    return out


def resample_average(cells: DataFrame, factor: int) -> DataFrame:
    """Average resampling of (x, y, v) by a whole factor."""
    return cells.filter("v <> 0").groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg((F.sum("v") / F.count("v")).alias("v"))


def warp_average(cells: DataFrame, step: tuple[float, float], origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(x, y, v): area-weighted means of (x, y, v) on a grid whose cells are ``step`` source cells wide and high and begin at ``origin``.

    Any step, finer ones too.  A source cell goes to the target cells it overlaps, with the share they have in common; sums are taken partially before the
    shuffle.  Missing cells (v = 0 or null) carry no weight; target cells that only they overlap have no row.
    """
    def reach(p: Column, wide: float, start: float) -> Column:
        place = lambda c: (c - start) / wide
        each = F.sequence(F.floor(geo.snap(place(p), 9)).cast("bigint"), (F.ceil(geo.snap(place(p + 1), 9)) - 1).cast("bigint"))
        share = lambda i: F.least(p + 1.0, (i + 1) * wide + start) - F.greatest(p.cast("double"), i * wide + start)
        return F.transform(each, lambda i: F.struct(i.alias("i"), share(i).alias("w")))

    live = cells.filter("v IS NOT NULL AND v <> 0").select("v", F.explode(reach(F.col("x"), step[0], origin[0])).alias("a"), F.col("y"))
    live = live.select("v", "a", F.explode(reach(F.col("y"), step[1], origin[1])).alias("b")).withColumn("w", F.col("a.w") * F.col("b.w"))
    return live.groupBy(F.col("a.i").alias("x"), F.col("b.i").alias("y")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def fill_speckles(cells: DataFrame, radius: int) -> DataFrame:
    """Missing cells (v = 0) get the inverse-distance mean of cells within ``radius``; cells without such neighbours stay, and so do cells without a place or value.

    Cells are dealt to blocks, those near a border to the blocks beyond it as well: a group is one block and its margin, and a hole looks around inside it.
    """
    side, wide = FILL_SIDE, FILL_SIDE + 2 * radius
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]
    has_place = F.col("x").isNotNull() & F.col("y").isNotNull()

    def reach(p: Column) -> Column:
        return F.explode_outer(F.when(has_place, F.sequence(F.floor((p - radius) / side), F.floor((p + radius) / side))))

    placed = cells.select("x", "y", "v", reach(F.col("x")).alias("bx")).select("*", reach(F.col("y")).alias("by"))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        out = rows.select(["x", "y", "v"])
        if key[0].as_py() is None:
            return out.append_column("f", pa.nulls(len(rows), pa.float64()))
        x, y = (rows[p].to_numpy() - k.as_py() * side + radius for p, k in zip("xy", key))
        v = rows["v"].cast(pa.float64(), safe=False)
        own = (x >= radius) & (x < radius + side) & (y >= radius) & (y < radius + side)
        near, hole = pc.fill_null(pc.not_equal(v, 0.0), False).to_numpy(), own & pc.fill_null(pc.equal(v, 0.0), False).to_numpy()
        at = y * wide + x
        sums, counts = np.bincount(at[near], v.to_numpy()[near], wide * wide), np.bincount(at[near], minlength=wide * wide)
        total, weight = np.zeros(hole.sum()), np.zeros(hole.sum())
        for i, j in offsets:
            there, w = at[hole] + j * wide + i, (i * i + j * j) ** -0.5
            total += sums[there] * w
            weight += counts[there] * w
        f = np.full(len(at), np.nan)
        f[hole] = np.divide(total, weight, out=np.full(len(total), np.nan), where=weight > 0)
        known = np.zeros(len(at), bool)
        known[hole] = weight > 0
        return out.append_column("f", pa.array(f, mask=~known)).filter(pa.array(own))

    schema = T.StructType([T.StructField(c, cells.schema[c].dataType) for c in ("x", "y", "v")] + [T.StructField("f", T.DoubleType())])
    return placed.groupBy("bx", "by").applyInArrow(fill, schema).select("x", "y", F.coalesce(F.round("f").cast("int"), "v").alias("v"))


def eye_ground(views: DataFrame, surface, radius: float, key: str = "view") -> DataFrame:
    """Views with ``ground``: the highest of the point and eight on a circle, from the finest data there is; null without data at the point."""
    offsets = [(0.0, 0.0)] + ([(F.cos(geo.num(k * 0.7853981633974483)), F.sin(geo.num(k * 0.7853981633974483))) for k in range(8)] if radius > 0 else [])
    r = geo.num(radius) / F.cos(F.radians("lat"))
    ring = F.posexplode(F.array(*(F.struct((geo.merc_x(F.col("lon")) + r * a).alias("x"), (geo.merc_y(F.col("lat")) + r * b).alias("y")) for a, b in offsets))).alias("k", "p")
    at = surface.with_height(views.select(key, "lon", "lat", ring), [key, "k"], F.lit(GRID.finest), F.col("p.x"), F.col("p.y"))
    best = at.groupBy(F.col(key).alias("__k")).agg(F.max("h").alias("top"), F.count(F.when(F.col("k") == 0, F.col("h"))).alias("n"))
    return views.join(best, F.col(key) == F.col("__k"), "left").withColumn("ground", F.when(F.col("n") > 0, F.col("top"))).drop("__k", "top", "n")


def ranked_layers(layers: DataFrame) -> DataFrame:
    return layers.withColumn("rank", F.row_number().over(W.orderBy(F.desc("priority"))))
