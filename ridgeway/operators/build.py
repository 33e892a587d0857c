"""Layer A: each source on the grid by itself, in tiles with their overviews, built once and committed whole.

A source is a long raster (source_id, x, y, v: metres) and a ``Source`` that says where it lies.  Tiles are stored as blocks of
``block_px`` x ``block_px`` codes, 16 bits each, most significant byte first, 0 for no data; priorities are resolved by whoever reads several sources.

Below ``root`` there are ``blocks/run=...``, what a run wrote, and ``manifest/run=...``, the tiles that it finished.  A tile is there when a manifest
names it: a run that dies before its manifest is moved into place leaves blocks that nobody reads (``sweep`` deletes them), and the next run builds
its tiles again.  Of a tile that two runs at once have built the run with the smaller name counts.  A tile without data is built, too, with no block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import catalogue, pyramid, stage
from .dem import GRID

TILE = ["source_id", "tx", "ty"]
BLOCK = "key bigint, bx int, by int, tx int, ty int, cells binary, run string, source_id string, level int"
MANIFEST = "tx int, ty int, blocks bigint, run string, source_id string"
#: Overviews made from one group of blocks: 3 levels from 8 x 8 blocks.
LEVELS_A_GROUP = 3
MADE = "source_id string, level int, bx int, by int, cells binary"


@dataclass(frozen=True)
class Source:
    """Where a raster lies: ``left`` and ``top`` are its upper left corner and ``cell`` a cell's width and height, in units of ``crs``.

    Cells with the value ``nodata`` are missing, as are null, NaN and absent ones.  Holes get the inverse-distance mean of the cells of their tile within
    ``fill`` target cells; a hole without such cells stays one.
    """

    source_id: str
    crs: str
    left: float
    top: float
    cell: float
    level: int
    nodata: float | None = None
    fill: int = 0
    resampling: str = "average"

    def __post_init__(self) -> None:
        if self.resampling not in ("average", "bilinear"):
            raise ValueError(f"no resampling by {self.resampling}")
        if self.crs not in ("EPSG:4326", "EPSG:3857"):
            raise ValueError(f"no projection from {self.crs}")

    def edges(self, x: Column, y: Column) -> tuple[Column, Column]:
        """World pixels of a corner of a cell, at the source's level."""
        a, b = geo.num(self.left) + x * self.cell, geo.num(self.top) - y * self.cell
        if self.crs == "EPSG:4326":
            a, b = geo.merc_x(a), geo.merc_y(F.greatest(geo.num(-geo.LIMIT_LATITUDE), F.least(geo.num(geo.LIMIT_LATITUDE), b)))
        res = geo.resolution(self.level)
        return geo.snap((a + geo.ORIGIN) / res, 6), geo.snap((geo.num(geo.ORIGIN) - b) / res, 6)

    def window(self, grid: geo.Grid, tiles: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        """The cells (first x, last x, first y, last y) that may lie in tiles (first tx, last tx, first ty, last ty), and a few more."""
        x = [t * grid.span - geo.ORIGIN for t in (tiles[0], tiles[1] + 1)]
        y = [geo.ORIGIN - t * grid.span for t in (tiles[2], tiles[3] + 1)]
        if self.crs == "EPSG:4326":
            x = [v / geo.ORIGIN * 180.0 for v in x]
            y = [math.degrees(math.atan(math.sinh(v / geo.MERCATOR_RADIUS))) for v in y]
        a, b, c, d = (x[0] - self.left) / self.cell, (x[1] - self.left) / self.cell, (self.top - y[0]) / self.cell, (self.top - y[1]) / self.cell
        return math.floor(a) - 2, math.ceil(b) + 2, math.floor(c) - 2, math.ceil(d) + 2


def tile_blocks(grid: geo.Grid, level: Column) -> Column:
    """Blocks along a tile's side."""
    return (geo.tile_px_at(grid, level) / grid.block_px).cast("int")


def warped(cells: DataFrame, source: Source, tiles: DataFrame, grid: geo.Grid = GRID) -> DataFrame:
    """(x, y, v): the world pixels, at the source's level, of some tiles (tx, ty), resampled from cells (x, y, v).

    average: means of the cells over a pixel, weighted by the area in common.  bilinear: at a pixel's centre, between the centres of the four cells around
    it; meant for cells about as large as pixels.  Missing cells carry no weight in either; a pixel without weight has no row.
    """
    live = cells.filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
    if source.nodata is not None:
        live = live.filter(F.col("v") != geo.num(source.nodata))
    if source.resampling == "average":
        ends = [source.edges(F.col("x") + i, F.col("y") + i) for i in (0, 1)]

        def reach(axis: str) -> Column:
            a, b = F.col(f"{axis}0"), F.col(f"{axis}1")
            share = lambda i: F.least(b, i + 1.0) - F.greatest(a, i.cast("double"))
            return F.when(a < b, F.transform(F.sequence(F.floor(a), F.ceil(b) - 1), lambda i: F.struct(i.alias("i"), share(i).alias("w"))))
    else:
        ends = [source.edges(F.col("x") + i, F.col("y") + i) for i in (-0.5, 0.5, 1.5)]  # centres: of the cell before, its own, of the next

        def reach(axis: str) -> Column:
            a, m, b = (F.col(f"{axis}{k}") for k in range(3))
            hat = lambda p: F.when(p < m, (p - a) / (m - a)).otherwise((b - p) / (b - m))
            first, last = F.ceil(a - 0.5), F.floor(b - 0.5)
            return F.when((a < m) & (m < b) & (first <= last), F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), hat(i + 0.5).alias("w"))))

    live = live.select(F.col("v").cast("double").alias("v"), *(c.alias(f"{axis}{k}") for k, corner in enumerate(ends) for axis, c in zip("xy", corner)))
    each = live.select("v", F.explode(reach("x")).alias("a"), *(f"y{k}" for k in range(len(ends)))).select("v", "a", F.explode(reach("y")).alias("b"))
    each = each.select(F.col("a.i").alias("x"), F.col("b.i").alias("y"), "v", (F.col("a.w") * F.col("b.w")).alias("w")).filter("w > 1e-9")
    px = grid.tile_px >> (grid.finest - source.level)
    each = each.withColumns({"tx": F.floor(F.col("x") / px).cast("int"), "ty": F.floor(F.col("y") / px).cast("int")})
    each = each.join(tiles.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
    return each.groupBy("x", "y").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def filled(v: np.ndarray, r: int) -> np.ndarray:
    """The inside of ``v``, which has a margin of ``r`` cells, with the inverse-distance mean of what is within ``r`` in place of NaN."""
    own = v[r : v.shape[0] - r, r : v.shape[1] - r].copy()
    y, x = np.nonzero(np.isnan(own))
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for j in range(-r, r + 1):
        for i in range(-r, r + 1):
            if 0 < i * i + j * j <= r * r:
                near = v[y + r + j, x + r + i]
                there = ~np.isnan(near)
                w = (i * i + j * j) ** -0.5
                total += np.where(there, near * w, 0.0)
                weight += there * w
    some = weight > 0
    own[y[some], x[some]] = total[some] / weight[some]
    return own


def codes(metres: np.ndarray) -> np.ndarray:
    """Codes of heights; NaN is 0."""
    c = np.floor(np.rint((metres + 500.0) * 1e5) / 1e4 + 0.5)
    return np.where(np.isnan(c), 0, np.clip(c, 0, 65535)).astype(">u2")


def packed(pixels: DataFrame, source: Source, grid: geo.Grid = GRID) -> DataFrame:
    """Blocks of a source's pixels (x, y, v) at its own level, holes filled.  A group is one block and its margin, so the grid bounds it."""
    side, r = grid.block_px, source.fill
    n = (grid.tile_px >> (grid.finest - source.level)) // side

    def reach(p: Column) -> Column:  # blocks within the margin, but none of other tiles
        tile = F.floor(p / (n * side))
        return F.sequence(F.greatest(F.floor((p - r) / side), tile * n), F.least(F.floor((p + r) / side), tile * n + n - 1))

    placed = pixels.select("x", "y", "v", F.explode(reach(F.col("x"))).alias("bx")).select("*", F.explode(reach(F.col("y"))).alias("by"))
    placed = placed.select(F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), *((F.col(p) - F.col(f"b{p}") * side + r).cast("int").alias(f"i{p}") for p in ("x", "y")), "v")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        v = np.full((side + 2 * r, side + 2 * r), np.nan)
        v[rows["iy"].to_numpy(), rows["ix"].to_numpy()] = rows["v"].to_numpy()
        out = codes(filled(v, r))
        return _rows([(source.source_id, source.level, key[0].as_py(), key[1].as_py(), out)])

    return placed.groupBy("bx", "by").applyInArrow(pack, MADE)


def _rows(blocks: list[tuple]) -> pa.Table:
    """Blocks (source, level, bx, by, codes) that have data."""
    some = [(*where, out.astype(">u2").tobytes()) for *where, out in blocks if out.any()]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ("source_id", "level", "bx", "by", "cells")
    return pa.table({k: pa.array([b[i] for b in some], t) for i, (k, t) in enumerate(zip(names, kinds))})


def halved(v: np.ndarray) -> np.ndarray:
    """Means of each 2 x 2 codes without the missing ones, halves up."""
    four = v.reshape(v.shape[0] // 2, 2, v.shape[1] // 2, 2).astype(np.int64)
    n = (four > 0).sum(axis=(1, 3))
    return np.where(n > 0, (2 * four.sum(axis=(1, 3)) + n) // np.maximum(2 * n, 1), 0)


def overviews(blocks: DataFrame, grid: geo.Grid = GRID) -> DataFrame:
    """Up to ``LEVELS_A_GROUP`` coarser levels of blocks of one level, none below the grid's coarsest.  A group is the blocks under one of the last of them."""
    side, step = grid.block_px, LEVELS_A_GROUP
    wide = 1 << step

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        source, level, gx, gy = (k.as_py() for k in key)
        v = np.zeros((wide * side, wide * side), np.uint16)
        for bx, by, cells in zip(rows["bx"].to_pylist(), rows["by"].to_pylist(), rows["cells"]):
            x, y = (bx - gx * wide) * side, (by - gy * wide) * side
            v[y : y + side, x : x + side] = np.frombuffer(cells.as_py(), ">u2").reshape(side, side)
        made = []
        for k in range(1, min(step, level - grid.coarsest) + 1):
            v, n = halved(v), wide >> k
            made += [(source, level - k, gx * n + i, gy * n + j, v[j * side : (j + 1) * side, i * side : (i + 1) * side]) for j in range(n) for i in range(n)]
        return _rows(made)

    group = [F.floor(F.col(c) / wide).cast("int").alias(f"g{c}") for c in ("bx", "by")]
    return blocks.groupBy("source_id", "level", *group).applyInArrow(chain, MADE)


def built(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, tx, ty, run, blocks) of the tiles that are there, one row each."""
    if not stage.exists(spark, f"{root}/manifest"):
        return spark.createDataFrame([], MANIFEST).select(*TILE, "run", "blocks")
    found = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    return found.groupBy(*TILE).agg(F.min_by(F.struct("run", "blocks"), "run").alias("m")).select(*TILE, "m.run", "m.blocks")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of the tiles that are there: source_id, level, tx, ty, bx, by, key, cells."""
    if not stage.exists(spark, f"{root}/blocks"):
        found = spark.createDataFrame([], BLOCK)
    else:
        found = spark.read.schema(BLOCK).parquet(f"{root}/blocks")
    tiles = built(spark, root).filter("blocks > 0").select("run", *TILE)
    return found.join(tiles, ["run", *TILE], "left_semi").select("source_id", "level", "tx", "ty", "bx", "by", "key", "cells")


def cells_of(blocks: DataFrame, side: int = GRID.block_px) -> DataFrame:
    """(source_id, level, x, y, v): the codes of blocks, without the missing ones."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, level, bx, by, cells in zip(*(batch.column(k).to_pylist() for k in range(5))):
                v = np.frombuffer(cells, ">u2").astype(np.int32).reshape(side, side)
                y, x = np.nonzero(v)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(source, pa.string()), len(x)), pa.repeat(pa.scalar(level, pa.int32()), len(x)), pa.array(x + bx * side, pa.int64()), pa.array(y + by * side, pa.int64()), pa.array(v[y, x])], names=["source_id", "level", "x", "y", "v"])

    return blocks.select("source_id", "level", "bx", "by", "cells").mapInArrow(unpack, "source_id string, level int, x bigint, y bigint, v int")


def commit(spark: SparkSession, made: str, root: str, run: str) -> None:
    """The tiles of a run are there from now on: its manifest, written elsewhere, gets its name."""
    pyramid.move(spark, made, f"{root}/manifest/run={run}")


def _run(cells: DataFrame, source: Source, tiles: DataFrame, root: str, grid: geo.Grid) -> str:
    """Build and commit some tiles of one source; the name of the run."""
    spark, run = cells.sparkSession, f"r{uuid.uuid4().hex}"
    level = stage.stored(packed(warped(cells, source, tiles, grid), source, grid), "layer-a")
    blocks = level
    for depth in range(source.level, grid.coarsest, -LEVELS_A_GROUP):
        made = stage.stored(overviews(level, grid), "layer-a-overviews")
        level, blocks = made.filter(F.col("level") == depth - LEVELS_A_GROUP), blocks.unionByName(made)
    n = tile_blocks(grid, F.col("level"))
    blocks = blocks.withColumns({"tx": F.floor(F.col("bx") / n).cast("int"), "ty": F.floor(F.col("by") / n).cast("int"), "key": pyramid.morton(F.col("level"), F.col("bx"), F.col("by"))})
    blocks = blocks.withColumn("__cell", pyramid.cell_of(F.col("key"))).repartition("level", "__cell").sortWithinPartitions("level", "key")
    path = f"{root}/blocks/run={run}"
    blocks.drop("__cell").write.partitionBy("source_id", "level").option("parquet.block.row.count.limit", pyramid.GROUP_ROWS).parquet(path)
    counts = spark.read.schema(BLOCK).parquet(path).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("blocks"))
    manifest = tiles.select("tx", "ty").distinct().join(counts, ["tx", "ty"], "left").select("tx", "ty", F.coalesce("blocks", F.lit(0)).cast("bigint").alias("blocks"), F.lit(source.source_id).alias("source_id"))
    done = f"{root}/tmp/{run}"
    manifest.coalesce(1).write.partitionBy("source_id").parquet(done)  # as many rows as a run has tiles
    commit(spark, done, root, run)
    return run


def build(cells: DataFrame, sources: Iterable[Source], plan: DataFrame, root: str, grid: geo.Grid = GRID, square: int = 4) -> list[str]:
    """Build the tiles of ``plan`` (source_id, tx, ty) that aren't there yet; the names of the runs, none if nothing was left to do.

    ``cells``: source_id, x, y, v.  A run is one source's tiles of a square of ``square`` x ``square`` tiles, so a build that is killed goes on where it
    was; the scan of a run is pruned to its source and its window of x and y.  The driver holds the list of squares, which the grid bounds.  Tiles of sources
    that aren't among ``sources`` are an error.
    """
    if grid.tile_px >> (grid.finest - grid.coarsest) < grid.block_px:
        raise ValueError("a tile of the coarsest level is smaller than a block")
    spark, known = cells.sparkSession, {s.source_id: s for s in sources}
    todo = plan.select("source_id", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty")).distinct().join(built(spark, root), TILE, "left_anti")
    todo = stage.stored(todo, "tile-plan")
    place = [F.floor(F.col(c) / square) for c in ("tx", "ty")]
    squares = todo.groupBy("source_id", place[0].alias("i"), place[1].alias("j")).agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).collect()
    if unknown := {r["source_id"] for r in squares} - known.keys():
        raise KeyError(f"no source {', '.join(sorted(map(str, unknown)))}")
    runs = []
    for name, i, j, *ends in sorted(squares):
        source = known[name]
        x0, x1, y0, y1 = source.window(grid, tuple(ends))
        some = cells.filter(F.col("source_id") == name).filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        tiles = todo.filter((F.col("source_id") == name) & (place[0] == i) & (place[1] == j))
        runs.append(_run(some, source, tiles, root, grid))
    return runs


def region(cells: DataFrame, source: Source, bbox: tuple[float, float, float, float], root: str, grid: geo.Grid = GRID, square: int = 4) -> list[str]:
    """Build all tiles that a box (lon0, lat0, lon1, lat1) touches from one source, the fallback of a whole region."""
    box = cells.sparkSession.createDataFrame([(source.source_id, *map(float, bbox))], "source_id string, lon0 double, lat0 double, lon1 double, lat1 double")
    return build(cells, [source], catalogue.cover(box, grid), root, grid, square)


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Delete what runs left that were never committed, and name them.  Not to be called while a build runs."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
    files = path("blocks").getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda p: {s.getPath().getName() for s in files.listStatus(path(p))} if files.exists(path(p)) else set()
    lost = sorted(names("blocks") - names("manifest"))
    for name in lost:
        files.delete(path(f"blocks/{name}"), True)
    files.delete(path("tmp"), True)
    return [name.removeprefix("run=") for name in lost]
