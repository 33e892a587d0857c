"""A stored pyramid: one Parquet table of raster blocks in Morton order, the index of blocks that finer ones hide, and its levels.

A block is (level, cell, key, bx, by, cells, complete).  ``cells`` holds (side + 1) x (side + 1) codes, 16 bits each, most significant
byte first: its own cells and, repeated from its neighbours, one more column and row, so that every bilinear sample needs one
block only.  0 is no data; ``complete`` says that there is none of it.

``key`` orders the blocks of a level along a Morton curve, levels one after another; ``cell`` is the key of a square of
16 x 16 blocks, a directory with one file, which therefore holds one range of keys, sorted, in row groups of ``GROUP_ROWS`` blocks.  So a
few ranges of keys (``ranges``) name the directories to open and the row groups to read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

BLOCK = "key bigint, bx int, by int, cells binary, complete boolean, level int, cell bigint"
LEVEL_BITS, CELL_BITS, GROUP_ROWS = 52, 8, 8
#: The most ranges that a scan is pruned by.
RANGES = 128


def _spread(x: Column) -> Column:
    """The bits of a number below 2^24, moved apart."""
    x = x.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(level: Column, bx: Column, by: Column) -> Column:
    """A block's place in the order of the store."""
    place = _spread(bx).bitwiseOR(F.shiftleft(_spread(by), 1))
    return F.shiftleft(level.cast("bigint"), LEVEL_BITS).bitwiseOR(place)


def cell_of(key: Column) -> Column:
    return F.shiftright(key, CELL_BITS)


def ranges(keys: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover the column ``key``: the finest squares that are few enough, each with its first and last key."""
    found: list = []
    for k in range(0, 64, 4):
        squares = keys.groupBy(F.shiftright("key", k)).agg(F.min("key").alias("a"), F.max("key").alias("b"))
        found = squares.select("a", "b").limit(most + 1).collect()
        if len(found) <= most:
            break
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def within(blocks: DataFrame, some: list[tuple[int, int]]) -> DataFrame:
    """The blocks of some ranges: directories are chosen by cell, row groups by key."""
    if not some:
        return blocks.filter(F.lit(False))
    near, exact = F.lit(False), F.lit(False)
    for a, b in some:
        near |= F.col("cell").between(a >> CELL_BITS, b >> CELL_BITS)
        exact |= F.col("key").between(a, b)
    return blocks.filter(near).filter(exact)


def to_blocks(cells: DataFrame, side: int = geo.Grid().block_px) -> DataFrame:
    """Blocks of the raster (level, x, y, v).  A group is one block, so its size is bounded by the grid."""
    def reach(p: Column) -> Column:  # the own block, and the one before for which this is the repeated line
        own = F.struct(F.floor(p / side).cast("int").alias("b"), F.pmod(p, F.lit(side)).cast("int").alias("i"))
        return F.when(F.pmod(p, F.lit(side)) == 0, F.array(own, F.struct((own["b"] - 1).alias("b"), F.lit(side).alias("i")))).otherwise(F.array(own))

    placed = cells.filter("v IS NOT NULL AND v <> 0").select("level", "v", F.explode(reach(F.col("x"))).alias("px"), F.col("y")).select("level", "v", "px", F.explode(reach(F.col("y"))).alias("py"))
    placed = placed.filter("px.b >= 0 AND py.b >= 0").select(F.col("level").cast("int").alias("level"), F.col("px.b").alias("bx"), F.col("py.b").alias("by"), (F.col("py.i") * (side + 1) + F.col("px.i")).cast("int").alias("i"), F.col("v").cast("int").alias("v"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros((side + 1) ** 2, ">u2")
        out[rows["i"].to_numpy()] = rows["v"].to_numpy()
        values = [[k.as_py()] for k in key] + [[out.tobytes()], [bool((out != 0).all())]]
        return pa.table(dict(zip(("level", "bx", "by", "cells", "complete"), values)), pa.schema([("level", pa.int32()), ("bx", pa.int32()), ("by", pa.int32()), ("cells", pa.binary()), ("complete", pa.bool_())]))

    packed = placed.groupBy("level", "bx", "by").applyInArrow(pack, "level int, bx int, by int, cells binary, complete boolean")
    packed = packed.withColumn("key", morton(F.col("level"), F.col("bx"), F.col("by"))).withColumn("cell", cell_of(F.col("key")))
    return packed.select("key", "bx", "by", "cells", "complete", "level", "cell")


def hidden(blocks: DataFrame, levels: list[int]) -> DataFrame:
    """(level, bx, by) of blocks under complete ones of the next finer level: whoever samples from finer levels needn't read them.

    One finer block beyond the right and lower edge counts too, because samples by cell centres reach half a coarse cell there.
    """
    out = None
    full = blocks.filter("complete").select("level", "bx", "by")
    for coarse, fine in zip(sorted(levels), sorted(levels)[1:]):
        n = 1 << (fine - coarse)
        own = lambda c: F.floor(c / n).cast("int")
        over = lambda c: F.when(c % n == 0, F.array(own(c), own(c) - 1)).otherwise(F.array(own(c)))
        under = full.filter(F.col("level") == fine).select(F.explode(over(F.col("bx"))).alias("bx"), "by").select("bx", F.explode(over(F.col("by"))).alias("by"))
        found = under.groupBy("bx", "by").count().filter(F.col("count") == (n + 1) ** 2).select(F.lit(coarse).alias("level"), "bx", "by")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else full.limit(0)


def write(cells: DataFrame, path: str, side: int = geo.Grid().block_px) -> None:
    """Build and store the blocks of a raster, all its levels at once, then the index of hidden ones.

    All is written beside ``path`` and moved there at the end, so a job that dies leaves no half pyramid; an existing one is an error.
    """
    spark, made = cells.sparkSession, f"{path}.{uuid.uuid4().hex}"
    blocks = to_blocks(cells, side).repartition("level", "cell").sortWithinPartitions("level", "cell", "key")
    blocks.write.partitionBy("level", "cell").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(f"{made}/blocks")
    blocks = spark.read.schema(BLOCK).parquet(f"{made}/blocks")
    blocks.groupBy("level").agg(F.count(F.lit(1)).alias("blocks")).coalesce(1).write.parquet(f"{made}/levels")
    have = levels(spark, made)
    hidden(blocks, have).write.parquet(f"{made}/hidden")
    move(spark, made, path)


def move(spark: SparkSession, made: str, path: str) -> None:
    """Give a finished folder its name, in one step."""
    made, path = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (made, path))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    if files.exists(path) or not files.rename(made, path):
        files.delete(made, True)
        raise FileExistsError(path.toString())


def levels(spark: SparkSession, path: str) -> list[int]:
    """The levels that have blocks, finest first: at most as many as the grid has."""
    return sorted((r["level"] for r in spark.read.schema("level int, blocks bigint").parquet(f"{path}/levels").collect()), reverse=True)
