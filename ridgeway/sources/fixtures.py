"""Deterministic terrain built from the driver's tables: an integer surface, viewpoints, peaks, sources and requests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import pyramid, stage

WINDOW_X, WINDOW_Y, WINDOW = 2329600, 1439232, 1536


def tri(n: Column, period: int) -> Column:
    """A triangle wave of whole numbers."""
    return F.abs(F.pmod(n, F.lit(2 * period)) - period)


def surface_code(x: Column, y: Column) -> Column:
    """The raster code at a finest-level world pixel: an analytic surface, defined everywhere."""
    return (F.lit(7000) + 2 * tri(3 * x + y, 2700) + 3 * tri(x - 2 * y, 1100) + 4 * tri(x + 5 * y, 257)).cast("int")


def surface_codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for arrays inside a task."""
    wave = lambda n, period: np.abs(n % (2 * period) - period)
    return 7000 + 2 * wave(3 * x + y, 2700) + 3 * wave(x - 2 * y, 1100) + 4 * wave(x + 5 * y, 257)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, lon, lat) from supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("view"), (geo.num(20) + (k % 20) * 0.001).alias("lon"), (geo.num(49) + (F.floor(k / 20) % 20) * 0.001).alias("lat"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(osm_id, name, type, ele_osm, plon, plat) from part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("osm_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(F.col("p_size") % 7 != 0, (F.col("p_size") * 50).cast("string")).alias("ele_osm"),
        (geo.num(20) + F.pmod(k * 7919, F.lit(6000)) / 100000.0).alias("plon"), (geo.num(49) + F.pmod(k * 104729, F.lit(4000)) / 100000.0).alias("plat"),
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, key, priority, finest_level): elevation sources from nation."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_id"), k.alias("key"), (10 * k).alias("priority"), F.when(k % 3 == 0, 14).otherwise(12).alias("finest_level"))


def window_cells(spark: SparkSession, step: int = 1) -> DataFrame:
    """(x, y): finest-level world pixels of the materialised window, every ``step``-th along both axes."""
    n = WINDOW // step
    i = F.col("id")
    return spark.range(n * n).select((F.lit(WINDOW_X) + step * (i % n)).alias("x"), (F.lit(WINDOW_Y) + step * F.floor(i / n)).alias("y"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, v): a raster of at most 320 x 240 cells from lineitem; a tenth of its cells is 0, no data, others are absent."""
    k = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 320).alias("x"), (F.col("l_partkey") % 240).alias("y")).agg(F.sum(F.col("l_suppkey") * 37 + F.col("l_linenumber")).alias("s"))
    return k.select("x", "y", F.when(F.col("s") % 10 == 0, 0).otherwise(5000 + F.col("s") % 3000).cast("int").alias("v"))


def speckled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, v): two rasters far apart.  The whole window, each eleventh cell a hole; and a cell for each order and line number of lineitem, a tenth of them holes.

    Lines of 1536 orders stand in bands of seven, one band below the other: the second raster grows with the table, others of its cells are absent.
    """
    x, y, k = F.col("x"), F.col("y"), F.col("l_orderkey")
    window = window_cells(spark).withColumn("v", F.when((x * 7 + y * 3) % 11 == 0, 0).otherwise(surface_code(x, y)))
    at = ((k % WINDOW).alias("x"), (7 * F.expr(f"l_orderkey div {WINDOW}") + F.col("l_linenumber") - 1).alias("y"))
    lines = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.sum(F.col("l_suppkey") * 37 + F.col("l_linenumber")).alias("s"))
    return window.unionByName(lines.select("x", "y", F.when(F.col("s") % 10 == 0, 0).otherwise(5000 + F.col("s") % 3000).cast("int").alias("v")))


def covering(x: Column, y: Column) -> Column:
    """The keys, below 67, of the sources with data at a pixel."""
    return F.transform(F.array(*map(F.lit, range(3))), lambda r: F.pmod(r - F.floor(x / 64) - 3 * F.floor(y / 64), F.lit(67)).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(queue_id, seq, arrival, priority, service, abandoned) from events: seconds since the first arrival are up to the reader."""
    e = table(spark, sf_dir, "events")
    p = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "signup", 5).otherwise(0)
    return e.select((F.col("user_id") % 16).alias("queue_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"), p.alias("priority"), (F.lit(5.0) + F.coalesce("value", F.lit(0.0)) / 20).alias("service"), (F.col("event_type") == "error").alias("abandoned"))


def window_levels(spark: SparkSession, levels: tuple[int, ...] = (14,), sparse: bool = False) -> DataFrame:
    """(level, x, y, v): the window at some levels, point-sampled at cell centres; v is 0 where there is no data.

    ``sparse``: level 14 lacks its south-western block and squares of 32 cells, other levels squares of 16 cells.
    """
    out = None
    for level in levels:
        cut, half = 14 - level, (1 << (14 - level)) // 2
        n = WINDOW >> cut
        cell = spark.range(n * n).select(F.lit(level).alias("level"), (F.lit(WINDOW_X >> cut) + F.col("id") % n).alias("x"), (F.lit(WINDOW_Y >> cut) + F.floor(F.col("id") / n)).alias("y"))
        v = surface_code(F.col("x") * (1 << cut) + half, F.col("y") * (1 << cut) + half)
        if sparse:
            v = F.when(hole(level, F.col("x"), F.col("y")), 0).otherwise(v)
        rows = cell.withColumn("v", v)
        out = rows if out is None else out.unionByName(rows)
    return out


def hole(level: int, x: Column, y: Column) -> Column:
    """Where the sparse window has no data."""
    if level == 14:
        return ((x < WINDOW_X + 512) & (y >= WINDOW_Y + 1024)) | (F.pmod(F.floor(x / 32) + 2 * F.floor(y / 32), F.lit(5)) == 0)
    return F.pmod(F.floor(x / 16) + F.floor(y / 16), F.lit(7)) == 0


def stored_pyramid(spark: SparkSession, levels: tuple[int, ...] = (14,), sparse: bool = False) -> str:
    """The path of the window's pyramid, built and written once per session (again, if it was deleted since)."""
    made = _PYRAMIDS.setdefault(spark.sparkContext.applicationId, {})
    if (levels, sparse) not in made or not stage.exists(spark, f"{made[levels, sparse]}/hidden"):
        path = stage.new_path(spark, "pyramid")
        pyramid.write(window_levels(spark, levels, sparse), path)
        made[levels, sparse] = path
    return made[levels, sparse]


_PYRAMIDS: dict[str, dict] = {}
