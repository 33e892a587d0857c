"""Stored peaks, clustered by place: squares of ``SIZE`` degrees in Morton order, a directory for each 16 x 16 of them, rows sorted by square.

Views name the squares around them; a bounded number of key ranges prunes directories and row groups, so a read follows the views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import catalogue, pyramid

SIZE = 0.1
GROUP_ROWS = 20_000


def _square(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.floor((lon + 180.0) / SIZE).cast("int"), F.floor((lat + 90.0) / SIZE).cast("int")


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(osm_id, name, type, ele_osm, plon, plat) of CSV lines: longitude, latitude, id, name, kind, elevation, whatever follows.

    Lines with fewer fields or without two numbers in front, headers among them, go; an id that isn't a whole number is 0, an empty elevation null.
    """
    f = lines.select(catalogue.split_csv(F.col(line)).alias("f"))
    f = f.select("f", *(F.trim(F.get("f", F.lit(i))).try_cast("double").alias(c) for i, c in enumerate(("plon", "plat")))).filter("size(f) >= 6 AND plon IS NOT NULL AND plat IS NOT NULL")
    return f.select(F.coalesce(F.get("f", F.lit(2)).try_cast("bigint"), F.lit(0).cast("bigint")).alias("osm_id"), *(F.get("f", F.lit(i)).alias(c) for i, c in ((3, "name"), (4, "type"))), F.nullif(F.get("f", F.lit(5)), F.lit("")).alias("ele_osm"), "plon", "plat")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The peaks of CSV files, a line each."""
    return parsed(spark.read.text(path))


def write(peaks: DataFrame, path: str) -> None:
    """Store peaks that have a place (plon, plat); all their columns stay."""
    placed = peaks.filter("plon BETWEEN -180 AND 180 AND plat BETWEEN -90 AND 90")
    placed = placed.withColumn("key", pyramid.morton(F.lit(0), *_square(F.col("plon"), F.col("plat")))).withColumn("cell", pyramid.cell_of(F.col("key")))
    placed.repartition("cell").sortWithinPartitions("cell", "key").write.partitionBy("cell").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)


def near(spark: SparkSession, path: str, views: DataFrame, limit: float) -> DataFrame:
    """The stored peaks in the squares that lie within ``limit`` metres of some view (lon, lat), and a few more.

    A small job finds the ranges when the plan is made.  Boxes end at the date line and at the poles.
    """
    high = limit / 111320.0 + SIZE
    wide = high / F.greatest(F.cos(F.radians("lat")), geo.num(0.05))
    ends = [_square(F.greatest(geo.num(-180), F.least(geo.num(180), F.col("lon") + s * wide)), F.greatest(geo.num(-90), F.least(geo.num(90), F.col("lat") + s * high))) for s in (-1, 1)]
    squares = views.select(F.explode(F.sequence(ends[0][0], ends[1][0])).alias("x"), F.sequence(ends[0][1], ends[1][1]).alias("ys")).select("x", F.explode("ys").alias("y")).distinct()
    keys = squares.select(pyramid.morton(F.lit(0), F.col("x"), F.col("y")).alias("key"))
    return pyramid.within(spark.read.parquet(path), pyramid.ranges(keys)).drop("key", "cell")
