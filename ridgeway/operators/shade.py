"""Column shading over (view, ray, row, dist, cover): silhouettes, ink, haze, eye line, box average, dither, depth rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo

# fixed values: how edges fade with distance, when a row counts as covered, the line at eye level, the least ratio of an edge
FADE_NEAR, FADE_MORE = 0.45, 0.4
WHOLE = 0.999
LINE_SHARE, LINE_ADD = 0.75, 60.0
LEAST_RATIO = 1.001


def column():
    """A column's rows from the top."""
    return W.partitionBy("view", "ray").orderBy("row")


def full_columns(cells: DataFrame, views: DataFrame, rays: int, height: int) -> DataFrame:
    """All rows of all columns; sky has a null dist and cover 0."""
    frame = views.select("view", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return frame.join(cells, ["view", "ray", "row"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0).cast("float")))


def edge_strength(full: DataFrame, edge_ratio: float, hidden_ref: float) -> DataFrame:
    """Columns with ``edge``: how much a silhouette hides, gated by how far the step up exceeds the step down."""
    here = F.log("dist")
    above, below = F.log(F.lag("dist").over(column())), F.log(F.lead("dist").over(column()))
    up = above - here
    down = F.greatest(geo.num(0), F.coalesce(here - below, geo.num(0)))
    clip = lambda c: F.greatest(geo.num(0), F.least(geo.num(1), c))
    gate = clip((up - down) / math.log(max(edge_ratio, LEAST_RATIO)))
    extent = F.sqrt(clip(F.col("dist") * F.expm1(up) / hidden_ref))
    edge = F.when(F.col("dist").isNull(), 0.0).when(F.col("row") == 0, 1.0).when(above.isNull(), 1.0).when(up <= 0, 0.0).otherwise(gate * extent)
    return full.withColumn("edge", edge)


def ink(edges: DataFrame, strength: float, half_width: float, height: int) -> DataFrame:
    """(view, ray, row, ink): strokes of a width around each edge's sub-pixel height, spread by overlap."""
    fade = FADE_NEAR + FADE_MORE * (1 - F.exp(-F.col("dist") / geo.HAZE))
    e = edges.filter("edge > 0").withColumns({"amount": F.col("edge") * (1 - fade) * strength, "at": F.col("row") + (1 - F.col("cover").cast("double"))})
    e = e.withColumns({"lo": F.col("at") - half_width, "hi": F.col("at") + half_width})
    first, last = F.greatest(F.lit(0), F.floor("lo")).cast("int"), F.least(F.ceil("hi"), F.lit(height)).cast("int")
    e = e.withColumns({"a": first, "b": last}).filter("b > a").withColumn("y", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    overlap = F.least("hi", F.col("y") + 1.0) - F.greatest("lo", F.col("y").cast("double"))
    return e.withColumn("o", overlap).filter("o > 0").groupBy("view", "ray", F.col("y").alias("row")).agg(F.sum(F.col("amount") * F.col("o")).alias("ink"))


def shaded(edges: DataFrame, inks: DataFrame, alt_max: float, alt_step: float, ground: tuple[float, float, float], ridge: tuple[float, float, float], eye_level: bool) -> DataFrame:
    """(view, ray, row, r, g, b) as doubles."""
    alt = lambda row: F.lit(float(alt_max)) - (row + 0.5) * float(alt_step)

    def surface(dist: Column, row: Column) -> list[Column]:
        t = 1 - F.exp(-dist / geo.HAZE)
        return [F.when(dist.isNull(), sky).otherwise(geo.lerp(geo.num(base), sky, t)) for base, sky in zip(ground, geo.sky_colour(alt(row)))]

    row, cover = F.col("row"), F.col("cover").cast("double")
    front, back = surface(F.col("dist"), row), surface(F.lag("dist").over(column()), row - 1)
    sky = geo.sky_colour(alt(row))
    part = F.col("dist").isNotNull() & (cover < WHOLE)
    mixed = [F.when(part, geo.lerp(F.when(row > 0, b).otherwise(s), f, cover)).otherwise(f) for f, b, s in zip(front, back, sky)]
    named = dict(zip("rgb", mixed))
    out = edges.withColumns(named).join(inks.withColumnsRenamed({"view": "v", "ray": "y", "row": "w"}), (F.col("view") == F.col("v")) & (F.col("ray") == F.col("y")) & (F.col("row") == F.col("w")), "left")
    k = F.greatest(geo.num(0), F.least(geo.num(1), F.coalesce("ink", geo.num(0))))
    inked = {c: geo.lerp(F.col(c), geo.num(x), k) for c, x in zip("rgb", ridge)}
    line = F.lit(eye_level) & (F.abs(alt(row)) < alt_step * 0.5)
    return out.select("view", "ray", "row", *(F.when(line, inked[c] * LINE_SHARE + LINE_ADD).otherwise(inked[c]).alias(c) for c in "rgb"))


def box_average(sub: DataFrame, ssx: int, ssy: int) -> DataFrame:
    """(view, col, row, r, g, b): the mean of ssx x ssy sub-pixels."""
    n = float(ssx * ssy)
    return sub.groupBy("view", F.floor(F.col("ray") / ssx).cast("int").alias("col"), F.floor(F.col("row") / ssy).cast("int").alias("row")).agg(*((F.sum(c) / n).alias(c) for c in "rgb"))


def pixels(image: DataFrame, strength: float) -> DataFrame:
    """Eight-bit pixels: dithered, clamped, rounded."""
    return image.select("view", "col", "row", *(geo.channel(F.round(F.col(c), 6), F.col("col"), F.col("row"), strength).alias(c) for c in "rgb"))


def nearest_depth(cells: DataFrame, ssx: int, ssy: int) -> DataFrame:
    """(view, col, row, code): the nearest sub-pixel's depth code; pixels without ground have no row."""
    return cells.groupBy("view", F.floor(F.col("ray") / ssx).cast("int").alias("col"), F.floor(F.col("row") / ssy).cast("int").alias("row")).agg(geo.encode_depth(F.min("dist")).alias("code"))


def delta_rows(depth: DataFrame, step: int) -> DataFrame:
    """Depth codes quantised, then as 16-bit differences along each row, which starts from 0."""
    line = W.partitionBy("view", "row").orderBy("col")
    depth = depth.withColumn("q", geo.quantise_depth(F.col("code"), F.lit(step)))
    return depth.withColumn("delta", geo.delta16(F.col("q"), F.lag("q", 1, 0).over(line)))


def undelta_rows(rows: DataFrame) -> DataFrame:
    """The quantised codes back from differences."""
    line = W.partitionBy("view", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("back", F.sum(F.col("delta").cast("bigint")).over(line).bitwiseAND(F.lit(65535)).cast("int"))
