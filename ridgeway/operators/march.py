"""Line of sight as set-based operators: rays, horizon, column fill, probes, profiles, viewshed, peaks.

A row per sector of rays is dealt to tasks, where ``rays`` makes its samples with the horizon before each of them; so no
window sorts samples and over a formula none is shuffled.  Over a stored pyramid each sample is exchanged once, packed, on
its way from its block to its ray.  Many viewpoints run in one job.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from . import rays
from .dem import GRID, tasks_for
from .rays import Cast, Frame

__all__ = ["Cast", "Frame"]


def ladder(lat: Column, limit: float, inclusive: bool, grid: geo.Grid = GRID) -> Column:
    """Array of (level, step, start, n): within a level the steps are equal, so a ladder is at most seven arithmetic runs.

    The next run starts one step beyond the last of the run before; a level ends where the next coarser one is fine enough.
    """
    levels = F.array(*(F.struct(F.lit(z).alias("z"), geo.ground_res(F.lit(z), lat).alias("step"), (geo.ground_res(F.lit(z - 1), lat) / geo.CELL_PER_METRE if z > grid.coarsest else geo.num(1e300)).alias("until")) for z in range(grid.finest, grid.coarsest - 1, -1)))
    whole = "array<struct<level:int,step:double,start:double,n:bigint>>"
    first = F.struct(geo.ground_res(F.lit(grid.finest), lat).alias("at"), F.array().cast(whole).alias("runs"))

    def take(state: Column, l: Column) -> Column:
        last = l["until"] > limit
        span = F.least(l["until"], geo.num(limit)) - state["at"]
        steps = geo.snap(span / l["step"], 9)
        n = F.greatest(F.lit(0), F.when(last & F.lit(inclusive), F.floor(steps) + 1).otherwise(F.ceil(steps)).cast("bigint"))
        run = F.array(F.struct(l["z"].alias("level"), l["step"].alias("step"), state["at"].alias("start"), n.alias("n")))
        return F.struct((state["at"] + n * l["step"]).alias("at"), F.concat(state["runs"], run).alias("runs"))

    return F.filter(F.aggregate(levels, first, take)["runs"], lambda r: r["n"] > 0)


def sectors(views: DataFrame, cast: Cast, beyond: int = 0, per: int | None = None) -> DataFrame:
    """(view, lon, lat, eye, low, high): the rays [low, high) of a view, and so many ``beyond`` them.  Views without an eye (no ground under them) have none.

    Rows are few and each is much work, so they are dealt to a fixed number of tasks that adaptive merging leaves alone.
    """
    per, tasks = per or cast.sector_rays(), tasks_for(views.sparkSession)
    low = F.explode(F.sequence(F.lit(0), F.lit(cast.rays - 1), F.lit(per))).alias("low")
    out = views.filter("eye IS NOT NULL").select(F.col("view").cast("bigint").alias("view"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("eye").cast("double").alias("eye"), low)
    return out.withColumn("high", F.least(F.col("low") + per, F.lit(cast.rays)) + beyond).repartition(tasks, "view", "low")


def samples(views: DataFrame, surface, cast: Cast, *columns: str) -> DataFrame:
    """The samples with data of all rays of all views: the wanted columns of those that ``rays.samples`` makes.

    ``views`` has view, lon, lat, eye.  With a frame, samples after the one that fills the column are left out.
    """
    return surface.along(sectors(views, cast), cast, functools.partial(rays.samples, columns=list(columns)), rays.schema(list(columns)))


def visible(seen: DataFrame) -> DataFrame:
    """Samples with ``visible``: their angle exceeds that of all before."""
    return seen.withColumn("visible", F.col("horizon").isNull() | (F.col("alpha") > F.col("horizon")))


FILLING = ("view", "ray", "d", "f", "prev", "lv")


def filled(fillers: DataFrame) -> DataFrame:
    """(view, ray, row, dist, cover): the written rows of every column; rows without a row here are sky.

    ``fillers`` has the columns FILLING of samples in a frame.  Between two samples that follow each other closely the
    distance runs evenly over the rows; the top row is covered by the share of it that the angle reaches.
    """
    rows = fillers.filter(F.floor("f") < F.col("prev")).withColumn("row", F.explode(F.sequence(F.floor("f").cast("int"), F.col("prev") - 1)))
    top = F.ceil("f")
    ramp = F.col("d") + (F.col("lv") - F.col("d")) * (F.col("row") - top) / F.greatest(F.col("prev") - top, F.lit(1))
    partial = F.col("row") < F.col("f")
    dist = F.when(partial, F.col("d")).when(F.col("d") <= F.col("lv") * 1.05, ramp).otherwise(F.col("d"))
    return rows.select("view", "ray", "row", dist.alias("dist"), F.when(partial, F.col("row") + 1 - F.col("f")).otherwise(1.0).cast("float").alias("cover"))


def profile(samples: DataFrame, per_column: int = 1) -> DataFrame:
    """(view, col, bin, max_h): highest ground per output column and logarithmic distance bin, in single precision."""
    return samples.groupBy("view", F.floor(F.col("ray") / per_column).cast("int").alias("col"), geo.profile_bin(F.col("d")).alias("bin")).agg(F.max(F.col("h").cast("float")).alias("max_h"))


# --- viewshed ------------------------------------------------------------------------------------------------------------


def extent(radius: float, scale: float) -> int:
    return max(1, math.floor(2 * radius / scale + 0.5))


def ray_count(radius: float, scale: float) -> int:
    return max(8, math.ceil(2 * math.pi * radius / scale))


def viewshed(views: DataFrame, surface, radius: float, scale: float, target_height: float = 0.0) -> DataFrame:
    """(view, ix, iy, alpha): opacity of every pixel that some ray sees.  ``views`` has view, lon, lat, eye.

    The ground's tangent makes the horizon; the target, standing on the ground, is seen if its tangent exceeds it.
    """
    px = extent(radius, scale)
    proj = F.lit(float(scale)) / F.cos(F.radians("lat"))
    cast = Cast(ray_count(radius, scale), radius, True, target=target_height)
    s = samples(views, surface, cast, "view", "lon", "lat", "sx", "sy", "tangent", "d", "h", "d0", "h0")
    half = proj * (px / 2.0)
    ix = F.floor(geo.snap((F.col("sx") - (geo.merc_x(F.col("lon")) - half)) / proj, 6))
    iy = F.floor(geo.snap((geo.merc_y(F.col("lat")) + half - F.col("sy")) / proj, 6))
    s = s.select("view", ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), geo.opacity(F.col("tangent"), F.col("d"), F.col("h"), F.col("d0"), F.col("h0")).alias("a"))
    return s.filter(F.col("ix").between(0, px - 1) & F.col("iy").between(0, px - 1)).groupBy("view", "ix", "iy").agg(F.max("a").cast("int").alias("alpha"))


def viewshed_bounds(views: DataFrame, radius: float, scale: float) -> DataFrame:
    """(view, west, south, east, north, px, rays) of the viewshed raster."""
    px = extent(radius, scale)
    half = F.lit(px / 2.0 * scale) / F.cos(F.radians("lat"))
    cx, cy = geo.merc_x(F.col("lon")), geo.merc_y(F.col("lat"))
    return views.select("view", geo.lon_of(cx - half).alias("west"), geo.lat_of(cy - half).alias("south"), geo.lon_of(cx + half).alias("east"), geo.lat_of(cy + half).alias("north"), F.lit(px).alias("px"), F.lit(ray_count(radius, scale)).alias("rays"))


# --- peaks ---------------------------------------------------------------------------------------------------------------


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with some columns computed once, by a generator, where expressions would be repeated in all that uses them."""
    out = df.withColumn("__once", F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))
    return out.withColumns({k: F.col(f"__once.{k}") for k in columns}).drop("__once")


def peak_candidates(views: DataFrame, peaks: DataFrame, limit: float) -> DataFrame:
    """View-peak pairs within ``limit`` metres, with distance and azimuth.

    Both sides meet on cells as high as the range is long; a view looks at the cells around its own (wider ones near the
    poles).  The box then cuts what the great circle decides.
    """
    cell = limit / 111320.0
    reach = F.ceil(1 / F.greatest(F.cos(F.radians("lat")), geo.num(0.05))).cast("int")
    cx, cy = F.floor(F.col("lon") / cell), F.floor(F.col("lat") / cell)
    # few rows are much work: both sides are dealt out, whichever of them Spark finds small enough to broadcast
    tasks = tasks_for(views.sparkSession)
    peaks, near = peaks.repartition(tasks, "osm_id"), views.repartition(tasks, "view")
    near = near.withColumn("__x", F.explode(F.sequence(cx - reach, cx + reach))).withColumn("__y", F.explode(F.sequence(cy - 1, cy + 1)))
    there = peaks.withColumns({"__x": F.floor(F.col("plon") / cell), "__y": F.floor(F.col("plat") / cell)})
    pairs = near.join(there, ["__x", "__y"]).drop("__x", "__y")
    pairs = pairs.filter((F.abs(F.col("plat") - F.col("lat")) <= cell) & (F.abs(F.col("plon") - F.col("lon")) <= cell / F.greatest(F.cos(F.radians("lat")), geo.num(0.05))))
    way = (F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    return once(pairs, distance=geo.snap(geo.great_circle(*way), 6), azimuth=geo.snap(geo.initial_bearing(*way), 6)).filter(F.col("distance") <= limit)


def project_peaks(pairs: DataFrame, surface, az_start: float, az_step: float, alt_max: float, step: float, columns: int) -> DataFrame:
    """Candidates with ele, altitude, image x and y, and the sub-column they fall in (null: outside, or no elevation)."""
    pairs = once(surface.with_height(pairs, ["view", "osm_id"], geo.level_for(F.col("distance"), F.col("lat"), GRID), geo.merc_x(F.col("plon")), geo.merc_y(F.col("plat")), "ele"), ele=F.col("ele"))
    rise = F.col("ele") - F.col("eye") - geo.curvature_drop(F.col("distance"))
    angle = F.when(F.col("distance") > 0, F.atan(F.try_divide(rise, "distance"))).otherwise(F.signum(rise) * F.lit(math.pi / 2))
    pairs = once(pairs, altitude=geo.snap(F.degrees(angle), 9))
    off = F.pmod(F.col("azimuth") - float(az_start), geo.num(360))
    sub = F.floor(geo.snap(off / float(az_step), 6)).cast("int")
    return once(pairs, x=off / float(step), y=(F.lit(float(alt_max)) - F.col("altitude")) / float(step), column=F.when(sub.between(0, columns - 1) & F.col("ele").isNotNull(), sub))


def select_peaks(peaks: DataFrame, min_dominance: float, most: int, height: int) -> DataFrame:
    """Per view the labelled peaks: visible, in frame, dominant enough; the most dominant first, at most ``most`` (0: all)."""
    good = peaks.filter(F.col("visible") & F.col("column").isNotNull() & (F.col("dominance") >= min_dominance) & F.col("y").between(0, height))
    ranked = good.withColumn("rank", F.row_number().over(W.partitionBy("view").orderBy(F.desc("dominance"), "osm_id")))
    return ranked.filter(F.col("rank") <= most) if most else ranked


def peak_counts(peaks: DataFrame, labelled: DataFrame, each: Column | None = None) -> DataFrame:
    """(view, found, seen, labelled): candidates, visible ones and those that get a label; a row of ``peaks`` counts as ``each`` (one)."""
    each = F.lit(1) if each is None else each
    n = peaks.groupBy("view").agg(F.sum(each).alias("found"), F.sum(F.when(F.col("visible"), each).otherwise(0)).alias("seen"))
    m = labelled.groupBy(F.col("view").alias("__v")).agg(F.count(F.lit(1)).alias("labelled"))
    return n.join(m, F.col("view") == F.col("__v"), "left").select("view", "found", "seen", F.coalesce("labelled", F.lit(0)).alias("labelled"))
