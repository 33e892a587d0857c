"""Requests as rows: defaults, validation with a status, clamps, image size, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: defaults and limits of the two request kinds
PANORAMA = {"az": 0.0, "fov": 360.0, "alt_min": -18.0, "alt_max": 20.0, "step": 0.05, "eye": 1.7, "eye_search_radius": 10.0, "range": 300000.0, "ssx": 3, "ssy": 3, "ridge_strength": 1.0, "ridge_width": 1.0, "dither": 1.0, "quality": 95, "depth_step": 1}
VIEWSHED = {"radius": 30000.0, "scale": 20.0, "eye": 1.7, "eye_search_radius": 10.0, "target_height": 0.0, "quality": 95}
MOST_PIXELS = 24_000_000
LEAST_STEP = 0.02


#: what the bodies of the two kinds of requests may hold; other fields are ignored
BODY = {kind: ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in ({"lon": 0.0, "lat": 0.0} | defaults).items()) for kind, defaults in (("panorama", PANORAMA), ("viewshed", VIEWSHED))}


def parsed(bodies: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Rows with their JSON ``body`` as columns; ``malformed`` where it is no object of the right types, or lacks lon or lat."""
    doc = F.from_json(body, BODY[kind] + ", __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = bodies.withColumn("__doc", doc).select(*(c for c in bodies.columns if c != body), "__doc.*")
    return out.withColumn("malformed", F.col("__bad").isNotNull() | F.col("lon").isNull() | F.col("lat").isNull()).drop("__bad")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _filled(requests: DataFrame, defaults: dict) -> DataFrame:
    have = set(requests.columns)
    return requests.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()})


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def panorama(requests: DataFrame) -> DataFrame:
    """Requests with defaults, clamps, width, height, error (null: none) and status 200 or 400."""
    r = _filled(requests, PANORAMA)
    finite = None
    for c in ("lon", "lat", "az", "fov", "step", "alt_min", "alt_max"):
        test = F.when(~_finite(F.col(c)), f"{c} must be a finite number")
        finite = test if finite is None else F.coalesce(finite, test)
    style = F.when(~_finite(F.col("ridge_strength")) | ~_finite(F.col("ridge_width")), "ridge style must be finite").when(F.col("ridge_strength") < 0, "ridge_strength must not be negative").when(~F.col("ridge_width").between(0, 20), "ridge_width must lie within 0..20")
    alt = F.when(~F.col("alt_min").between(-90, 90) | ~F.col("alt_max").between(-90, 90), "alt_min and alt_max must lie within -90..90").when(F.col("alt_max") <= F.col("alt_min"), "alt_max must exceed alt_min")
    r = r.withColumn("error", F.coalesce(finite, style, alt, F.when(~_finite(F.col("eye")) | ~_finite(F.col("range")), "eye and range must be finite")))
    if "min_prominence" in requests.columns:
        r = r.withColumn("error", F.coalesce("error", F.when(F.col("min_prominence").isNotNull(), "min_prominence was replaced by min_dominance")))
    ok = F.col("error").isNull()
    safe = lambda c, other: F.when(ok, c).otherwise(F.lit(other))
    r = r.withColumns({"step": F.greatest(F.lit(LEAST_STEP), safe(F.col("step"), 1.0)), "fov": _clip(safe(F.col("fov"), 360.0), 0.1, 360.0)})
    width, height = F.round(F.col("fov") / F.col("step")).cast("bigint"), F.round(safe((F.col("alt_max") - F.col("alt_min")) / F.col("step"), 1.0)).cast("bigint")
    r = r.withColumns({"width": width, "height": height})
    r = r.withColumn("error", F.coalesce("error", F.when(F.col("width") * F.col("height") > MOST_PIXELS, "too many pixels")))
    clamps = {"eye_search_radius": (0.0, 200.0), "range": (1000.0, 400000.0), "ssx": (1, 9), "ssy": (1, 9), "dither": (0.0, 8.0), "quality": (1, 100)}
    r = r.withColumns({k: _clip(F.col(k), *v) for k, v in clamps.items()}).withColumn("depth_step", F.greatest(F.lit(1), "depth_step"))
    return r.withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))


def viewshed(requests: DataFrame) -> DataFrame:
    """The same for viewsheds, with ``px``, the raster's side."""
    r = _filled(requests, VIEWSHED)
    finite = F.lit(None).cast("string")
    for c in ("lon", "lat", "radius", "scale", "eye", "target_height"):
        finite = F.coalesce(finite, F.when(~_finite(F.col(c)), f"{c} must be a finite number"))
    bad = F.when((F.col("radius") <= 0) | (F.col("radius") > 200000), "radius must lie within 0..200000").when(F.col("scale") <= 0, "scale must be positive")
    r = r.withColumn("error", F.coalesce(finite, bad))
    px = F.when(F.col("error").isNull(), F.greatest(F.lit(1), F.round(_clip(2 * F.col("radius") / F.col("scale"), 0.0, 1e9)).cast("bigint")))
    r = r.withColumn("px", px).withColumn("error", F.coalesce("error", F.when(F.col("px") * F.col("px") > MOST_PIXELS, "too many pixels")))
    r = r.withColumns({"target_height": _clip(F.col("target_height"), 0.0, 1000.0), "eye_search_radius": _clip(F.col("eye_search_radius"), 0.0, 200.0), "quality": _clip(F.col("quality"), 1, 100)})
    return r.withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))


def metadata(stats: DataFrame, *columns: str) -> DataFrame:
    """(view, meta): the named statistics as one JSON document a view."""
    return stats.select("view", F.to_json(F.struct(*columns)).alias("meta"))
