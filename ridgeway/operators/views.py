"""Whole answers: panoramas and viewsheds of many viewpoints in one call, over any surface."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import stage
from . import dem, march, paint, shade
from .peaks import judged


@dataclass(frozen=True)
class Panorama:
    """What a panorama shows."""

    # fixed values: the defaults of requests
    az: float = 0.0
    fov: float = 360.0
    step: float = 0.05
    alt_min: float = -18.0
    alt_max: float = 20.0
    limit: float = 300000.0
    ssx: int = 3
    ssy: int = 3
    eye: float = 1.7
    eye_search_radius: float = 10.0
    ridge_strength: float = 1.0
    ridge_width: float = 1.0
    edge_ratio: float = 1.15
    hidden_ref: float = 500.0
    ground: tuple[float, float, float] = (58.0, 74.0, 52.0)
    ridge: tuple[float, float, float] = (0.0, 0.0, 0.0)
    eye_level: bool = False
    dither: float = 1.0
    depth_step: int = 1
    min_dominance: float = -1000.0
    most_peaks: int = 0

    @property
    def width(self) -> int:
        return math.floor(self.fov / self.step + 0.5)

    @property
    def height(self) -> int:
        return math.floor((self.alt_max - self.alt_min) / self.step + 0.5)

    @property
    def cast(self) -> march.Cast:
        """Sub-columns and sub-rows."""
        frame = march.Frame(self.alt_max, self.step / self.ssy, self.height * self.ssy)
        return march.Cast(self.width * self.ssx, self.limit, first=self.az, step=self.step / self.ssx, frame=frame)


def with_eyes(views: DataFrame, surface, eye: float, search_radius: float) -> DataFrame:
    """Viewpoints (view, lon, lat) with ``ground`` and ``eye``, null where there is no elevation data."""
    return dem.eye_ground(views.select("view", "lon", "lat"), surface, search_radius).withColumn("eye", F.col("ground") + eye)


def panorama(views: DataFrame, surface, p: Panorama, peaks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of the panoramas of all viewpoints.

    ``pixels`` (view, col, row, r, g, b) and ``depth`` (view, col, row, q, delta) hold every pixel of the viewpoints with
    ground; ``status`` says for each viewpoint whether it has any; ``stats`` counts samples and the share of sky; ``peaks``,
    if asked for, are the labelled ones by rank.  What several parts share, eyes and pixels, is stored once.
    """
    cast, frame = p.cast, p.cast.frame
    eyes = stage.stored(with_eyes(views, surface, p.eye, p.eye_search_radius), "eyes")
    seeing = eyes.filter("eye IS NOT NULL")
    done = stage.stored(paint.painted(eyes, surface, p), "pixels")
    shown = done.groupBy("view").agg(F.sum("grounds").alias("n"))
    out = {
        "pixels": done.select("view", "col", "row", "r", "g", "b"),
        "depth": shade.delta_rows(done.select("view", "col", "row", "code"), p.depth_step),
        "status": eyes.select("view", "ground", F.when(F.col("ground").isNull(), "no elevation data").otherwise("ok").alias("status")),
        "stats": shown.select("view", (1 - F.col("n") / float(cast.rays * frame.height)).alias("sky")),
    }
    if peaks is not None:
        pairs = march.peak_candidates(seeing, peaks, p.limit)
        found = march.project_peaks(pairs, surface, p.az, p.step / p.ssx, p.alt_max, p.step, cast.rays)
        ranked = judged(found, eyes, surface, cast, p.ssx, p.fov >= 360.0, p.step)
        out["peaks"] = march.select_peaks(ranked, p.min_dominance, p.most_peaks, p.height)
    return out


def viewshed(views: DataFrame, surface, radius: float = 30000.0, scale: float = 20.0, eye: float = 1.7, eye_search_radius: float = 10.0, target_height: float = 0.0, colour: tuple[int, int, int] = (255, 0, 0)) -> dict[str, DataFrame]:
    """``pixels`` (view, col, row, r, g, b, a) that are seen, ``bounds`` and ``status`` of the viewsheds of all viewpoints."""
    eyes = stage.stored(with_eyes(views, surface, eye, eye_search_radius), "eyes")
    seen = march.viewshed(eyes, surface, radius, scale, target_height)
    colours = [F.lit(v).alias(c) for c, v in zip("rgb", colour)]
    return {
        "pixels": seen.select("view", F.col("ix").alias("col"), F.col("iy").alias("row"), *colours, F.col("alpha").alias("a")),
        "bounds": march.viewshed_bounds(eyes.filter("eye IS NOT NULL"), radius, scale),
        "status": eyes.select("view", "ground", F.when(F.col("ground").isNull(), "no elevation data").otherwise("ok").alias("status")),
    }
