"""The registered terrain queries: name -> (spark, sf_dir) -> DataFrame.

Each runs over its whole tables, or over the whole stored window of the test surface (1536 x 1536 cells).  Ranges are a
parameter of the operators; the names that end in ``far`` reach over several levels of the ladder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo
from ..operators import build, dem, march, paint, peaks, places, qa, requests, shade, views
from ..sources import catalogue, fixtures, peakstore, stage
from ..streaming import queue

RAYS, LIMIT = 24, 1200.0
STEP_DEG = 15.0
ALT_MAX, ALT_STEP, HEIGHT = 20.0, 1.0, 40
RADIUS, SCALE, TARGET = 400.0, 20.0, 2.0
PEAK_LIMIT = 800.0
BLOCK_LIMIT, FAR, FAR_PEAKS = 2000.0, 40000.0, 25000.0
GRID = dem.GRID
SURFACE = dem.AnalyticSurface()
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def r6(*names: str) -> list:
    return [geo.snap(F.col(n), 6).alias(n) for n in names]


def eyes(spark: SparkSession, d: str) -> DataFrame:
    return _with_eye(fixtures.views(spark, d))


def _with_eye(views: DataFrame) -> DataFrame:
    v = SURFACE.with_height(views, ["view"], F.lit(14), geo.merc_x(F.col("lon")), geo.merc_y(F.col("lat")), "ground")
    return v.withColumn("eye", F.col("ground") + 1.7)


FRAME = march.Frame(ALT_MAX, ALT_STEP, HEIGHT)
AROUND = march.Cast(RAYS, LIMIT, first=0.0, step=STEP_DEG)
PICTURE = march.Cast(RAYS, LIMIT, first=0.0, step=STEP_DEG, frame=FRAME)


def kept(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return march.samples(eyes(spark, d), SURFACE, PICTURE, *columns)


def cells(spark: SparkSession, d: str) -> DataFrame:
    return march.filled(kept(spark, d, *march.FILLING))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")


# --- geometry ------------------------------------------------------------------------------------------------------------


@query
def geo_project(spark, d):
    v = fixtures.views(spark, d).withColumns({"x": geo.merc_x(F.col("lon")), "y": geo.merc_y(F.col("lat"))})
    return v.select("view", *r6("x", "y"), geo.snap(geo.lon_of(F.col("x")), 6).alias("lon"), geo.snap(geo.lat_of(F.col("y")), 6).alias("lat"))


@query
def geo_distance_bearing(spark, d):
    p = fixtures.peaks(spark, d)
    at = (geo.num(20.01), geo.num(49.01), F.col("plon"), F.col("plat"))
    return p.select("osm_id", geo.snap(geo.great_circle(*at), 4).alias("distance"), geo.snap(geo.initial_bearing(*at), 4).alias("azimuth"))


@query
def geo_destination(spark, d):
    v = fixtures.views(spark, d)
    lon, lat = geo.destination(F.col("lon"), F.col("lat"), (F.col("view") * 37 % 360).cast("double"), (1000 + F.col("view") * 10).cast("double"))
    return v.select("view", geo.snap(lon, 6).alias("lon"), geo.snap(lat, 6).alias("lat"))


@query
def curvature_levels(spark, d):
    dist = (F.col("k") * 7919 % 500000 + 10).cast("double")
    return parts(spark, d).select("k", geo.snap(geo.curvature_drop(dist), 6).alias("drop"), geo.level_for(dist, geo.num(49), GRID).alias("level"), geo.snap(geo.ground_res(geo.level_for(dist, geo.num(49), GRID), geo.num(49)), 6).alias("res"))


@query
def grid_constants(spark, d):
    """Of the level that a part asks for, at its latitude."""
    z = F.col("level")
    p = parts(spark, d).select("k", (8 + F.col("k") % 7).cast("int").alias("level"), (40.0 + F.col("p_size") / 4.0).alias("lat"))
    return p.select("k", "level", geo.tile_px_at(GRID, z).alias("px"), geo.snap(geo.level_res(z), 6).alias("res"), geo.snap(geo.ground_res(z, F.col("lat")), 6).alias("ground"), F.lit(GRID.across).alias("across"))


@query
def tile_extents(spark, d):
    t = fixtures.table(spark, d, "nation").select(F.col("n_nationkey").alias("tx"), (F.col("n_nationkey") * 3 + 20).alias("ty"))
    return t.select("tx", "ty", *(geo.snap(c, 4).alias(k) for k, c in geo.tile_extent(GRID, F.col("tx"), F.col("ty")).items()))


def _boxes(spark, d):
    k = F.col("s_suppkey")
    return fixtures.table(spark, d, "supplier").select(k.alias("id"), (geo.num(-25) + k % 60).alias("lon0"), (geo.num(30) + k % 37).alias("lat0"), (geo.num(-22.5) + k % 60).alias("lon1"), (geo.num(34.25) + k % 55).alias("lat1"))


@query
def bbox_cover(spark, d):
    return catalogue.cover(_boxes(spark, d)).select("id", "tx", "ty")


@query
def bbox_area(spark, d):
    b = [F.col(c) for c in ("lon0", "lat0", "lon1", "lat1")]
    return _boxes(spark, d).select("id", geo.snap(geo.bbox_area_km2(*b), 3).alias("area_km2"), geo.bbox_wkt(*b).alias("wkt"))


@query
def ladder_steps(spark, d):
    v = fixtures.views(spark, d).withColumn("r", F.explode(march.ladder(F.col("lat"), 60000.0, True)))
    return v.groupBy("view").agg(F.sum("r.n").alias("steps"), geo.snap(F.max(F.col("r.start") + (F.col("r.n") - 1) * F.col("r.step")), 4).alias("last"))


# --- catalogue -----------------------------------------------------------------------------------------------------------


def _raw_sources(spark, d):
    """Sources, among them a repeated priority, a flat box and one that would be upsampled."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    lon = (10 + k).cast("double")
    return fixtures.table(spark, d, "nation").select(
        F.when(k == 5, "ALGERIA").otherwise(n).alias("id"), F.lower(n).alias("api_name"), F.concat(F.lit("/data/"), n, F.lit(".tif")).alias("path"), F.when(k == 4, 30).otherwise(10 * k).cast("bigint").alias("priority"),
        F.when(k == 3, 20.0).otherwise(1.0).alias("native_res"), F.lit("EPSG:4326").alias("crs"), F.array(lon, geo.num(45), F.when(k == 2, lon).otherwise(lon + 2), geo.num(47.5)).alias("bbox"), F.when(k == 1, "-9999").when(k == 0, "declared").alias("nodata"),
        F.when(k % 3 == 0, 14).alias("finest_level"), F.lit(None).cast("string").alias("resampling"), F.lit(None).cast("string").alias("footprint"), F.when(k == 4, 5).alias("fill_nodata_md"), F.lit(None).cast("boolean").alias("rebuild_vrt"),
    )


DEFAULTS = {"finest_level": 12, "resampling": "average", "footprint": "tiles", "rebuild_vrt": False}


@query
def catalog_resolved(spark, d):
    return catalogue.resolved(_raw_sources(spark, d), DEFAULTS).select("id", "priority", "finest_level", "resampling", "footprint", "nodata_value", "nodata_declared", "lon0", "lat0", "lon1", "lat1")


@query
def catalog_violations(spark, d):
    return catalogue.violations(catalogue.resolved(_raw_sources(spark, d), DEFAULTS))


@query
def index_plan(spark, d):
    return catalogue.index_plan(fixtures.layers(spark, d), "/dem")


@query
def elevation_sources(spark, d):
    return catalogue.elevation_sources(catalogue.resolved(_raw_sources(spark, d), DEFAULTS))


@query
def source_order(spark, d):
    return dem.ranked_layers(fixtures.layers(spark, d)).select("source_id", "priority", F.col("rank").cast("bigint").alias("rank"))


@query
def build_environment(spark, d):
    return catalogue.build_environment(catalogue.cover(catalogue.resolved(_raw_sources(spark, d), DEFAULTS)), "/dem")


def _planned(spark, d):
    k = F.col("s_suppkey")
    tiles = catalogue.cover(_boxes(spark, d).withColumn("source_id", F.col("id") % 5)).select("source_id", "tx", "ty").distinct()
    prints = fixtures.table(spark, d, "supplier").filter(k % 5 < 3).select((k % 5).alias("source_id"), (geo.num(-24) + k % 60).alias("lon0"), (geo.num(31) + k % 37).alias("lat0"), (geo.num(-23.5) + k % 60).alias("lon1"), (geo.num(31.5) + k % 37).alias("lat1"))
    built = tiles.filter((F.col("tx") + F.col("ty")) % 4 == 0).withColumn("level", F.when(F.col("tx") % 2 == 0, 14).otherwise(11))
    return tiles, prints, built


@query
def tile_plan_semi_anti(spark, d):
    tiles, prints, built = _planned(spark, d)
    return catalogue.unbuilt(catalogue.touching(tiles, prints), built).select("source_id", "tx", "ty")


@query
def build_progress(spark, d):
    tiles, _, built = _planned(spark, d)
    t = tiles.join(built.select("source_id", "tx", "ty", F.lit(1).alias("b")), ["source_id", "tx", "ty"], "left")
    n = t.rollup("source_id").agg(F.count(F.lit(1)).alias("planned"), F.sum(F.coalesce("b", F.lit(0))).cast("bigint").alias("built"))
    return n.withColumn("source_id", F.coalesce("source_id", F.lit(-1)).cast("bigint"))  # -1: the total


def _files(spark, d):
    """Paths of built tiles, with half-written ones among them."""
    tiles, _, built = _planned(spark, d)
    k = F.col("tx") + 2 * F.col("ty")
    name = F.concat(F.lit("/dem/norm/"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "/14/").otherwise("/12/"), F.col("tx").cast("string"), F.lit("_"), F.col("ty").cast("string"), F.when(k % 7 == 0, ".tmp.tif").otherwise(".tif"))
    return built.join(fixtures.table(spark, d, "nation"), F.col("source_id") == F.col("n_nationkey")).select(name.alias("location"))


@query
def tile_scan(spark, d):
    return catalogue.tiles_of(_files(spark, d)).select("source_id", "built_level", "tx", "ty", "location")


@query
def tile_priority(spark, d):
    return catalogue.with_priority(catalogue.tiles_of(_files(spark, d)), fixtures.layers(spark, d)).select("location", "source_id", "priority")


@query
def level_index(spark, d):
    return catalogue.level_index(catalogue.tiles_of(_files(spark, d)), fixtures.layers(spark, d))


@query
def only_sources(spark, d):
    return catalogue.only(catalogue.resolved(_raw_sources(spark, d), DEFAULTS), "NATION_3,NATION_20,NOWHERE").select("id", "priority")


@query
def build_order(spark, d):
    return catalogue.build_order(catalogue.resolved(_raw_sources(spark, d), DEFAULTS).filter("priority <> 30"), ["NATION_9", "NATION_20", "NATION_6"]).select("id", F.col("turn").cast("bigint").alias("turn"))


def _steps(spark, d):
    k = F.col("s_suppkey")
    return fixtures.table(spark, d, "supplier").select(F.concat(F.lit("tile-"), k.cast("string")).alias("step"), (k * 37 % 101).alias("seconds"), (k * 53 % 211).alias("finished"))


@query
def cheapest_steps(spark, d):
    return catalogue.cheapest(_steps(spark, d), 3).select("step", "seconds")


@query
def latest_steps(spark, d):
    return catalogue.latest(_steps(spark, d)).select("step", "finished")


# --- raster --------------------------------------------------------------------------------------------------------------


@query
def elev_codec(spark, d):
    h = (F.col("k") % 7000 - 600) * 1.0 + F.col("p_size") / 7.0
    p = parts(spark, d).withColumn("code", geo.elevation_code(h))
    return p.select("k", "code", geo.snap(geo.elevation(F.col("code")), 4).alias("metres"))


def _mosaic_samples(spark, d):
    c = fixtures.window_cells(spark).withColumn("key", F.explode(fixtures.covering(F.col("x"), F.col("y"))))
    return c.join(fixtures.layers(spark, d), "key").withColumn("value", fixtures.surface_code(F.col("x"), F.col("y")) + F.col("key"))


@query
def mosaic_priority(spark, d):
    return dem.mosaic(_mosaic_samples(spark, d), "x", "y").select("x", "y", F.col("value").cast("bigint").alias("value"), F.col("priority").cast("bigint").alias("priority"))


@query
def overview_avg(spark, d):
    c = fixtures.raster(spark, d).select(F.lit(14).alias("level"), "x", "y", "v")
    return dem.overviews(c, GRID.coarsest).filter("level < 14").select("level", "x", "y", F.col("v").cast("bigint").alias("v"))


def _points(spark, d):
    return fixtures.peaks(spark, d).select("osm_id", geo.merc_x(F.col("plon")).alias("x"), geo.merc_y(F.col("plat")).alias("y"))


def stored(spark, levels=(14,), sparse=False):
    return dem.Pyramid.open(spark, fixtures.stored_pyramid(spark, levels, sparse))


@query
def sample_blocks(spark, d):
    return stored(spark).nearest(_points(spark, d), F.lit(14), F.col("x"), F.col("y")).select("osm_id", *r6("h"))


@query
def sample_bilinear(spark, d):
    return stored(spark).bilinear(_points(spark, d), F.lit(14), F.col("x"), F.col("y")).select("osm_id", geo.snap("h", 4).alias("h"))


@query
def level_fallback(spark, d):
    found = stored(spark, (14, 12), True).with_height(_points(spark, d), ["osm_id"], F.lit(14), F.col("x"), F.col("y"), found="z")
    return found.select("osm_id", geo.snap("h", 4).alias("h"), F.coalesce("z", F.lit(-1)).alias("z"))


@query
def eye_fallback(spark, d):
    return dem.eye_ground(fixtures.views(spark, d), stored(spark, (14, 12), True), 10.0).select("view", geo.snap("ground", 4).alias("ground"))


@query
def eye_elevation(spark, d):
    return dem.eye_ground(fixtures.views(spark, d), SURFACE, 10.0).select("view", *r6("ground"))


@query
def speckle_fill(spark, d):
    return dem.fill_speckles(fixtures.speckled(spark, d), 5).select("x", "y", F.col("v").cast("bigint").alias("v"))


@query
def warp_average(spark, d):
    """The raster on a grid of 2.5 by 1.6 cells that begins between cells."""
    w = dem.warp_average(fixtures.raster(spark, d), (2.5, 1.6), (0.7, -3.3))
    return w.select("x", "y", geo.snap("v", 4).alias("v"))


TILES = geo.Grid(tile_px=512, block_px=32, finest=14, coarsest=10)
LAYERS = (
    build.Source("east", "EPSG:3857", 2226400.0, 6274900.0, 16.3, 14, nodata=0.0, fill=2),
    build.Source("west", "EPSG:4326", 20.03, 49.0, 0.0002, 13, nodata=0.0),
    build.Source("whole", "EPSG:4326", 20.01, 49.02, 0.00021, 13, nodata=0.0, resampling="bilinear"),
)


@query
def layer_tiles(spark, d):
    """Halves of the raster and the whole of it as three sources, built in two goes and read back: every code at every level."""
    r = fixtures.raster(spark, d).select("x", "y", (F.col("v") * 0.5).alias("v"))
    given = [r.filter("x < 160"), r.filter("x >= 160").withColumn("x", F.col("x") - 160), r]
    cells = stage.stored(reduce(DataFrame.unionByName, (c.select(F.lit(s.source_id).alias("source_id"), "x", "y", "v") for s, c in zip(LAYERS, given))), "layers")
    root = stage.new_path(spark, "layer-a")
    build.build(cells, LAYERS[:2], catalogue.cover(spark.sql("SELECT explode(array('east', 'west')) AS source_id, 19.99D AS lon0, 48.94D AS lat0, 20.09D AS lon1, 49.03D AS lat1"), TILES), root, TILES, 16)
    build.region(cells, LAYERS[2], (19.99, 48.94, 20.09, 49.03), root, TILES, 16)
    return build.cells_of(build.read(spark, root), TILES.block_px).withColumn("v", F.col("v").cast("bigint"))


# --- line of sight -------------------------------------------------------------------------------------------------------


@query
def viewshed_cells(spark, d):
    return march.viewshed(eyes(spark, d), SURFACE, RADIUS, SCALE, TARGET).select("view", "ix", "iy", "alpha")


@query
def viewshed_stats(spark, d):
    c = march.viewshed(eyes(spark, d), SURFACE, RADIUS, SCALE, TARGET)
    return c.groupBy("view").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("alpha").cast("bigint")).alias("opacity"))


@query
def viewshed_bounds(spark, d):
    return march.viewshed_bounds(fixtures.views(spark, d), RADIUS, SCALE).select("view", *r6("west", "south", "east", "north"), "px", "rays")


@query
def ray_horizon(spark, d):
    return _horizon(march.samples(eyes(spark, d), SURFACE, AROUND, "view", "ray", "alpha", "horizon"))


def _horizon(samples):
    return march.visible(samples).groupBy("view", "ray").agg(F.count(F.lit(1)).alias("samples"), F.count_if("visible").alias("visible"), geo.snap(F.max("alpha"), 6).alias("horizon"))


def _over_blocks(spark, d):
    """Viewpoints on the stored sparse pyramid, with their ground from it, and the pyramid."""
    pyramid = stored(spark, (14, 12), True)
    return dem.eye_ground(fixtures.views(spark, d), pyramid, 10.0).withColumn("eye", F.col("ground") + 1.7), pyramid


@query
def ray_horizon_blocks(spark, d):
    cast = march.Cast(RAYS, BLOCK_LIMIT, first=0.0, step=STEP_DEG)
    return _horizon(march.samples(*_over_blocks(spark, d), cast, "view", "ray", "alpha", "horizon"))


@query
def viewshed_blocks(spark, d):
    return march.viewshed(*_over_blocks(spark, d), RADIUS, SCALE, TARGET).select("view", "ix", "iy", "alpha")


@query
def ray_horizon_far(spark, d):
    """Over three levels of the ladder."""
    return _horizon(march.samples(eyes(spark, d), SURFACE, march.Cast(RAYS, FAR, first=0.0, step=STEP_DEG), "view", "ray", "alpha", "horizon"))


@query
def viewshed_far(spark, d):
    return march.viewshed(eyes(spark, d), SURFACE, FAR, FAR / 5, TARGET).select("view", "ix", "iy", "alpha")


@query
def ray_stats(spark, d):
    return kept(spark, d, "view", "level", "sx", "sy").groupBy("view").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(F.struct("level", F.floor(geo.snap((F.col("sx") + geo.ORIGIN) / geo.level_res(F.col("level")), 6) / 512), F.floor(geo.snap((geo.num(geo.ORIGIN) - F.col("sy")) / geo.level_res(F.col("level")), 6) / 512))).alias("blocks"))


@query
def column_stop(spark, d):
    return kept(spark, d, "view", "ray", "d").groupBy("view", "ray").agg(F.count(F.lit(1)).alias("kept"), geo.snap(F.max("d"), 4).alias("last"))


@query
def column_fill(spark, d):
    return cells(spark, d).select("view", "ray", "row", geo.snap("dist", 4).alias("dist"), geo.snap(F.col("cover").cast("double"), 5).alias("cover"))


@query
def sky_fraction(spark, d):
    n = cells(spark, d).groupBy("view").agg(F.count(F.lit(1)).alias("n"))
    return n.select("view", geo.snap(1 - F.col("n") / float(RAYS * HEIGHT), 6).alias("sky"))


@query
def profile_bins(spark, d):
    return march.profile(kept(spark, d, "view", "ray", "d", "h")).select("view", "col", "bin", geo.snap(F.col("max_h").cast("double"), 3).alias("max_h"))


@query
def profile_band_max(spark, d):
    lo, hi = geo.profile_bin(geo.num(250)), geo.profile_bin(geo.num(1000))
    return march.profile(kept(spark, d, "view", "ray", "d", "h")).filter(F.col("bin").between(lo, hi)).groupBy("view", "col").agg(geo.snap(F.max("max_h").cast("double"), 3).alias("top"))


# --- peaks ---------------------------------------------------------------------------------------------------------------


class Meeting:
    """Places of views and peaks, the pairs between them, and who stands there."""

    def __init__(self, spark, d, limit=PEAK_LIMIT):
        self.views, self.viewers = places.merged(fixtures.views(spark, d), "view", "lon", "lat")
        self.places, self.peaks = places.merged(fixtures.peaks(spark, d), "osm_id", "plon", "plat")
        self.eyes, self.limit = _with_eye(self.views), limit

    def spread(self, pairs: DataFrame) -> DataFrame:
        return places.spread(pairs, self.viewers, self.peaks)

    def projected(self) -> DataFrame:
        pairs = march.peak_candidates(self.eyes, self.places, self.limit)
        return march.project_peaks(pairs, SURFACE, 0.0, STEP_DEG, ALT_MAX, STEP_DEG, RAYS)

    def judged(self, cast=PICTURE, step=None) -> DataFrame:
        return peaks.judged(self.projected().select(*ASKING), self.eyes, SURFACE, cast, 1, True, step)

    def dominant(self, cast=PICTURE) -> DataFrame:
        return self.judged(cast, STEP_DEG).withColumn("dominance", geo.snap("dominance", 3))

    def labelled(self, ranked: DataFrame) -> DataFrame:
        return places.select_peaks(ranked, self.peaks, -1000.0, 5, HEIGHT)

    def top(self, cast=PICTURE) -> DataFrame:
        top = self.labelled(self.dominant(cast)).select("view", "osm_id", "dominance", F.col("rank").cast("bigint").alias("rank"))
        return places.spread_views(top, self.viewers)


ASKING = ("view", "osm_id", "ele", "distance", "altitude", "x", "y", "column")


@query
def peak_candidates(spark, d):
    m = Meeting(spark, d)
    return m.spread(march.peak_candidates(m.views, m.places, PEAK_LIMIT).select("view", "osm_id", "distance", "azimuth"))


@query
def peak_projection(spark, d):
    m = Meeting(spark, d)
    return m.spread(m.projected().select("view", "osm_id", geo.snap("ele", 3).alias("ele"), geo.snap("altitude", 5).alias("altitude"), geo.snap("x", 7).alias("x"), geo.snap("y", 10).alias("y"), F.coalesce("column", F.lit(-1)).alias("column")))


@query
def peak_bracketing(spark, d):
    m = Meeting(spark, d)
    p = m.projected().filter("column IS NOT NULL").withColumn("b", F.explode(geo.bracket(geo.snap("x", 6), F.lit(RAYS), F.lit(True)))).filter("b.ray IS NOT NULL")
    return m.spread(p.select("view", "osm_id", F.col("b.slot").alias("slot"), F.col("b.ray").alias("ray"), geo.snap(geo.bracket_weight(geo.snap("x", 6)), 6).alias("t")))


@query
def peak_visibility(spark, d):
    m = Meeting(spark, d)
    return m.spread(m.judged().select("view", "osm_id", "visible"))


@query
def peak_dominance(spark, d):
    m = Meeting(spark, d)
    return m.spread(m.dominant().filter("visible").select("view", "osm_id", "dominance"))


@query
def peak_topk(spark, d):
    return Meeting(spark, d).top()


@query
def peak_counts(spark, d):
    m = Meeting(spark, d)
    ranked = stage.stored(m.dominant(), "ranked")
    return places.spread_views(places.peak_counts(ranked, m.labelled(ranked), m.peaks), m.viewers)


@query
def peak_far(spark, d):
    """The same with peaks as far as a chain of mountains shows."""
    return Meeting(spark, d, FAR_PEAKS).top(march.Cast(RAYS, FAR_PEAKS, first=0.0, step=STEP_DEG, frame=FRAME))


# --- depth and shading ---------------------------------------------------------------------------------------------------


@query
def depth_encode(spark, d):
    dist = F.when(F.col("k") % 50 == 0, None).otherwise(F.col("k") * 211 % 450000 + 0.5)
    p = parts(spark, d).withColumn("code", geo.encode_depth(dist))
    return p.select("k", "code", geo.snap(geo.decode_depth(F.col("code")), 3).alias("back"))


@query
def depth_quantise(spark, d):
    p = parts(spark, d).withColumns({"code": (F.col("k") * 7919 % 65536).cast("int"), "step": (F.col("p_size") % 17).cast("int")})
    return p.select("k", geo.quantise_depth(F.col("code"), F.col("step")).cast("bigint").alias("q"), geo.snap(geo.depth_error_percent(F.col("step")), 6).alias("error"))


class Coarse(views.Panorama):
    """The picture of PICTURE: pixels of two rays by two rows."""

    width, height, cast = RAYS // 2, HEIGHT // 2, PICTURE


PIXELS = Coarse(ssx=2, ssy=2, alt_max=ALT_MAX, ridge_width=0.5, eye_level=True)


def _depth(spark, d):
    return paint.averaged(eyes(spark, d), SURFACE, PIXELS).select("view", "col", "row", geo.encode_depth(F.col("dist")).alias("code"))


@query
def depth_delta(spark, d):
    return shade.delta_rows(_depth(spark, d), 4).select("view", "col", "row", F.col("q").cast("bigint").alias("q"), F.col("delta").cast("bigint").alias("delta"))


@query
def depth_roundtrip(spark, d):
    r = shade.undelta_rows(shade.delta_rows(_depth(spark, d), 16))
    return r.groupBy("view").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("back") == F.col("q")).alias("equal"))


def _subpixels(spark, d, *columns):
    return paint.subpixels(eyes(spark, d), SURFACE, PIXELS, *columns)


@query
def edge_strength(spark, d):
    return _subpixels(spark, d, "edge").filter("edge > 0").select("view", "ray", "row", geo.snap("edge", 5).alias("edge"))


@query
def ink_spread(spark, d):
    return _subpixels(spark, d, "ink").filter("ink > 0").select("view", "ray", "row", geo.snap("ink", 5).alias("ink"))


@query
def shaded_column(spark, d):
    """A column's colours as sums over its rows, each row weighted by its place."""
    levels = (F.sum((F.col("row") + 1) * F.rint(geo.snap(c, 3) * 1000).cast("bigint")).alias(c) for c in "rgb")
    return _subpixels(spark, d, "r", "g", "b").groupBy("view", "ray").agg(F.count(F.lit(1)).alias("rows"), *levels)


def _painted(spark, d):
    return paint.painted(eyes(spark, d), SURFACE, PIXELS)


@query
def panorama_pixels(spark, d):
    """Whole pictures, painted sector by sector."""
    return _painted(spark, d).select("view", "col", "row", *(F.col(c).cast("bigint").alias(c) for c in "rgb"))


@query
def panorama_depth(spark, d):
    rows = shade.delta_rows(_painted(spark, d).select("view", "col", "row", "code"), 4)
    return rows.select("view", "col", "row", F.col("q").cast("bigint").alias("q"), F.col("delta").cast("bigint").alias("delta"))


@query
def supersample_avg(spark, d):
    return paint.averaged(eyes(spark, d), SURFACE, PIXELS).select("view", "col", "row", *(geo.snap(c, 3).alias(c) for c in "rgb"))


@query
def dither_levels(spark, d):
    p = parts(spark, d).select((F.col("k") % 317).alias("x"), F.floor(F.col("k") / 317).alias("y"), F.col("p_size"))
    return p.select("x", "y", geo.snap(geo.dither(F.col("x"), F.col("y")), 6).alias("noise"), geo.channel(geo.snap(100 + F.col("p_size") / 3.0, 6), F.col("x"), F.col("y"), 1.0).cast("bigint").alias("level"))


# --- requests, texts, checks -----------------------------------------------------------------------------------------------


def _asked(spark, d):
    e = fixtures.table(spark, d, "events")
    k = F.col("event_id")
    return e.select(k.alias("id"), F.lit(20.0).alias("lon"), F.when(k % 13 == 0, float("nan")).otherwise(49.0).alias("lat"), F.when(k % 5 == 0, None).otherwise(k % 7 / 20.0).alias("step"), (k % 500 - 20.0).alias("fov"), F.when(k % 11 == 0, 95.0).otherwise(k % 60 * 1.0).alias("alt_max"), (k % 30 * 2000.0 - 4000.0).alias("radius"), (k % 9 * 3.0).alias("scale"), F.when(k % 17 == 0, -1.0).otherwise(1.0).alias("ridge_strength"))


@query
def request_validation(spark, d):
    return requests.panorama(_asked(spark, d).drop("radius", "scale")).select("id", "status", "error", "width", "height")


@query
def viewshed_validation(spark, d):
    return requests.viewshed(_asked(spark, d).drop("step", "fov", "alt_max", "ridge_strength")).select("id", "status", "error", F.coalesce("px", F.lit(0)).cast("bigint").alias("px"))


@query
def json_requests(spark, d):
    k = F.col("event_id")
    body = F.concat(F.lit('{"lon": '), (k % 40).cast("string"), F.when(k % 6 == 0, ',"lat":"north"').when(k % 7 == 0, ', "lat": 49.5, "fov": 90, "more": [1]').when(k % 11 == 0, ', "lat"').otherwise(', "lat": 49.5'), F.lit("}"))
    r = requests.parsed(fixtures.table(spark, d, "events").select(k.alias("id"), body.alias("body")), "panorama")
    return r.select("id", "malformed", F.when(~F.col("malformed"), F.col("lon")).otherwise(-1.0).alias("lon"), F.when(~F.col("malformed"), F.coalesce("fov", F.lit(360.0))).otherwise(0.0).alias("fov"))


@query
def colour_parse(spark, d):
    h = F.lower(F.lpad(F.hex(F.col("k") * 9973 % 16777216), 6, "0"))
    s = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" #"), h)).when(F.col("k") % 4 == 1, F.substring(h, 1, 3)).when(F.col("k") % 4 == 2, F.substring(h, 1, 5)).otherwise(F.concat(F.lit("##"), h))
    p = parts(spark, d).withColumn("s", s)
    return p.select("k", "s", *(F.coalesce(c, F.lit(-1)).cast("bigint").alias(n) for n, c in geo.parse_colour(F.col("s")).items()))


@query
def compass_names(spark, d):
    return parts(spark, d).select("k", geo.compass((F.col("k") * 37 % 3600) / 10.0).alias("name"))


@query
def crs_match(spark, d):
    k = F.col("n_nationkey")
    a = F.when(k % 3 == 0, "+proj=longlat +datum=WGS84 +no_defs").when(k % 3 == 1, "+proj=utm +zone=34 +datum=WGS84 +units=m +type=crs").otherwise("+proj=merc +a=6378137")
    b = F.when(k % 2 == 0, "+datum=WGS84 +proj=longlat").otherwise("+units=m +proj=utm +datum=WGS84 +zone=34 +no_defs")
    n = fixtures.table(spark, d, "nation").withColumns({"a": a, "b": b})
    return n.select(F.col("n_nationkey").alias("k"), geo.normalised_crs(F.col("a")).alias("norm"), geo.crs_matches(F.when(k % 5 == 0, F.lit("EPSG:1")), F.lit("EPSG:1"), F.col("a"), F.col("b")).alias("same"))


@query
def csv_split(spark, d):
    p = parts(spark, d).withColumn("line", F.concat(F.col("k").cast("string"), F.lit(',"'), F.replace("p_name", F.lit(" "), F.lit(', ""')), F.lit('",,'), F.col("p_size").cast("string")))
    return p.withColumn("f", catalogue.split_csv(F.col("line"))).select("k", F.size("f").cast("bigint").alias("n"), F.element_at("f", 2).alias("name"), F.element_at("f", -1).alias("last"))


@query
def peak_lines(spark, d):
    """Peaks as lines of text, every third without an elevation, every fifth with a bad id, every seventh cut short; read again."""
    p = fixtures.peaks(spark, d)
    k, s = F.col("osm_id"), (lambda c: F.col(c).cast("string"))
    name = F.when(k % 2 == 0, F.concat(F.lit('"'), "name", F.lit(', the ""old"""'))).otherwise(F.concat(F.lit('x"a,b"'), "name"))
    rest = F.concat(F.lit(","), F.when(k % 3 == 0, "").otherwise((k % 3000).cast("string")), F.when(k % 4 == 0, ',"open, end').otherwise(""))
    line = F.concat(s("plon"), F.lit(","), s("plat"), F.lit(","), F.when(k % 5 == 0, "n/a").otherwise(s("osm_id")), F.lit(","), name, F.lit(","), "type", F.when(k % 7 == 0, "").otherwise(rest))
    return peakstore.parsed(p.select(line.alias("value")).unionAll(spark.sql("SELECT 'X,Y,osm_id,name,type,ele' AS value"))).withColumns({c: geo.snap(c, 6) for c in ("plon", "plat")})


@query
def mime_types(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("avif", "png", "gz", "json", "x.png"))), (F.col("k") % 5 + 1).cast("int"))
    return parts(spark, d).select("k", geo.content_type(F.concat(F.lit("part."), ext)).alias("mime"), geo.shell_quote(F.col("p_name")).alias("quoted"), geo.priority_of(F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("high")).cast("bigint").alias("priority"))


def _descriptors(spark, d):
    k = F.col("n_nationkey")
    s = lambda c: c.cast("string")
    rect = lambda x: F.concat(F.lit('<DstRect xOff="'), s(x), F.lit('" yOff="0" xSize="'), s(100 + k), F.lit('" ySize="50"/>'))
    xml = F.concat(
        F.lit("<VRTDataset><SRS>EPSG:3857</SRS><GeoTransform>"), s(k * 1000.0), F.lit(", 25.0, 0.0, 500000.0, 0.0, -25.0</GeoTransform><VRTRasterBand><ComplexSource><SourceFilename relativeToVRT=\"1\">"), F.col("n_name"), F.lit(".tif</SourceFilename>"), rect(k),
        F.lit("</ComplexSource><SimpleSource><SourceFilename relativeToVRT=\"0\">/abs/"), F.col("n_name"), F.lit(".tif</SourceFilename>"), rect(k * 2), F.lit("</SimpleSource></VRTRasterBand></VRTDataset>"),
    )
    return qa.parse_descriptors(fixtures.table(spark, d, "nation").select(F.concat(F.lit("/vrt/"), "n_name", F.lit(".vrt")).alias("file"), xml.alias("xml")))


@query
def vrt_leaf_files(spark, d):
    return qa.leaf_files(_descriptors(spark, d))


@query
def descriptor_rebuild(spark, d):
    """Descriptors with a value for uncovered canvas, and the leaf files that they name when read again."""
    texts = qa.rebuilt(_descriptors(spark, d))
    again = qa.parse_descriptors(texts)
    return qa.leaf_files(again).join(texts, "file").join(again.select("file", "nodata"), "file")


@query
def footprint_area(spark, d):
    return qa.footprint_summary(_descriptors(spark, d)).select("file", "parts", F.col("sources").cast("bigint").alias("sources"), "area_km2")


@query
def footprint_fill(spark, d):
    k = F.col("n_nationkey")
    boxes = fixtures.table(spark, d, "nation").select(F.concat(F.lit("/vrt/"), "n_name", F.lit(".vrt")).alias("file"), (k / 10.0).alias("lon0"), geo.num(45).alias("lat0"), (k / 10.0 + 0.05).alias("lon1"), geo.num(45.05).alias("lat1"))
    return qa.fill(qa.footprint_summary(_descriptors(spark, d)), boxes).select("file", "bbox_area_km2", geo.snap("fill", 4).alias("fill"))


@query
def rect_wkt(spark, d):
    return qa.footprint_parts(_descriptors(spark, d)).select("file", "wkt")


@query
def drift_check(spark, d):
    k = F.col("n_nationkey")
    n = fixtures.table(spark, d, "nation")
    src = n.select(F.col("n_name").alias("id"), F.lit("EPSG:3857").alias("crs"), F.lit("+proj=merc").alias("proj4"), F.lit(10.0).alias("native_res"), F.when(k % 3 == 0, -9999.0).alias("nodata_value"), (k % 3 != 0).alias("nodata_declared"))
    res = F.when(k % 4 == 1, "10.6").otherwise("10.2")
    nodata = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit('"noDataValue":'), F.when(k % 2 == 0, "-9999").otherwise("-32768")))
    head = F.concat(F.lit('{"geoTransform":[0,'), res, F.lit(',0,0,0,-10],"size":[4,5],"coordinateSystem":{"wkt":"PROJCRS[\\"Web\\",1]"},"bands":[{'), nodata, F.lit("}]}"))
    headers = n.filter(k % 7 != 6).select(F.col("n_name").alias("id"), head.alias("header"), F.when(k % 6 == 0, "9").otherwise("3857").alias("epsg"), F.lit("+proj=longlat").alias("proj4"))
    return qa.drift(src, headers)


@query
def queue_schedule(spark, d):
    return queue.schedule(fixtures.requests(spark, d))


@query
def client_admission(spark, d):
    r = fixtures.requests(spark, d)
    return queue.admission(r.select(F.col("queue_id").cast("bigint").alias("client"), "seq", "arrival"))
