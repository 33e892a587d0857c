"""The catalogue of elevation sources: reading, defaults, validation, level plans, tile plans and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import geo
from ..operators.dem import GRID

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
FIELDS = {"id": S, "api_name": S, "path": S, "priority": L, "native_res": D, "crs": S, "bbox": T.ArrayType(D), "nodata": S, "finest_level": I, "resampling": S, "footprint": S, "fill_nodata_md": I, "rebuild_vrt": B}
RAW = T.StructType([T.StructField(k, v) for k, v in FIELDS.items()])


def read_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Raw rows of a catalogue document; unknown keys are ignored, ``nodata`` may be a number or the word declared."""
    import yaml

    doc = yaml.safe_load(text)
    rows = [[float(v) if f.name == "native_res" and v is not None else [float(x) for x in v] if f.name == "bbox" and v is not None else str(v) if f.name in ("nodata", "id") and v is not None else v for f in RAW for v in [s.get(f.name)]] for s in doc["sources"]]
    return spark.createDataFrame(rows, RAW)


def resolved(raw: DataFrame, defaults: dict) -> DataFrame:
    """With defaults filled in and the two forms of nodata as two columns; no order is implied."""
    out = raw.select(*(F.coalesce(F.col(f.name), F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else F.col(f.name) for f in RAW))
    b = lambda i: F.element_at("bbox", i)
    return out.select("*", F.expr("try_cast(nodata AS DOUBLE)").alias("nodata_value"), F.coalesce(F.col("nodata") == "declared", F.lit(True)).alias("nodata_declared"), b(1).alias("lon0"), b(2).alias("lat0"), b(3).alias("lon1"), b(4).alias("lat1"))


def violations(sources: DataFrame) -> DataFrame:
    """(id, rule): duplicate id, duplicate priority, degenerate bbox, a level finer than the data."""
    upsamples = geo.ground_res(F.col("finest_level"), geo.num(49)) < F.col("native_res") * 0.75
    flat = (F.col("lon0") >= F.col("lon1")) | (F.col("lat0") >= F.col("lat1"))
    same = lambda c: F.count(F.lit(1)).over(W.partitionBy(c)) > 1
    marks = {"duplicate id": same("id"), "duplicate priority": same("priority"), "degenerate bbox": flat, "upsampling": upsamples}
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in marks.items())), lambda x: x.isNotNull())
    return sources.withColumn("__found", found).select("id", "priority", F.explode("__found").alias("rule"))


def find(sources: DataFrame, source_id: str) -> DataFrame:
    """The source of an id; raises when the row is asked for and there is none."""
    one = sources.filter(F.col("id") == source_id)
    count = one.agg(F.count(F.lit(1)).alias("__n"))
    checked = F.when(F.col("__n") > 0, F.col("id")).otherwise(F.raise_error(F.lit(f"no source {source_id}")))
    return count.join(one, F.lit(True), "left").withColumn("id", checked).select(*sources.columns)


def index_plan(layers: DataFrame, root: str, coarsest: int = GRID.coarsest, finest: int = GRID.finest) -> DataFrame:
    """(level, source_id, priority, ovr, dir): a source serves every level up to its finest; ovr -1 is the base image."""
    levels = layers.withColumn("level", F.explode(F.sequence(F.lit(coarsest), F.least("finest_level", F.lit(finest)))))
    return levels.select("level", "source_id", "priority", (F.col("finest_level") - F.col("level") - 1).alias("ovr"), F.concat(F.lit(f"{root}/norm/"), "source_id", F.lit("/"), F.col("finest_level").cast("string")).alias("dir"))


def elevation_sources(sources: DataFrame) -> DataFrame:
    """One row: the list of sources, first wins, as one text."""
    n = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    line = F.concat_ws(":", "api_name", "path", F.array_join(F.transform("bbox", n), ","))
    return sources.agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), line.alias("l")))).alias("a")).select(F.array_join(F.transform("a", lambda x: x["l"]), ";\n").alias("elevation_sources"))


def cover(boxes: DataFrame, grid: geo.Grid = GRID) -> DataFrame:
    """Boxes (lon0, lat0, lon1, lat1) with one row for every tile (tx, ty) they touch; latitudes end at the projection's."""
    lo, hi = F.greatest("lat0", geo.num(-geo.LIMIT_LATITUDE)), F.least("lat1", geo.num(geo.LIMIT_LATITUDE))
    n, span = grid.across, grid.span
    at = lambda v: geo.snap(v / span, 9)
    first = lambda v: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(at(v)))).cast("int")
    last = lambda v: F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(at(v)))).cast("int")
    out = boxes.filter(lo < hi)
    x0, x1 = geo.merc_x(F.col("lon0")) + geo.ORIGIN, geo.merc_x(F.col("lon1")) + geo.ORIGIN
    y0, y1 = geo.num(geo.ORIGIN) - geo.merc_y(hi), geo.num(geo.ORIGIN) - geo.merc_y(lo)
    out = out.withColumns({"__a": first(x0), "__b": last(x1), "__c": first(y0), "__d": last(y1)}).filter("__b > __a AND __d > __c")
    out = out.withColumn("tx", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1))).withColumn("ty", F.explode(F.sequence(F.col("__c"), F.col("__d") - 1)))
    return out.drop("__a", "__b", "__c", "__d")


def touching(tiles: DataFrame, footprints: DataFrame, grid: geo.Grid = GRID) -> DataFrame:
    """Tiles that some footprint rectangle of their source touches; sources without footprints keep all their tiles.

    Rectangles are exploded to the tiles they touch, so the semi-join is on equal keys.
    """
    hit = cover(footprints, grid).select("source_id", "tx", "ty").distinct()
    have = footprints.select("source_id").distinct()
    return tiles.join(hit, ["source_id", "tx", "ty"], "left_semi").unionByName(tiles.join(have, "source_id", "left_anti"))


def unbuilt(tiles: DataFrame, built: DataFrame) -> DataFrame:
    """Planned tiles without a built one at the levels that count."""
    return tiles.join(built.filter(F.col("level").isin(14, 12)).select("source_id", "tx", "ty"), ["source_id", "tx", "ty"], "left_anti")


def build_environment(tiles: DataFrame, root: str, grid: geo.Grid = GRID) -> DataFrame:
    """(id, tx, ty, env): the variables of one tile's build, one a line.  ``tiles``: resolved sources with tx, ty."""
    e = geo.tile_extent(grid, F.col("tx"), F.col("ty"))
    s, q = (lambda c: c.cast("string")), geo.shell_quote
    path = F.when(F.coalesce("rebuild_vrt", F.lit(False)), F.concat(F.lit(f"{root}/vrt/"), "id", F.lit(".vrt"))).otherwise(F.col("path"))
    where = F.concat(F.lit("/norm/"), "id", F.lit("/"), s(F.col("finest_level")))
    lines = {  # fixed values: the names of the variables
        "SRC_ID": F.col("id"), "SRC_PATH": q(path), "LEVEL": s(F.col("finest_level")), "TX": s(F.col("tx")), "TY": s(F.col("ty")), "PX": s(geo.tile_px_at(grid, F.col("finest_level"))), "BLOCK": F.lit(str(grid.block_px)),
        "OVERVIEW_COUNT": s(F.col("finest_level") - grid.coarsest), "TE": F.format_string('"%.6f %.6f %.6f %.6f"', e["x0"], e["y0"], e["x1"], e["y1"]), "RESAMPLING": F.col("resampling"),
        "SRCNODATA": F.coalesce(F.when(F.col("nodata_declared"), "").otherwise(geo.nodata_text(F.col("nodata_value"))), F.lit("")), "WARP_NODATA": F.lit("-9999"), "SCALE": F.lit('"-500 6053.5 0 65535"'), "FILL_NODATA_MD": F.coalesce(s(F.col("fill_nodata_md")), F.lit("")),
        "DST_DIR": F.concat(q(F.lit(root)), where), "DST": F.concat(F.lit(root), where, F.lit("/"), s(F.col("tx")), F.lit("_"), s(F.col("ty")), F.lit(".tif")),
    }
    return tiles.select("id", "tx", "ty", F.concat(*(F.concat(F.lit(k + "="), v, F.lit("\n")) for k, v in lines.items())).alias("env"))


def split_csv(line: Column) -> Column:
    """Fields of one CSV line: commas outside quotes part them; quotes may begin and end anywhere in a field, a doubled one inside is a quote, an open one ends
    with the line."""
    closed = F.when((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1, F.concat(line, F.lit('"'))).otherwise(line)
    fields = F.regexp_extract_all(F.concat(closed, F.lit(",")), F.lit(r'((?:[^",]++|"[^"]*+")*+),'), F.lit(1))

    def bare(field: Column) -> Column:  # between quotes, every other part is inside; an empty one between two of these was a doubled quote
        parts = F.split(field, '"')
        return F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 0) & (p == "") & (i > 0) & (i < F.size(parts) - 1), F.lit('"')).otherwise(p)), "")

    return F.transform(fields, bare)


def parse_bbox(text: Column) -> Column:
    """Four numbers separated by commas, else null."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), parts)


# --- tiles and level indexes ----------------------------------------------------------------------------------------------


def tiles_of(paths: DataFrame, path: str = "location") -> DataFrame:
    """Rows whose ``path`` is .../norm/<source>/<level>/<tx>_<ty>.tif, with source_id, built_level, tx, ty; others, half-written ones too, go."""
    part = lambda i: F.regexp_extract(path, r"/norm/([^/]+)/([0-9]+)/([0-9]+)_([0-9]+)\.tif$", i)
    named = paths.select("*", part(1).alias("source_id"), *(part(i).try_cast("int").alias(c) for i, c in ((2, "built_level"), (3, "tx"), (4, "ty"))))
    return named.filter("source_id <> ''")


def scan_tiles(spark: SparkSession, root: str) -> DataFrame:
    """(location, bytes, source_id, built_level, tx, ty) of the tile files below a root: a listing, no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif").load(f"{root}/norm")
    return tiles_of(files.select(F.col("path").alias("location"), F.col("length").alias("bytes")))


def with_priority(tiles: DataFrame, layers: DataFrame) -> DataFrame:
    """Tiles with the priority of their source; tiles of unknown sources go."""
    return tiles.join(layers.select("source_id", "priority"), "source_id")


def level_index(tiles: DataFrame, layers: DataFrame) -> DataFrame:
    """(level, source_id, priority, ovr, tx, ty, location): every level's bag of all sources' tiles, each with the overview that serves the level."""
    plan = index_plan(layers, "").select("level", "source_id", "priority", "ovr")
    return tiles.join(plan, "source_id").select("level", "source_id", "priority", "ovr", "tx", "ty", "location")


def write_index(index: DataFrame, path: str) -> None:
    """One partition a level; levels that ``index`` holds replace what was there, others stay."""
    index.write.partitionBy("level").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def only(sources: DataFrame, ids: str | None) -> DataFrame:
    """Sources of a comma-separated list of ids; without a list all."""
    return sources if ids is None else sources.filter(F.col("id").isin(ids.split(",")))


def levels(spark: SparkSession, grid: geo.Grid = GRID) -> DataFrame:
    """(level, px, res), the finest level first."""
    z = F.col("level")
    out = spark.range(grid.coarsest, grid.finest + 1).select(F.col("id").cast("int").alias("level"))
    return out.select("level", geo.tile_px_at(grid, z).alias("px"), geo.level_res(z).alias("res")).orderBy(F.desc("level"))


def build_order(sources: DataFrame, order: list[str]) -> DataFrame:
    """Sources with ``turn``, from 1: those of the list first, in its order, then the rest by priority (highest first) and id.

    A row per source, so one window over all of them is small.
    """
    place = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("id")), F.lit(0))
    return sources.withColumn("turn", F.row_number().over(W.orderBy(place.asc_nulls_last(), F.desc("priority"), "id")))


def cheapest(steps: DataFrame, most: int) -> DataFrame:
    """The quickest build steps (step, seconds), ties by name."""
    return steps.orderBy("seconds", "step").limit(most)


def latest(steps: DataFrame, most: int = 5) -> DataFrame:
    """The build steps (step, finished) that ended last, ties by name."""
    return steps.orderBy(F.desc("finished"), "step").limit(most)
