"""Catalogue checks and footprints: mosaic descriptors (XML), header documents (JSON), drift notes, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

# fixed values: the elements and attributes of descriptors
RECT = "STRUCT<_xOff: DOUBLE, _yOff: DOUBLE, _xSize: DOUBLE, _ySize: DOUBLE>"
SOURCE = f"ARRAY<STRUCT<SourceFilename: STRUCT<_VALUE: STRING, _relativeToVRT: STRING>, DstRect: {RECT}>>"
DESCRIPTOR = f"SRS STRING, GeoTransform STRING, VRTRasterBand ARRAY<STRUCT<NoDataValue: STRING, ComplexSource: {SOURCE}, SimpleSource: {SOURCE}, AveragedSource: {SOURCE}>>"


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(file, srs, nodata, gt, sources): one row per descriptor, by Spark's XML reader."""
    rows = spark.read.format("xml").option("rowTag", "VRTDataset").schema(DESCRIPTOR).load(path).withColumn("file", F.col("_metadata.file_path"))
    return described(rows)


def parse_descriptors(texts: DataFrame, text: str = "xml") -> DataFrame:
    """The same of XML texts in a column; needs a column ``file``."""
    return described(texts.select("file", F.from_xml(F.col(text), f"{DESCRIPTOR}").alias("d")).select("file", "d.*"))


def described(rows: DataFrame) -> DataFrame:
    gt = F.transform(F.split(F.trim("GeoTransform"), r"\s*,\s*"), lambda x: x.try_cast("double"))
    kinds = ("ComplexSource", "SimpleSource", "AveragedSource")
    none = F.array().cast(SOURCE)
    sources = F.flatten(F.transform("VRTRasterBand", lambda b: F.concat(*(F.coalesce(b[k], none) for k in kinds))))
    good = (F.size(gt) == 6) & ~F.exists(gt, lambda x: x.isNull())
    nodata = F.get("VRTRasterBand", F.lit(0))["NoDataValue"].try_cast("double")
    return rows.select("file", F.col("SRS").alias("srs"), nodata.alias("nodata"), F.when(good, gt).otherwise(F.raise_error(F.lit("no GeoTransform")).cast("array<double>")).alias("gt"), F.coalesce(sources, none).alias("sources"))


def leaf_files(descriptors: DataFrame) -> DataFrame:
    """(file, leaf): referenced files, relative ones beside their descriptor."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    d = descriptors.select("file", F.explode("sources").alias("s"))
    name = F.trim("s.SourceFilename._VALUE")
    return d.select("file", F.when(F.col("s.SourceFilename._relativeToVRT") == "1", F.concat(folder, name)).otherwise(name).alias("leaf"))


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def rebuilt(descriptors: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """(file, xml): descriptors over the same leaf files, in the same places, that declare ``nodata``, so that uncovered canvas isn't 0.

    Leaf files are named by their whole paths; sources of all bands and kinds become complex sources of one band; the canvas reaches as far as they do.
    """
    folder, s = F.regexp_replace("file", "[^/]*$", ""), lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def element(one: Column) -> Column:
        name, rect = F.trim(one["SourceFilename"]["_VALUE"]), one["DstRect"]
        leaf = F.when(one["SourceFilename"]["_relativeToVRT"] == "1", F.concat(folder, name)).otherwise(name)
        place = F.concat(F.lit("<DstRect"), *(F.concat(F.lit(f' {k}="'), s(rect[f"_{k}"]), F.lit('"')) for k in ("xOff", "yOff", "xSize", "ySize")), F.lit("/>"))
        return F.concat(F.lit('<ComplexSource><SourceFilename relativeToVRT="0">'), _escaped(s(leaf)), F.lit("</SourceFilename><SourceBand>1</SourceBand>"), F.when(rect.isNull(), "").otherwise(place), F.lit("</ComplexSource>"))

    far = lambda off, size: s(F.coalesce(F.ceil(F.array_max(F.transform("sources", lambda x: x["DstRect"][off] + x["DstRect"][size]))), F.lit(0)))
    xml = F.concat(
        F.lit('<VRTDataset rasterXSize="'), far("_xOff", "_xSize"), F.lit('" rasterYSize="'), far("_yOff", "_ySize"), F.lit('">'), F.coalesce(F.concat(F.lit("<SRS>"), _escaped(F.col("srs")), F.lit("</SRS>")), F.lit("")),
        F.lit("<GeoTransform>"), F.array_join(F.col("gt").cast("array<string>"), ", "), F.lit('</GeoTransform><VRTRasterBand band="1"><NoDataValue>'), geo.nodata_text(geo.num(nodata)), F.lit("</NoDataValue>"),
        F.array_join(F.transform("sources", element), ""), F.lit("</VRTRasterBand></VRTDataset>"),
    )
    return descriptors.select("file", xml.alias("xml"))


def write_descriptors(texts: DataFrame, to: str) -> None:
    """Descriptors (file, xml) as one text each in ``to/id=...``, by the file's name without its ending; what is there of the same name is replaced, the rest stays."""
    name = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), "[.][^.]*$", "")
    texts.select(name.alias("id"), "xml").write.partitionBy("id").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(to)


def footprint_parts(descriptors: DataFrame) -> DataFrame:
    """(file, wkt, area_km2) of every referenced rectangle; long sides are cut where the pixel size says metres."""
    d = descriptors.select("file", "gt", F.explode("sources").alias("s")).filter("s.DstRect IS NOT NULL")
    gt = [F.element_at("gt", i) for i in range(1, 7)]
    rect = [F.col(f"s.DstRect.{k}") for k in ("_xOff", "_yOff", "_xSize", "_ySize")]
    metres = F.abs(gt[1]) > 0.01
    return d.select("file", geo.rect_wkt(gt, rect, metres).alias("wkt"), (geo.rect_area(gt, rect) / 1e6).alias("area_km2"))


def footprint_summary(descriptors: DataFrame) -> DataFrame:
    """(file, parts, sources, area_km2): rectangles aren't dissolved, so overlaps count twice."""
    counts = descriptors.select("file", F.size("sources").alias("sources"))
    parts = footprint_parts(descriptors).groupBy("file").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("area_km2"), 1).alias("area_km2"))
    return counts.join(parts, "file", "left").select("file", F.coalesce("parts", F.lit(0)).alias("parts"), "sources", F.coalesce("area_km2", geo.num(0)).alias("area_km2"))


def fill(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """A footprint summary (file, ...) with the area of each source's box (file, lon0, lat0, lon1, lat1) and how much of it, in %, is covered."""
    box = F.round(geo.bbox_area_km2(*(F.col(c) for c in ("lon0", "lat0", "lon1", "lat1"))), 1)
    boxes = sources.select(F.col("file").alias("__f"), box.alias("bbox_area_km2"))
    return summary.join(boxes, F.col("file") == F.col("__f")).drop("__f").withColumn("fill", 100 * F.try_divide("area_km2", "bbox_area_km2"))


def write_footprints(parts: DataFrame, summary: DataFrame, to: str) -> None:
    """``to/parts`` (CSV with a WKT column, a folder a file) and ``to/summary`` (JSON lines, one a file)."""
    name = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), "[.][^.]*$", "")
    parts.select(name.alias("id"), "wkt", "area_km2").write.partitionBy("id").option("header", True).csv(f"{to}/parts")
    summary.coalesce(1).write.json(f"{to}/summary")  # a row per source


def read_header(header: Column) -> dict[str, Column]:
    """The fields of a raster's JSON header that the checks use; each may be null."""
    doc = F.try_parse_json(header)
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    return {"res": get("$.geoTransform[1]", "double"), "wkt_name": F.nullif(F.split_part(get("$.coordinateSystem.wkt", "string"), F.lit('"'), F.lit(2)), F.lit("")), "declared": get("$.bands[0].noDataValue", "double"), "width": get("$.size[0]", "bigint"), "height": get("$.size[1]", "bigint")}


def drift(sources: DataFrame, headers: DataFrame) -> DataFrame:
    """(id, status, notes): each source against its file's header (id, header, epsg, proj4); missing headers fail.

    ``sources``: id, crs, proj4 as declared, native_res, nodata_value, nodata_declared.
    """
    h = read_header(F.col("header"))
    j = sources.join(headers.withColumnsRenamed({"id": "hid", "proj4": "found_proj4"}), F.col("id") == F.col("hid"), "left")
    metres = F.when(F.col("crs") == "EPSG:4326", h["res"] * 111320.0).otherwise(F.abs(h["res"]))
    same = geo.crs_matches(F.concat(F.lit("EPSG:"), F.col("epsg")), F.col("crs"), F.col("found_proj4"), F.col("proj4"))
    notes = F.array(
        F.when(h["res"].isNull(), "no geotransform").when(F.abs(metres - F.col("native_res")) > 0.05 * F.col("native_res"), F.concat(F.lit("resolution "), F.format_string("%.4f", metres))),
        F.when(~same, F.concat(F.lit("crs "), F.coalesce(h["wkt_name"], F.lit("?")))),
        F.when(F.col("nodata_declared") & h["declared"].isNull(), "nodata declared nowhere").when(~F.col("nodata_declared") & (F.abs(h["declared"] - F.col("nodata_value")) > 1e-6), "nodata differs"),
    )
    notes = F.when(F.col("header").isNull(), F.array(F.lit("missing"))).otherwise(F.filter(notes, lambda x: x.isNotNull()))
    out = j.withColumn("__notes", notes)
    return out.select("id", F.when(F.size("__notes") == 0, "ok").otherwise("FAIL").alias("status"), F.array_join("__notes", "; ").alias("notes"))


def tally(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("problems"))
