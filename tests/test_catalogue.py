"""Catalogue, checks, requests, queue."""

import random

import pandas as pd
from pyspark.sql import functions as F

from ridgeway.operators import qa, requests
from ridgeway.sources import catalogue, peakstore
from ridgeway.streaming import queue


def test_yaml_defaults_and_violations(spark):
    text = """
sources:
  - {id: a, api_name: A, path: /a.tif, priority: 10, native_res: 1, crs: "EPSG:1", bbox: [1, 2, 3, 4], nodata: -9999, note: x}
  - {id: a, api_name: B, path: /b.tif, priority: 10, native_res: 1, crs: "EPSG:1", bbox: [1, 2, 1, 4], nodata: declared, finest_level: 14}
"""
    import pytest

    pytest.importorskip("yaml")
    r = catalogue.resolved(catalogue.read_yaml(spark, text), {"finest_level": 12, "resampling": "average"})
    rows = {x["api_name"]: x for x in r.collect()}
    assert rows["A"]["finest_level"] == 12 and rows["A"]["nodata_value"] == -9999 and not rows["A"]["nodata_declared"] and rows["B"]["nodata_declared"]
    rules = sorted(x["rule"] for x in catalogue.violations(r).collect())
    assert rules == ["degenerate bbox", "duplicate id", "duplicate id", "duplicate priority", "duplicate priority"]


def test_csv_fields(spark):
    lines = ["a,b,c", '1,"x, ""y""",', '"",,"z"']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i")
    assert [r[0] for r in df.select(catalogue.split_csv(F.col("line"))).collect()] == [["a", "b", "c"], ["1", 'x, "y"', ""], ["", "", "z"]]


def test_csv_quotes_anywhere(spark):
    def plain(line):
        out, cur, quoted, i = [], "", False, 0
        while i < len(line):
            c = line[i]
            if c == '"' and quoted and line[i + 1 : i + 2] == '"':
                cur, i = cur + c, i + 1
            elif c == '"':
                quoted = not quoted
            elif c == "," and not quoted:
                out, cur = [*out, cur], ""
            else:
                cur += c
            i += 1
        return [*out, cur]

    rng = random.Random(4)
    lines = ["", '"', '""', '"""', '""""', 'a"b,c"d', 'a""b', '"a,b', "x" * 50_000 + ',"' + "y,," * 20_000, *("".join(rng.choice('a",') for _ in range(rng.randrange(12))) for _ in range(500))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i")
    assert [r[0] for r in df.select(catalogue.split_csv(F.col("line"))).collect()] == [plain(x) for x in lines]


def test_peaks_from_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('X,Y,osm_id,name,type,ele\n20.5,49.1,7,"Kozi, ""old""",peak,2291\n20.6,49.2,x,Bad id,peak,\nnan?,1,2,3,4,5\n20,49,1,short,peak\n25,49.1,9,Far,peak,1\n\n')
    got = [tuple(r) for r in peakstore.read_csv(spark, f"{tmp_path}/p.csv").orderBy("plon").collect()]
    assert got == [(7, 'Kozi, "old"', "peak", "2291", 20.5, 49.1), (0, "Bad id", "peak", None, 20.6, 49.2), (9, "Far", "peak", "1", 25.0, 49.1)]
    peakstore.write(peakstore.read_csv(spark, f"{tmp_path}/p.csv"), f"{tmp_path}/store")
    view = spark.createDataFrame([(20.5, 49.1)], "lon double, lat double")
    assert {r["osm_id"] for r in peakstore.near(spark, f"{tmp_path}/store", view, 1000.0).collect()} == {7, 0}  # and what lies in the next square


def test_rebuilt_descriptors_read_back(spark, tmp_path):
    one = '<VRTDataset><SRS>LOCAL["a &amp; b"]</SRS><GeoTransform>0.1, 1e-7, 0, -3.25, 0, -1e-7</GeoTransform><VRTRasterBand><SimpleSource><SourceFilename relativeToVRT="1">a&amp;b.tif</SourceFilename><DstRect xOff="0.5" yOff="2" xSize="3" ySize="4.25"/></SimpleSource><SimpleSource><SourceFilename relativeToVRT="0">/far/c.tif</SourceFilename></SimpleSource></VRTRasterBand></VRTDataset>'
    none = "<VRTDataset><GeoTransform>0, 1, 0, 0, 0, -1</GeoTransform><VRTRasterBand></VRTRasterBand></VRTDataset>"
    old = qa.parse_descriptors(spark.createDataFrame([("/v/one.vrt", one), ("/v/none.vrt", none)], "file string, xml string"))
    for _ in range(2):  # a second time replaces
        qa.write_descriptors(qa.rebuilt(old), f"{tmp_path}/vrt")
    new = qa.read_descriptors(spark, f"{tmp_path}/vrt/*")
    got = {r["file"].split("id=")[1].split("/")[0]: r for r in new.collect()}
    was = {r["file"].split("/")[-1].split(".")[0]: r for r in old.collect()}
    assert got.keys() == was.keys() == {"one", "none"}
    for k in was:
        assert got[k]["nodata"] == -9999 and was[k]["nodata"] is None and got[k]["gt"] == was[k]["gt"] and got[k]["srs"] == was[k]["srs"]
        assert [s["DstRect"] for s in got[k]["sources"]] == [s["DstRect"] for s in was[k]["sources"]]
    assert [s["SourceFilename"]["_VALUE"] for s in got["one"]["sources"]] == ["/v/a&b.tif", "/far/c.tif"]
    assert [r["leaf"] for r in qa.leaf_files(new).orderBy("leaf").collect()] == ["/far/c.tif", "/v/a&b.tif"]


def test_bbox_text(spark):
    df = spark.createDataFrame([("1, 2,3 ,4",), ("1,2,3",), ("1,2,x,4",)], "s string")
    assert [r[0] for r in df.select(catalogue.parse_bbox(F.col("s"))).collect()] == [[1.0, 2.0, 3.0, 4.0], None, None]


def test_polar_boxes_have_no_tiles(spark):
    df = spark.createDataFrame([(0.0, 86.0, 10.0, 89.0), (-180.0, -90.0, 180.0, 90.0)], "lon0 double, lat0 double, lon1 double, lat1 double")
    assert catalogue.cover(df).groupBy("lat0").count().collect()[0]["count"] == 128 * 128


def test_descriptor_without_transform_fails(spark):
    import pytest

    df = spark.createDataFrame([("/v", "<VRTDataset><SRS>x</SRS></VRTDataset>")], "file string, xml string")
    with pytest.raises(Exception, match="no GeoTransform"):
        qa.parse_descriptors(df).collect()


def test_request_errors(spark):
    df = spark.createDataFrame([(1, 20.0, 49.0, 0.0, 200.0), (2, 20.0, float("inf"), 0.1, 360.0), (3, 20.0, 49.0, 0.1, 0.0)], "id int, lon double, lat double, step double, fov double")
    rows = {r["id"]: r for r in requests.panorama(df).collect()}
    assert rows[1]["step"] == 0.02 and rows[1]["status"] == 200 and rows[2]["status"] == 400 and rows[3]["fov"] == 0.1


def test_queue_order_and_capacity(spark):
    rows = [(0, 0, 0, 0, 100.0, False)] + [(0, k, k * 1_000_000, 50 if k == 5 else 0, 1.0, False) for k in range(1, 14)] + [(0, 99, 500_000, 0, 1.0, True)]
    df = spark.createDataFrame(rows, "queue_id long, seq long, arrival long, priority int, service double, abandoned boolean")
    got = {r["seq"]: r for r in queue.schedule(df).collect()}
    assert got[99]["outcome"] == "abandoned" and [s for s in got if got[s]["outcome"] == "rejected"] == [11, 12, 13]
    served = sorted((s for s in got if got[s]["outcome"] == "served"), key=lambda s: got[s]["start"])
    assert served[:4] == [0, 5, 1, 2] and got[5]["start"] == 100.0


def test_queue_resumes_from_state():
    first = pd.DataFrame({"queue_id": 0, "seq": [0, 1, 2], "arrival": [0, 1_000_000, 2_000_000], "priority": [0, 0, 9], "service": [10.0, 1.0, 1.0], "abandoned": False})
    later = pd.DataFrame({"queue_id": 0, "seq": [3], "arrival": [50_000_000], "priority": [0], "service": [1.0], "abandoned": False})
    whole = queue._replay(queue.Slot(), 0, pd.concat([first, later]), True)
    slot = queue.Slot()
    parts = pd.concat([queue._replay(slot, 0, first, False), queue._replay(slot, 0, later, True)])
    assert whole.sort_values("seq").values.tolist() == parts.sort_values("seq").values.tolist()


def test_admission_bucket(spark):
    rows = [(1, k, k * 100_000) for k in range(20)]
    got = queue.admission(spark.createDataFrame(rows, "client long, seq long, arrival long")).orderBy("seq").collect()
    assert [r["admitted"] for r in got] == [True] * 11 + [False] * 9


def test_index_follows_tiles_that_are_built_again(spark, tmp_path):
    layers = spark.createDataFrame([("a", 20, 14), ("b", 10, 12)], "source_id string, priority int, finest_level int")
    paths = lambda *names: spark.createDataFrame([(f"{n}.tif",) for n in names], "location string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda ck="ck": queue.reindex(spark, f"{tmp_path}/in", layers, f"{tmp_path}/out", f"{tmp_path}/{ck}").awaitTermination()
    have = lambda: {(r["level"], r["source_id"], r["tx"], r["ty"], r["location"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    paths("/v1/norm/a/14/1_2", "/v1/norm/a/14/1_3.tmp", "/v1/norm/b/12/7_7")
    run()
    first = have()
    assert first == {(z, "a", 1, 2, "/v1/norm/a/14/1_2.tif") for z in range(8, 15)} | {(z, "b", 7, 7, "/v1/norm/b/12/7_7.tif") for z in range(8, 13)}
    paths("/v2/norm/a/14/1_2", "/v2/norm/a/14/5_5", "/v2/norm/x/14/5_5")
    run()  # the stream goes on where it was
    second = {r for r in first if r[1] == "b"} | {(z, "a", *t) for z in range(8, 15) for t in ((1, 2, "/v2/norm/a/14/1_2.tif"), (5, 5, "/v2/norm/a/14/5_5.tif"))}
    assert have() == second and spark.read.parquet(f"{tmp_path}/out").count() == len(second)
    run("lost")  # all batches once more, from a lost checkpoint
    assert have() == second and spark.read.parquet(f"{tmp_path}/out").count() == len(second)


def test_tile_files_make_a_level_index(spark, tmp_path):
    for name in ("a/14/1_2.tif", "a/14/1_3.tmp.tif", "b/12/1_2.tif", "b/12/notes.txt", "c/12/9_9.tif"):
        f = tmp_path / "norm" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"xyz")
    tiles = catalogue.scan_tiles(spark, str(tmp_path))
    assert {(r["source_id"], r["built_level"], r["tx"], r["ty"], r["bytes"]) for r in tiles.collect()} == {("a", 14, 1, 2, 3), ("b", 12, 1, 2, 3), ("c", 12, 9, 9, 3)}
    layers = spark.createDataFrame([("a", 20, 14), ("b", 10, 12)], "source_id string, priority int, finest_level int")
    catalogue.write_index(catalogue.level_index(tiles, layers), f"{tmp_path}/index")
    catalogue.write_index(catalogue.level_index(tiles, layers).filter("level = 12 AND source_id = 'b'"), f"{tmp_path}/index")
    got = spark.read.parquet(f"{tmp_path}/index").select("level", "source_id", "ovr").collect()
    want = {(z, "a", 13 - z) for z in range(8, 15)} | {(z, "b", 11 - z) for z in range(8, 13)}
    assert {tuple(r) for r in got} == want - {(12, "a", 1)} and len(got) == len(want) - 1


def test_levels_come_finest_first(spark):
    rows = catalogue.levels(spark).collect()
    assert [r["level"] for r in rows] == list(range(14, 7, -1)) and rows[0]["px"] == 32768 and rows[-1]["px"] == 512


def test_lookup_of_an_unknown_source_fails(spark):
    import pytest

    df = spark.createDataFrame([("a", 1)], "id string, priority long")
    assert catalogue.find(df, "a").first()["priority"] == 1
    with pytest.raises(Exception, match="no source z"):
        catalogue.find(df, "z").collect()


def test_footprints_are_written(spark, tmp_path):
    xml = '<VRTDataset><SRS>EPSG:3857</SRS><GeoTransform>0, 10, 0, 1000, 0, -10</GeoTransform><VRTRasterBand><SimpleSource><SourceFilename relativeToVRT="0">/x</SourceFilename><DstRect xOff="0" yOff="0" xSize="100" ySize="50"/></SimpleSource></VRTRasterBand></VRTDataset>'
    d = qa.parse_descriptors(spark.createDataFrame([("/v/one.vrt", xml)], "file string, xml string"))
    qa.write_footprints(qa.footprint_parts(d), qa.footprint_summary(d), f"{tmp_path}/f")
    assert spark.read.option("header", True).csv(f"{tmp_path}/f/parts").first()["wkt"] == "POLYGON ((0.0000 1000.0000,1000.0000 1000.0000,1000.0000 500.0000,0.0000 500.0000,0.0000 1000.0000))"
    assert spark.read.json(f"{tmp_path}/f/summary").first()["area_km2"] == 0.5


def test_check_tally_and_metadata(spark):
    t = qa.tally(spark.createDataFrame([("ok",), ("FAIL",), ("ok",)], "status string")).first()
    assert (t["ok"], t["problems"]) == (2, 1)
    m = requests.metadata(spark.createDataFrame([(1, 5, 0.5)], "view long, samples int, sky double"), "samples", "sky").first()
    assert m["meta"] == '{"samples":5,"sky":0.5}'


def test_queue_over_a_stream(spark, tmp_path):
    """Batches through state come out as one replay does, but for those that still wait."""
    schema = "queue_id long, seq long, arrival long, priority int, service double, abandoned boolean"
    rows = [(q, 10 * q + k, (3 * k + q) * 1_000_000, k % 3, 7.0, k % 4 == 3) for q in range(2) for k in range(8)]
    whole = {r["seq"]: tuple(r) for r in queue.schedule(spark.createDataFrame(rows, schema)).collect()}
    for i, part in enumerate((rows[:4] + rows[8:12], rows[4:8] + rows[12:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    import glob
    import os

    for k, f in enumerate(sorted(glob.glob(f"{tmp_path}/in/*/*.parquet"))):
        os.utime(f, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    queue.schedule_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r["seq"]: tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got and all(whole[k] == v for k, v in got.items()) and len(got) < len(whole)
