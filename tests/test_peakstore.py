"""Stored peaks are found by place."""

import re

from pyspark.sql import functions as F

from ridgeway.operators import march
from ridgeway.sources import peakstore


def test_near_peaks_are_all_there_and_far_ones_are_not_read(spark, tmp_path):
    k = F.col("id")
    peaks = spark.range(4000).select(k.alias("osm_id"), F.lit("p").alias("name"), (F.pmod(k * 7919, F.lit(36000)) / 100.0 - 180).alias("plon"), (F.pmod(k * 104729, F.lit(17000)) / 100.0 - 85).alias("plat"))
    lost = spark.sql("SELECT 9999L AS osm_id, 'q' AS name, CAST(NULL AS DOUBLE) AS plon, 10.0D AS plat")
    peakstore.write(peaks.unionByName(lost), f"{tmp_path}/peaks")
    views = spark.createDataFrame([(1, 20.0, 49.0, 300.0), (2, -179.95, -60.0, 10.0)], "view long, lon double, lat double, eye double")
    some = peakstore.near(spark, f"{tmp_path}/peaks", views, 300000.0)
    text = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in text and re.search(r"PartitionFilters: \[[^\]]*cell", text)
    assert set(some.columns) == set(peaks.columns) and 0 < some.count() < 400
    want, got = (sorted(map(tuple, march.peak_candidates(views, p, 300000.0).select("view", "osm_id", "distance").collect())) for p in (peaks, some))
    assert want == got and len(got) >= 3
    assert peakstore.near(spark, f"{tmp_path}/peaks", views.limit(0), 1000.0).count() == 0
