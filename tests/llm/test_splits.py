"""Operators with their bounds patched down, so that small tables cross many buckets, blocks and parts."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridgeway.llm import graph, mixing, supermin, warc

sys.path.insert(0, str(Path(__file__).parent))
import models  # noqa: E402


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("bucket_rows, percent", [(1, 150), (7, 60), (60, 60)])
def test_mix_over_many_buckets(spark, monkeypatch, bucket_rows, percent):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(bucket_rows)
    docs = documents(spark, [(i, "w # " * rng.randrange(3) + "w " * rng.choice([0, 1, 5, 40, 900 if i % 50 == 0 else 7]), rng.choice("aaaaab") if i % 9 else None) for i in range(400)])
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), (-F.log(u) / mixing.quality(F.col("text"))).alias("key")).collect()
    got = mixing.mix(docs, share_percent=percent).collect()
    targets = {r["source"]: r["target"] for r in got}
    assert {r["doc_id"]: r["repeats"] for r in got} == models.mix_repeats([tuple(r) for r in keyed], targets)
    whole = percent // 100
    assert {whole, whole + 1} <= {r["repeats"] for r in got if r["source"] == "a"}  # the cut falls among them


@pytest.mark.parametrize("block", [1, 3])
def test_crowded_buckets_in_small_blocks(spark, monkeypatch, block):
    """Documents that share most of their words but fall into several groups, and many chains of edits."""
    monkeypatch.setattr(supermin, "BLOCK", block)
    rng = random.Random(block)
    rows, base = [], [f"b{i}" for i in range(60)]
    for k in range(70):
        own = list(base)
        for at in range(k % 14):
            own[(4 * at + k // 14) % 60] = f"o{k % 14}x{at}"
        if k % 5 == 0:
            own[rng.randrange(60)] = f"e{k}"
        rows.append((1000 - k, " ".join(own), "a"))
    want = models.groups({i: t for i, t, _ in rows}, 4)
    assert 1 < len(set(want.values())) < len(rows)
    got = {r["doc_id"]: r["component_id"] for r in supermin.near_duplicates(documents(spark, rows), 4).collect()}
    assert got == want


def test_components_in_many_small_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_PART", 3)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 90) if i % 30 != 29] + [(200, 200 + rng.randrange(1, 40)) for _ in range(60)]
    rng.shuffle(edges)
    root = {v: v for e in edges for v in e}
    for _ in root:  # the plain way: lower both ends until nothing changes
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {v: r for v, r in root.items() if v != r}


def test_a_payload_of_many_records_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART_ROWS", 2)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(60)], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").agg(F.max("parts")).first()[0] == 20
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_index(spark, f"{tmp_path}/a").collect()}
    assert got == {i: ("response", None, len(f"own {i}")) if i % 3 == 0 else ("response", None, 4) if i == 59 else ("revisit", 59, 4) for i in range(60)}
