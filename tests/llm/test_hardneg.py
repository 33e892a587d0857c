"""Hard negatives against brute force and their SQL."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeway.llm import hardneg, queries

SCHEMA = "id long, label int, vec array<double>, score long, w int, hi long"


def plain(rows, scale, positives=5, k=10, low=30, high=90):
    best = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, [2**60])), (label, [int(np.floor(scale * x)) for x in v]))
    out = set()
    for a, (label, v) in best.items():
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in best.items() if i != a and len(w) == len(v)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            fit = [i for i in order if best[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out |= {(a, p, r, i, scores[p], scores[i]) for r, i in enumerate(fit[:k], 1)}
    return out


def table(seed):
    rng = random.Random(seed)
    near = [rng.gauss(0, 1) for _ in range(20)]
    rows = []
    for i in range(-100, 600):
        v = [rng.gauss(0, 1) for _ in range(20)] if i % 3 else [x + rng.gauss(0, 0.4) for x in near]
        rows.append((i, rng.randrange(3) if i % 11 else 7, v))
    rows += [(1000 + i, 1, rows[150][2]) for i in range(30)]  # repeated vectors, ties
    rows += [(700, 1, [0.0] * 20), (701, 2, [0.0] * 20), (800, 2, [-x for x in near]), (900, 5, near), (100, 0, near), (100, 0, near), (50, 2, near)]
    rows += [(2000 + i, i % 2, [float(i % 5), 1.0, -2.0]) for i in range(0, 40)]
    rows += [(None, 1, near), (3000, None, near), (3001, 1, None), (3002, 1, []), (3003, 1, [None] * 20), (3004, 1, [float("nan")] * 20), (3005, 1, [float("inf")] * 20), (3006, 1, near[:-1] + [None])]
    return rows


@pytest.mark.parametrize("shard, block, rounds", [(2048, 256, None), (50, 3, None), (97, 2, (0.05, 0.1, 1.0))])
def test_equal_brute_force(spark, monkeypatch, shard, block, rounds):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", block)
    if rounds:
        monkeypatch.setattr(hardneg, "NEGATIVE_ROUNDS", rounds)
        monkeypatch.setattr(hardneg, "POSITIVE_ROUNDS", (0.9, None))
    rows = table(shard)
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA).repartition(3)
    docs = docs.filter(hardneg.usable(F.col("vec"))).withColumn("vec", hardneg.whole(F.col("vec"), 64))
    got = [tuple(r) for r in hardneg.hard_negatives(docs, F.col("id") % 100 == 0).collect()]
    want = plain(rows, 64)
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
    assert hardneg.hard_negatives(docs.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hardneg.hard_negatives(docs, F.col("id") == 7_777).count() == 0


def test_the_index_loses_no_pair_and_drops_most():
    rng = np.random.default_rng(6)
    q, v = rng.integers(-90, 90, (20, 64)), rng.integers(-90, 90, (900, 64)) * np.linspace(0.2, 2, 64).astype(int)
    v[::7] = 0
    q[3] = 0
    full = q @ v.T
    for share in (0.9, 0.6, 0.3, 0.0, -0.5):
        low = share * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
        a, x = hardneg.reaching(q, v, low)
        got = np.zeros(full.shape, bool)
        got[a, x] = True
        assert got[full >= low[:, None]].all()
        if share >= 0.6:
            assert got.sum() <= (full >= low[:, None]).sum() + 900
    a, x = hardneg.reaching(q, v, np.full(20, -np.inf))
    assert len(a) == full.size


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op12_hard_negatives(spark, folder).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == set(duckdb.sql(queries.OP12_SQL).fetchall()) and got


def test_shards_that_follow_give_one_window(monkeypatch):
    """A block that meets several shards in a task returns each window's best few of all of them, not of each."""
    rng = np.random.default_rng(5)
    item = lambda i, n: [{"id": int(j), "label": int(j) % 2, "vec": rng.integers(-99, 99, 8).tolist()} for j in range(i, i + n)]
    block = [x | {"windows": [{"w": 0, "lo": hardneg._LEAST, "hi": hardneg._MOST}, {"w": 1, "lo": -20000, "hi": 5000}]} for x in item(0, 4)]
    shards = [item(100 * s, 60) for s in range(1, 6)]
    vector = pa.list_(pa.int64())
    one = [("id", pa.int64()), ("label", pa.int64()), ("vec", vector)]
    windows = pa.list_(pa.struct([("w", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))
    columns = [pa.array([block] * 5, pa.list_(pa.struct([*one, ("windows", windows)]))), pa.array(shards, pa.list_(pa.struct(one)))]
    batches = [pa.RecordBatch.from_arrays([c.slice(i, 1) for c in columns], names=["block", "shard"]) for i in range(5)]
    got = [r for b in hardneg._mine(iter(batches), False, 3) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = []
    for a in block:
        rows = sorted((-int(np.dot(a["vec"], x["vec"])), x["id"]) for s in shards for x in s if x["label"] != a["label"])
        for w in a["windows"]:
            want += [(a["id"], w["w"], i, -s) for s, i in [r for r in rows if w["lo"] <= -r[0] <= w["hi"]][:3]]
    assert sorted(got) == sorted(want)
