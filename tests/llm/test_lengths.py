"""Vectors of several lengths, exact search, and long runs of bad bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.llm import ann, spm


@pytest.mark.parametrize("exact, blocks", [(False, None), (True, None), (True, 40)])
def test_each_length_is_searched_by_itself(spark, monkeypatch, exact, blocks):
    """Against brute force; with small blocks lists and queries are cut."""
    if blocks:
        monkeypatch.setattr(ann, "LIST_BLOCK", blocks)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8 if i % 4 else 3).tolist()) for i in range(400)] + [(1000, [1.0, 2.0]), (1010, [2.0, 1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(table, F.col("id") % 10 == 0, 4, exact=exact, most_lists=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = total = 0
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q, v in rows:
        if q % 10 == 0:
            near = sorted(((-float(unit(v) @ unit(w)), i) for i, w in rows if i != q and len(w) == len(v)))[:4]
            mine = sorted(got.get(q, []))
            assert [m[0] for m in mine] == list(range(1, len(near) + 1))
            found, total = found + len({i for _, i in near} & {m[1] for m in mine}), total + len(near)
            if exact:
                assert [m[1] for m in mine] == [i for _, i in near] and np.allclose([m[2] for m in mine], [-s for s, _ in near], atol=1e-14)
    assert found >= 0.9 * total and 1000 not in got and 1010 not in got


def test_long_runs_of_bad_bytes():
    run = b"\xff\xe2\x82" * 5000 + "é".encode() + b"\xc3"
    got = spm.decode_bytes(run)
    assert got == "�" * 15000 + "é�"
