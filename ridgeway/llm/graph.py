"""Connected components of an edge table, by alternating stars over DataFrames.

Edges never reach the driver.  Each task first runs union-find over the edges it holds and passes on a
spanning forest, so a dense group shrinks before the first shuffle; then large-star and small-star steps
(each one partial aggregation and one join that adaptive execution can split) run until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


EDGES_A_PART = 100_000


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (u, v) of one task: (smallest vertex of its part, vertex), one row per vertex."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in parent if find(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounds memory; the star steps join the parts
            yield flush()
    yield flush()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex that is not its component's smallest; ``edges`` has long columns u and v.

    Null ends and self-loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    # written first: edges that Python makes and Python that takes them would hold two workers for each task
    edges = stored(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v"), "edges").mapInArrow(local_forest, "u bigint, v bigint")
    edges, before = stored(edges.distinct(), "forest"), None
    while (now := _state(edges)) != before:
        before, parts = now, 1 + now[0] // EDGES_A_PART  # few tasks for few edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        large = stored(large.coalesce(parts), "large-star")
        # now every edge is (smaller, larger); each vertex and its smaller neighbours hang on the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m")
        small = large.join(least, F.col("v") == F.col("k"))
        small = small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
        edges = stored(small.coalesce(parts), "small-star")
    return edges.select("v", F.col("u").alias("root"))
