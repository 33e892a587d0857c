"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. A logistic model over shape measures of the whole text (fitted on at most ``SAMPLE`` labelled rows, chosen by a hash
   of the id) gives each document its log odds of good quality.
2. Labelled documents are counted per path and per host.  A host's rate is its count shrunk towards the global
   rate by a Beta prior whose strength comes from the spread between hosts (method of moments); a path's rate is
   shrunk towards its host's in the same way.  Sites with few or no labels so fall back on what stands above them.
3. The classifier's odds, freed of the global rate, multiply the path's odds.

All counts are grouped aggregations over all labelled rows; per document only its id, site and log odds are moved, never text.

Definitions.  A null host or path is a site of its own; a null or empty text has all measures 0.  Labels other than 0 and 1,
null labels and labels without a document are ignored; several labels of one doc_id all count.  A labelled document counts in
its own host's and path's rate.  A prior counts as at most ``MOST_STRENGTH`` documents, which is also its strength where rates
show no spread beyond chance.  ``documents`` has no addresses: the registered query takes source for host and lang for path.
Long texts are measured whole.  With no labels at all
every rate and score is 0.5.  Repeated rows are judged alike.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .rules import measure
from .store import small_batches, stored

SAMPLE = 20_000
FEATURES = 9
RIDGE = 1.0
MOST_STRENGTH = 1000.0


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """(row, FEATURES): bounded shape measures."""
    words = np.maximum(m["n_words"], 1)
    lines, chars = np.maximum(m["n_lines"], 1), np.maximum(m["word_chars"], 1)
    length = m["word_chars"] / words
    return np.stack(
        [
            np.log1p(m["n_words"]),
            np.minimum(length, 20),
            np.minimum(np.abs(length - 5), 10),
            np.minimum(m["n_symbols"] / words, 1),
            m["n_dup_lines"] / lines,
            m["n_repeat_words"] / words,
            m["n_upper"] / chars,
            (m["n_words"] < 10).astype(float),
            np.minimum(np.log1p(m["n_words"] / lines), 8),
        ],
        axis=1,
    )


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (mean, scale, weights with the intercept last)."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    w = np.zeros(FEATURES + 1)
    if len(x) and 0 < y.mean() < 1:
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (y - p) - RIDGE * w
            hess = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
            w = w + np.linalg.solve(hess, g)
    elif len(x):
        w[-1] = 4.0 if y.mean() == 1 else -4.0
    return mean, scale, w


def _measured(docs: DataFrame, ids: list[str]) -> DataFrame:
    """ids and ``x``, the features of the text."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(measure(b)) for b in tb.blocks(batch.column(len(ids)))]
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], lists], names=[*ids, "x"])

    return small_batches(docs).mapInArrow(run, schema)


def _strength(groups: DataFrame, center: Column) -> float:
    """The Beta prior's strength by moments: the spread of group rates beyond what their counts explain."""
    usable = groups.filter("n >= 2")
    r = usable.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * (F.col("k") / F.col("n") - center) ** 2).alias("ss"), F.avg(center * (1 - center)).alias("v")).first()
    if not r["g"] or r["g"] < 2 or not r["v"]:
        return MOST_STRENGTH
    between = (r["ss"] - (r["g"] - 1) * r["v"]) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(min(MOST_STRENGTH, max(1.0, r["v"] / between - 1))) if between > 0 else MOST_STRENGTH


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality") -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, kept) per row of ``docs``; kept where score >= 0.5.

    ``host`` and ``path`` are expressions over ``docs``; a path is told apart within its host.
    """
    ids = ["doc_id", "__host", "__path"]
    rows = stored(_measured(docs.select("doc_id", host.cast("string").alias("__host"), path.cast("string").alias("__path"), F.col("text").alias("__text")), ids), "site-features")
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("y")).filter("y IN (0, 1)")
    known = stored(rows.join(known, F.col("doc_id") == F.col("__id")).select(*ids, "x", F.col("y").cast("double").alias("y")), "site-labelled")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).first()
    rate = min(max(total["rate"], 1e-3), 1 - 1e-3) if total["n"] else 0.5
    share = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.9 * SAMPLE / max(total["n"], 1)) + 1)
    sample = known.filter(share).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "y").select("x", "y").limit(SAMPLE).toPandas()
    mean, scale, w = fit(np.array(sample["x"].tolist(), float).reshape(-1, FEATURES), sample["y"].to_numpy(float))

    paths = known.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = _strength(hosts, F.lit(rate))
    hosts = stored(hosts.select("__host", ((F.col("k") + s * rate) / (F.col("n") + s)).alias("host_rate")), "hosts")
    up = hosts.withColumnRenamed("__host", "h")
    nested = paths.join(up, F.col("__host").eqNullSafe(F.col("h"))).drop("h")
    t = _strength(nested, F.col("host_rate"))
    nested = nested.select(F.col("__host").alias("h2"), F.col("__path").alias("p2"), ((F.col("k") + t * F.col("host_rate")) / (F.col("n") + t)).alias("path_rate"))

    z = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
    for i, c in enumerate(w[:-1] / scale):
        z = z + F.lit(float(c)) * F.element_at("x", i + 1)
    out = rows.withColumn("evidence", z).drop("x")
    out = out.join(up, F.col("__host").eqNullSafe(F.col("h")), "left").join(nested, F.col("__host").eqNullSafe(F.col("h2")) & F.col("__path").eqNullSafe(F.col("p2")), "left")
    out = out.withColumn("host_rate", F.coalesce("host_rate", F.lit(rate))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    held = F.least(F.greatest(F.col("path_rate"), F.lit(1e-3)), F.lit(1 - 1e-3))
    odds = F.col("evidence") - float(np.log(rate / (1 - rate))) + F.log(held / (1 - held))
    final = 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", final.alias("score"), (final >= 0.5).alias("kept"))
