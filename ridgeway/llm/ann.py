"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Nearness is the cosine.  Unit vectors go to the list of their nearest centroid, and the residual is stored as
``PARTS`` one-byte codes.  A query probes its nearest lists; within a list a table of distances from the query's
residual to every codeword makes a stored vector's distance a sum of look-ups.  With the length of what the codes leave
out, kept beside them, that distance bounds the true one from both sides: a stored vector is passed over only if ``k`` + 1
others are certainly nearer, and all the rest are reranked by the exact cosine of the original vectors, in double
precision.  So within the probed lists the answer is exact, however many vectors share their codes.

Training takes about ``SAMPLE`` vectors, chosen by a hash of the id; every vector is indexed.  How many lists a query probes is
measured on that sample, for a recall of ``RECALL``.  Centroids and codebooks
are of bounded size (``most_lists`` lists) and travel in the tasks' closures.  Lists and the queries that probe them are cut into
blocks, so no task holds a whole list however the vectors cluster.  Vectors of one direction (to 12 digits) are one class:
only its smallest ids, as many as an answer can name, are kept (a limit that is applied before the shuffle), so a vector
that a third of the rows share costs one entry.

Definitions.  Rows take no part if the id is null or the vector is null, zero, or holds a null, a NaN or an infinity.  Vectors of
different lengths have no angle: each length is searched by itself.  Scores are compared
to 12 digits; ties go to the smaller id.  A repeated id counts once for each different
vector; a query never names its own id.  No queries or no vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import stored

SAMPLE = 20_000
MOST_LISTS = 1024
#: Lengths of vectors, each searched by itself; more are an error.
MOST_LENGTHS = 64
PARTS = 32
CODES = 256
RECALL = 0.97
TRIALS = 256
DIGITS = 12
#: What single precision can do to a squared distance of unit vectors, and to a length.
LOOSE_SQUARE, LOOSE = 2e-5, 1e-5
LIST_BLOCK = 8192
QUERY_BLOCK = 2048


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, rep, ids, vec): vectors of one direction once, with their ``keep`` smallest ids in order."""
    few = vectors.withColumn("n", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("n") <= keep)
    return few.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vec", "id").alias("vec"))


def _exact_unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _unit(x: np.ndarray) -> np.ndarray:
    return _exact_unit(x).astype(np.float32)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((centers**2).sum(axis=1) - 2 * x[i : i + 4096] @ centers.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return centers


class Index:
    """Coarse centroids (lists x dim) and codebooks (parts x codes x width)."""

    def __init__(self, sample: np.ndarray, lists: int, k: int = 5):
        rng = np.random.default_rng(5)
        x = _unit(sample)
        self.dim = x.shape[1]
        self.parts = min(PARTS, self.dim)
        self.width = math.ceil(self.dim / self.parts)
        self.centers = kmeans(x, lists, 8, rng)
        rest = self.split(x - self.centers[_nearest(x, self.centers)])
        self.probes = self.calibrate(x, rng, k)
        self.books = np.stack([kmeans(rest[:, p], min(CODES, max(1, len(x))), 6, rng) for p in range(self.parts)])

    def calibrate(self, x: np.ndarray, rng: np.random.Generator, k: int) -> int:
        """The fewest probes that find ``RECALL`` of the sample's own nearest neighbours, by brute force over it.

        The full table is denser, so its neighbours are nearer and found with no more probes.
        """
        own, seen = _nearest(x, self.centers), []
        pick = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
        order = np.argsort((self.centers**2).sum(axis=1) - 2 * x[pick] @ self.centers.T, axis=1, kind="stable")
        for i, lists in zip(pick, order):
            near = x @ x[i]
            near[i] = -np.inf
            best = np.argpartition(-near, min(k, len(x) - 1))[:k]
            seen.append(np.argsort(lists)[own[best]])
        return min(len(self.centers), 1 + int(np.quantile(np.concatenate(seen), RECALL, method="higher"))) if seen else 1

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * self.width - self.dim))).reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes leave out) of each vector."""
        own = _nearest(x, self.centers)
        rest = self.split(x - self.centers[own])
        code = np.stack([_nearest(rest[:, p], self.books[p]) for p in range(self.parts)], axis=1).astype(np.uint8)
        left = sum(((rest[:, p] - self.books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(self.parts))
        return own, code, np.sqrt(left)

    def table(self, queries: np.ndarray, list_: int) -> np.ndarray:
        """(query, part, code): squared distances of the queries' residuals to every codeword."""
        rest = self.split(queries - self.centers[list_])
        return ((rest[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)


def best_of_block(index: Index, list_: int, vecs: np.ndarray, codes: np.ndarray, left: np.ndarray, queries: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the ``keep`` stored vectors with the highest cosine to each query; ties go to the smaller place."""
    stored_, by_part, out = _exact_unit(vecs), codes.T.astype(np.int64), []
    for i in range(0, len(queries), 64):
        few = _exact_unit(queries[i : i + 64])
        tables = index.table(few.astype(np.float32), list_)
        d = tables[:, 0][:, by_part[0]]
        for p in range(1, index.parts):
            d += tables[:, p][:, by_part[p]]
        near = np.ones(d.shape, bool)
        if len(stored_) > keep:
            most = np.partition(np.sqrt(d + LOOSE_SQUARE) + left, keep - 1, axis=1)[:, keep - 1 : keep]
            near = np.sqrt(np.maximum(d - LOOSE_SQUARE, 0)) - left <= most + LOOSE
        some = np.nonzero(near.any(axis=0))[0]
        score = np.where(near[:, some], few @ stored_[some].T, -np.inf)
        best = np.argsort(-np.round(score, DIGITS), axis=1, kind="stable")[:, :keep]
        q = np.repeat(np.arange(len(few)), best.shape[1])
        score, place = score[q, best.ravel()], some[best.ravel()]
        out.append((q[score > -np.inf] + i, place[score > -np.inf], score[score > -np.inf]))
    return tuple(map(np.concatenate, zip(*out)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def directed(rows: DataFrame, dim: int) -> DataFrame:
    """(id, vec, h1, h2): ``rows`` with hashes of their direction, the unit vector to ``DIGITS`` digits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = np.rint(_exact_unit(_matrix(batch.column(1), dim)) * 10.0**DIGITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in to], pa.binary())], names=["id", "vec", "to"])

    return rows.select("id", "vec").mapInArrow(run, "id bigint, vec array<double>, to binary").select("id", "vec", F.xxhash64("to").alias("h1"), F.xxhash64(F.lit(11), "to").alias("h2"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False, most_lists: int = MOST_LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (on column ``id``) its ``k`` nearest others of its length.

    With ``exact`` every list is probed, and nothing is missed.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    lengths = sorted(r["dim"] for r in rows.select(F.size("vec").alias("dim")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for n, dim in enumerate(lengths):
        some = _nearest_of_length(rows.filter(F.size("vec") == dim), dim, is_query, k, exact, most_lists)
        out = out.unionByName(some) if n else some
    return out


def _nearest_of_length(rows: DataFrame, dim: int, is_query: Column, k: int, exact: bool, most_lists: int) -> DataFrame:
    known = stored(classes(directed(rows, dim), k + 1), "ann-classes")
    n = known.count()

    share = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE / n))
    sample = known.filter(share).select("rep", "vec").orderBy("rep").limit(2 * SAMPLE).toPandas()
    if not len(sample):
        sample = known.select("vec").limit(1).toPandas()
    index = Index(np.array(sample["vec"].tolist(), np.float64), max(1, min(most_lists, round(4 * n ** (1 / 3)), len(sample))), k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, code, rest = index.encode(_unit(_matrix(batch.column(1), dim)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(rest, pa.float32()), batch.column(1)], names=["rep", "list", "code", "rest", "vec"])

    coded = stored(known.select("rep", "vec").mapInArrow(assign, "rep bigint, list int, code binary, rest float, vec array<double>"), "ann-codes")
    sizes = np.zeros(len(index.centers), np.int64)
    for r in coded.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    probes = len(sizes) if exact else index.probes

    asked = directed(rows.filter(is_query), dim).select("id", "h1", "h2")
    who = asked.select("h1", "h2").distinct()
    who = known.join(who, ["h1", "h2"]).select(F.col("rep").alias("q"), F.col("vec").alias("qvec"))
    asked = asked.join(known.select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"]).select("id", "q")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1), dim))
                order = np.argsort((index.centers**2).sum(axis=1) - 2 * x @ index.centers.T, axis=1, kind="stable")
                # further lists while those probed hold too few vectors to fill an answer
                have = np.cumsum(sizes[order], axis=1)
                take = np.maximum(probes, (have < 4 * (k + 1)).sum(axis=1) + 1)
                at, rank = np.nonzero(np.arange(len(sizes))[None] < take[:, None])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(order[at, rank], pa.int32()), batch.column(1).take(pa.array(at))], names=["q", "list", "qvec"])

    asking = stored(who.mapInArrow(probe, "q bigint, list int, qvec array<double>"), "ann-probes")
    waiting = np.zeros(len(sizes), np.int64)
    for r in asking.groupBy("list").count().collect():  # at most MOST_LISTS rows
        waiting[r["list"]] = r["count"]
    cuts = lambda m, size: F.element_at(F.array(*(F.lit(int(max(1, math.ceil(x / size)))) for x in m)), F.col("list") + 1)
    part = lambda c, n_: F.pmod(F.xxhash64(c), n_.cast("long")).cast("int")
    every = lambda n_: F.explode(F.sequence(F.lit(0), n_ - 1))
    left = coded.withColumn("b", part("rep", cuts(sizes, LIST_BLOCK))).withColumn("qb", every(cuts(waiting, QUERY_BLOCK)))
    right = asking.withColumn("qb", part("q", cuts(waiting, QUERY_BLOCK))).withColumn("b", every(cuts(sizes, LIST_BLOCK)))

    def scan(key: tuple, stored_: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
        if not stored_.num_rows or not queries.num_rows:
            return schema.empty_table()
        stored_ = stored_.sort_by("rep")  # ties go to the smaller id
        column = lambda t, name: t.column(name).combine_chunks()
        codes = np.frombuffer(b"".join(stored_.column("code").to_pylist()), np.uint8).reshape(-1, index.parts)
        q, place, score = best_of_block(index, key[0].as_py(), _matrix(column(stored_, "vec"), dim), codes, stored_.column("rest").to_numpy(), _matrix(column(queries, "qvec"), dim), k + 1)
        return pa.table([queries.column("q").to_numpy()[q], stored_.column("rep").to_numpy()[place], score], schema=schema)

    keys = ["list", "b", "qb"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "q bigint, rep bigint, score double")
    digits = F.rint(F.col("score") * 10.0**DIGITS)
    best = W.partitionBy("q").orderBy(F.desc(digits), "rep")
    scored = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).join(known.select("rep", "ids"), "rep")
    pairs = asked.join(scored, "q").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc(digits), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
