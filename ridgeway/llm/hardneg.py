"""Hard negatives by threshold joins over an inverted index with norm bounds.

Components are whole numbers, a row's score is its inner product with an anchor.  An anchor's positives are its best rows of the same label; for
each positive, its negatives are the best rows of other labels whose score lies between two shares of the positive's.

Vectors are dealt to shards of about ``SHARD_ROWS``, anchors to blocks of about ``BLOCK_ROWS``; each block of the stated anchors meets each shard once a
round.  Up to ``GROUP_SHARDS`` shards stay together: a block is sent to each group once and meets its shards one after the other, where a full window's worst score is
the threshold for what follows.  There, the dimensions are ordered by energy.  A row posts only those dimensions that follow the longest prefix whose norm
keeps it below every anchor's threshold; a row without postings can't reach any.  Posting lists are walked from the most
energetic dimension down; partial scores accumulate, and after each step a row goes once the norms of what remains can't lift it to the
threshold of any anchor.  What is left is bounded once more by the prefix that was not posted, then scored exactly.

A window's threshold starts at its lower end (for positives: none) and rises to its worst score once it is full, so nothing is missed.  Further rounds may
start higher: an anchor with enough rows above its threshold has its exact best ones and leaves; the last round's threshold is the lower end.
A group returns its best few for each window, and a ranking that Spark limits before its shuffle merges them.

Definitions.  Rows take no part if id, label or vector is null, the vector is empty, or a component is null, NaN or infinite.  Of several rows of one id the
least by (label, vector) counts.  Vectors of different lengths have no product: each length is mined by itself.  Ties go to the smaller id.  No
rows or no anchors give no rows; an anchor without positives has none.  Scores have to fit 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import small_batches, stored

SHARD_ROWS = 2048
BLOCK_ROWS = 256
GROUP_SHARDS = 16
STEP = 16
#: Thresholds by round: of positives, as shares of the largest possible score; of negatives, as shares of the window, from its top.
#: One round each: thresholds rise from shard to shard within a group, and a round costs about as much whatever it starts from.
POSITIVE_ROUNDS = (None,)
NEGATIVE_ROUNDS = (1.0,)
_LEAST, _MOST = -(2**63), 2**63 - 1
#: What rounding can add to a bound, as a share of the product of norms.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def whole(vector: Column, scale: int) -> Column:
    """Components as whole numbers: floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def reaching(q: np.ndarray, v: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row): all pairs whose product can reach the anchor's threshold ``low``, and few others.  Thresholds may be -inf."""
    q, v = q.astype(np.float64), v.astype(np.float64)
    order = np.argsort((v**2).sum(axis=0), kind="stable")
    q, v = q[:, order], v[:, order]
    head_q, head_v = (np.sqrt(np.pad(np.cumsum(x**2, axis=1), ((0, 0), (1, 0)))) for x in (q, v))
    norm_q = head_q[:, -1]
    low = low - SLACK * (norm_q * head_v[:, -1].max(initial=0) + 1)
    # a zero anchor reaches zero with every row
    need = np.where(norm_q > 0, low / np.where(norm_q > 0, norm_q, 1), np.where(low <= 0, -np.inf, np.inf)).min(initial=np.inf)
    skip = (head_v[:, 1:] < need).sum(axis=1)  # the prefix that isn't posted
    rows = np.argsort(skip, kind="stable")
    rows = rows[skip[rows] < v.shape[1]] if need > -np.inf else rows
    skip = skip[rows]
    have = np.zeros((len(q), len(rows)))
    for stop in range(v.shape[1], 0, -STEP):
        dims = np.arange(max(0, stop - STEP), stop)
        n = int(np.searchsorted(skip, stop - 1, side="right"))  # the posting lists end there
        have[:, :n] += q[:, dims] @ np.where(dims >= skip[:n, None], v[np.ix_(rows[:n], dims)], 0).T
        rest = np.minimum(dims[0], v.shape[1])
        alive = (have + head_q[:, [rest]] * head_v[rows, rest] + _unposted(head_q, head_v, rows, skip, rest) >= low[:, None]).any(axis=0)
        have, rows, skip = have[:, alive], rows[alive], skip[alive]
    a, x = np.nonzero(have + head_q[:, skip] * head_v[rows, skip] >= low[:, None])
    return a, rows[x]


def _unposted(head_q: np.ndarray, head_v: np.ndarray, rows: np.ndarray, skip: np.ndarray, rest: int) -> np.ndarray:
    """What dimensions from ``rest`` on that a row didn't post can add."""
    most = np.zeros((len(head_q), len(rows)))
    over = np.flatnonzero(skip > rest)
    most[:, over] = head_q[:, skip[over]] * head_v[rows[over], skip[over]]
    return most


class _Windows:
    """The windows of a block's anchors, each with the ``k`` best rows of the shards met so far."""

    def __init__(self, ids: np.ndarray, windows: list, k: int):
        flat = [(i, w["w"], w["lo"], w["hi"]) for i, ws in enumerate(windows) for w in ws]
        self.ids, self.k = ids, k
        self.own, self.w, self.lo, self.hi = (np.array(c, np.int64) for c in zip(*flat))
        self.first = np.searchsorted(self.own, np.arange(len(ids)))
        self.last = np.searchsorted(self.own, np.arange(len(ids)), side="right")
        self.score, self.row = [np.zeros(0, np.int64)] * len(flat), [np.zeros(0, np.int64)] * len(flat)

    def low(self) -> np.ndarray:
        """Each anchor's threshold."""
        low = np.minimum.reduceat(self.lo, self.first)
        return np.where(low <= _LEAST, -np.inf, low.astype(np.float64))

    def meet(self, q_labels: np.ndarray, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, same: bool) -> None:
        a, x = reaching(q, v, self.low())
        fits = (q_labels[a] == labels[x]) == same
        fits &= self.ids[a] != ids[x]
        a, x = a[fits], x[fits]
        score = np.concatenate([np.zeros(0, np.int64), *((q[a[i : i + 65536]] * v[x[i : i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536))])
        order = np.lexsort((ids[x], -score, a))
        a, x, score = a[order], x[order], score[order]
        first = np.searchsorted(a, np.arange(len(self.ids) + 1))
        for i in np.flatnonzero(np.diff(first)):
            down, own = -score[first[i] : first[i + 1]], ids[x[first[i] : first[i + 1]]]
            for j in range(self.first[i], self.last[i]):
                s = np.searchsorted(down, -self.hi[j]) if self.hi[j] < _MOST else 0
                e = min(np.searchsorted(down, -self.lo[j], side="right") if self.lo[j] > _LEAST else len(down), s + self.k)
                if s < e:
                    self._add(j, -down[s:e], own[s:e])

    def _add(self, j: int, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.append(self.score[j], score), np.append(self.row[j], row)
        best = np.lexsort((row, -score))[: self.k]
        self.score[j], self.row[j] = score[best], row[best]
        if len(best) == self.k:
            self.lo[j] = self.score[j][-1]  # what ties may still have a smaller id

    def found(self) -> pa.RecordBatch:
        n = [len(s) for s in self.score]
        columns = (np.repeat(self.ids[self.own], n), np.repeat(self.w, n).astype(np.int32), np.concatenate(self.row), np.concatenate(self.score))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "w", "id", "score"])


def _mine(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each window; a block's shards follow one another."""
    matrix = lambda x: x.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    held, at_hand = None, None
    for batch in batches:
        for at in range(batch.num_rows):
            block, shard = (batch.column(c)[at].values for c in ("block", "shard"))
            (q_ids, q_labels), (ids, labels) = ([x.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label")] for x in (block, shard))
            if at_hand is None or not np.array_equal(at_hand, q_ids):
                if held is not None:
                    yield held.found()
                held, at_hand = _Windows(q_ids.copy(), block.field("windows").to_pylist(), k), q_ids.copy()
            held.meet(q_labels, matrix(block), ids, labels, matrix(shard), same)
    if held is not None:
        yield held.found()


def _dealt(n: int, each: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / each)))).cast("int")


def _round(anchors: DataFrame, asked: DataFrame, shards: DataFrame, n_shards: int, same: bool, k: int) -> DataFrame:
    """(anchor_id, w, id, score, rank) for ``asked`` (anchor_id, w, lo, hi): the best ``k`` rows of each window."""
    windows = asked.groupBy("anchor_id").agg(F.collect_list(F.struct("w", "lo", "hi")).alias("windows"))
    some = stored(anchors.join(windows, anchors.id == windows.anchor_id).drop("anchor_id"), "asking")
    blocks = some.groupBy("dim", _dealt(some.count(), BLOCK_ROWS).alias("b")).agg(F.collect_list(F.struct("id", "label", "vec", "windows")).alias("block"))
    # a group has few shards for all tasks to have one, its shards are what a task holds
    each = max(1, min(GROUP_SHARDS, n_shards // (4 * asked.sparkSession.sparkContext.defaultParallelism)))
    groups = shards.withColumn("g", F.floor(F.col("s") / each).cast("int"))
    # sorted by group, each block meets all shards of its group in turn
    met = blocks.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit((n_shards - 1) // each))).alias("g")).join(groups.hint("merge"), ["dim", "g"]).select("block", "shard")
    found = small_batches(met).mapInArrow(partial(_mine, same=same, k=k), "anchor_id bigint, w int, id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id"))
    return stored(found.withColumn("rank", rank).filter(F.col("rank") <= k), "mined")


def _full(found: DataFrame, k: int) -> DataFrame:
    return found.filter(F.col("rank") == k).select("anchor_id", "w")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: (id, label, vec) with whole numbers; ``anchors``: which of them are anchors.  A negative's score is between ``low`` and
    ``high`` per cent of the positive's.
    """
    rows = vectors.filter("id IS NOT NULL AND label IS NOT NULL AND size(vec) > 0").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    rows = stored(rows.select("id", F.col("r.label").cast("long").alias("label"), F.col("r.vec").alias("vec"), F.size("r.vec").alias("dim")), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n, largest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    n_shards = max(1, math.ceil(n / SHARD_ROWS))
    shards = stored(rows.groupBy("dim", _dealt(n, SHARD_ROWS).alias("s")).agg(F.collect_list(F.struct("id", "label", "vec")).alias("shard")), "shards")
    own = stored(rows.filter(anchors).withColumn("norm", norm), "anchors")

    best, left = [], own.select(F.col("id").alias("anchor_id"), "norm")
    for share in POSITIVE_ROUNDS:
        lo = F.lit(_LEAST) if share is None else F.ceil(F.col("norm") * (largest or 0.0) * share)
        asked = left.select("anchor_id", F.lit(0).alias("w"), lo.cast("long").alias("lo"), F.lit(_MOST).alias("hi"))
        found = _round(own, asked, shards, n_shards, True, positives)
        full = _full(found, positives).select("anchor_id")
        best.append(found if share is None else found.join(full, "anchor_id", "left_semi"))
        left = stored(left.join(full, "anchor_id", "left_anti"), "unfilled")
        if left.isEmpty():
            break
    pairs = best[0]
    for more in best[1:]:
        pairs = pairs.unionByName(more)
    bound = lambda share, to: to(F.col("score").cast("decimal(38,0)") * share / 100).cast("long")
    pairs = stored(pairs.select("anchor_id", F.col("rank").alias("w"), F.col("id").alias("positive_id"), "score", bound(low, F.ceil).alias("least"), bound(high, F.floor).alias("hi")), "pairs")

    out, left = [], pairs.filter("least <= hi").select("anchor_id", "w", "least", "hi")
    for share in NEGATIVE_ROUNDS:
        lo = F.greatest("least", F.ceil(F.col("hi") - (F.col("hi") - F.col("least")).cast("double") * share))
        found = _round(own, left.select("anchor_id", "w", (F.col("least") if share == 1.0 else lo).cast("long").alias("lo"), "hi"), shards, n_shards, False, k)
        full = _full(found, k)
        out.append(found if share == 1.0 else found.join(full, ["anchor_id", "w"], "left_semi"))
        left = stored(left.join(full, ["anchor_id", "w"], "left_anti"), "unfilled")
        if left.isEmpty():
            break
    mined = out[0]
    for more in out[1:]:
        mined = mined.unionByName(more)
    scored = pairs.select("anchor_id", "w", "positive_id", F.col("score").alias("positive_score"))
    return mined.withColumnRenamed("score", "negative_score").join(scored, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", "negative_score")
