"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

A source's target comes from its weight, capped at ``CAP`` times its size, the excess going to the others.  A target
of E and a fraction times the size means E complete epochs, and then a weighted sample without replacement up to
the rest: every document draws the key -ln(u) / quality, documents are taken by ascending key, and the prefix sum
of their sizes is cut where it comes nearest the budget.  u is a hash of the doc_id and a seed, so reruns agree.

Scale.  Only (doc_id, source, size, quality) is moved, never text.  A prefix sum over a source that holds a third
of all rows can't be one window: keys fall into buckets of about ``BUCKET_ROWS`` rows, bucket sums are added up
per source, which settles all buckets but the one where the budget ends, and only that one is sorted.

Definitions.  A null or empty text has size 0 and is taken in whole epochs only, i.e. adds no words.  A null source
is a source of its own, the last one.  Long texts are counted whole, by built-in functions.  Ties of keys go to the smaller doc_id (nulls first), then to the larger size;
repeated rows are documents of their own, but at the cut all of them are taken or none, so that reruns agree.  A source without words has target 0; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import stored

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
BUCKET_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight in (0, 1]: the smaller, the more of a text is marks such as # or |."""
    marks = F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(1.0 / (1.0 + F.lit(8.0) * marks / F.greatest(F.char_length(text), F.lit(1))), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size, ...), one row per source.

    Ordered by the weight at which a source reaches its cap, the sources that are capped are a prefix; what they
    leave is shared by weight among the rest.  All sums are of integers, hence exact in any order.  The table has a
    row per source, so its windows are small.
    """
    everywhere = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size").cast("double") * cap)
    upto = everywhere.orderBy(F.col("most") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    all_ = everywhere.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumns({"all_words": F.sum("source_size").over(all_) * F.lit(share_percent / 100.0), "all_w": F.sum("w").over(all_), "used": F.coalesce(F.sum("most").over(upto), F.lit(0.0)), "used_w": F.coalesce(F.sum("w").over(upto), F.lit(0.0))})
    level = (F.col("all_words") - F.col("used")) / (F.col("all_w") - F.col("used_w"))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("w") * F.col("level") <= F.col("most"))
    # the first source that isn't capped sets the level for all that follow
    first = F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("w"), "rank", "level"))).over(all_)
    return ranked.withColumn("final", first["level"]).select("source", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("final"))).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 17, **shares) -> DataFrame:
    """(doc_id, row_hash, size, source, source_size, target, taken) for every row; ``taken`` is size times its repeats."""
    text = F.col("text")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("row_hash"), (word_count(text) if size is None else size).alias("size"), (quality(text) if weight is None else weight).alias("weight"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = stored(rows.withColumn("key", -F.log(u) / F.greatest(F.col("weight"), F.lit(1e-9))), "mix-keys")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg("key").alias("mean"))
    goals = targets(per_source.select("source", "source_size"), **shares)
    plan = goals.join(per_source.select(F.col("source").alias("s"), "n", "mean"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumns({"epochs": F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"), "buckets": F.ceil(F.col("n") / BUCKET_ROWS)})
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")

    known = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # keys are about exponential, so this spreads them evenly
    known = known.withColumn("bucket", F.floor((1.0 - F.exp(-F.col("key") / F.col("mean"))) * F.col("buckets")))
    sums = known.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "in_bucket", "before")
    placed = known.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest"))
    last = placed.filter(cut)
    running = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), F.desc("size")).rangeBetween(W.unboundedPreceding, W.currentRow))
    last = last.withColumn("through", F.col("before") + running).withColumn("once", ((F.col("through") - F.col("size") / 2.0) < F.col("rest")).cast("long"))
    rest = placed.filter(~cut).withColumns({"through": F.lit(0).cast("long"), "once": (F.col("before") + F.col("in_bucket") <= F.col("rest")).cast("long")})
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("rest") > 0, F.col("once")).otherwise(0))
    return last.unionByName(rest).select("doc_id", "row_hash", "size", "source", "source_size", "target", taken.alias("taken"), (F.col("epochs") + F.when(F.col("rest") > 0, F.col("once")).otherwise(0)).alias("repeats"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, perhaps never; columns unchanged."""
    plan = mix(docs, **options).filter("repeats > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("row_hash").alias("__h"), F.col("repeats").alias("__n"))
    plan = plan.dropDuplicates(["__d", "__s", "__h"])  # repeated rows have the same repeats
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.xxhash64("text") == F.col("__h"))
    return docs.join(plan, same).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)
