r"""Line dedup with built-in DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; a key of ``MIN_CHARS`` code
points or more that ``MIN_DOCS`` documents hold loses its lines everywhere but in the largest doc_id.

Method.  Every document gives each of its keys once, as a 128-bit hash with the line positions, so only hashes
are moved.  They are range-partitioned by hash and sorted by (hash, doc_id descending, position): a window then streams
every key's first occurrence, which is the one to keep, and counts the documents.  The result is no text but a bitmap per
document.  It is compressed as what it lacks: the non-zero 64-bit words of the lines to drop, nothing for the many documents
that keep all; ``keep_words`` gives the keep bitmap in full.

Hot keys.  A key in a large share of all rows would be one task's whole load.  Keys that reach ``HOT_SHARE``
of the keys of a hash-chosen 1/``PROBE`` of documents (at most 1/HOT_SHARE of them, so their broadcast is
bounded) take another route to the same numbers: a partial aggregation in each map task, then a broadcast of
their result, whose rows are as few.  Which route a key takes never alters the result.

Definitions.  A null or empty text is one empty line and never loses it.  Rows of one doc_id count as one
document, and each keeps or loses its own lines; rows with a null doc_id neither count nor lose lines.  Two
keys with equal 128-bit hashes count as one.  Only doc_id and text are read, so other columns may have any name.
A text is split whole in its task, however long; its lines are moved as hashes of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import stored

MIN_CHARS = 40
MIN_DOCS = 5
HOT_SHARE = 1e-5
PROBE = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, row_hash, lines): each key of a row once, with the positions of its lines."""
    keys = F.transform(split_lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos")))
    keys = F.filter(keys, lambda x: F.char_length(x["k"]) >= min_chars)
    hashed = F.transform(keys, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(7), x["k"]).alias("h2"), x["pos"].alias("pos")))
    return (
        docs.filter("doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("row_hash"), F.explode(hashed).alias("x"))
        .select("x.h1", "x.h2", "doc_id", "row_hash", F.col("x.pos").alias("pos"))
    )


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row_hash, drop): ``drop`` maps a word's index to its 64 bits, a set bit at a line to drop.

    Documents that lose no line have no row.  ``row_hash`` tells rows of one doc_id apart.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(_occurrences(docs, min_chars), "line-keys")
    probe = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PROBE)) == 0)
    tally = probe.groupBy("h1", "h2").count()
    total = tally.agg(F.sum("count").alias("total"))
    hot = F.broadcast(tally.join(F.broadcast(total), F.col("count") >= F.greatest(F.lit(64.0), F.col("total") * HOT_SHARE)).select("h1", "h2"))

    cold = rows.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
    stream = W.partitionBy("h1", "h2").orderBy(F.desc("doc_id"), "pos")
    cold = cold.withColumns({"first": F.first("doc_id").over(stream.rowsBetween(W.unboundedPreceding, 0)), "new": F.when(F.lag("doc_id").over(stream) == F.col("doc_id"), 0).otherwise(1)})
    cold = cold.withColumn("n", F.sum("new").over(stream.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    cold = cold.filter((F.col("n") >= min_docs) & (F.col("doc_id") != F.col("first"))).select("doc_id", "row_hash", "pos")

    warm = rows.join(hot, ["h1", "h2"], "left_semi")
    # a key's documents: counted once each because (key, doc_id) is aggregated first, both times with partial sums
    counted = warm.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("first")).filter(F.col("n") >= min_docs)
    warm = rows.join(F.broadcast(counted), ["h1", "h2"]).filter(F.col("doc_id") != F.col("first")).select("doc_id", "row_hash", "pos")

    word = F.expr("pos div 64").cast("int").alias("word")
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = cold.unionByName(warm).groupBy("doc_id", "row_hash", word).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "row_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop"))


def is_dropped(drop: Column, pos: Column) -> Column:
    word = F.coalesce(F.element_at(drop, F.floor(pos / 64).cast("int")), F.lit(0).cast("long"))
    return F.getbit(word, F.pmod(pos, F.lit(64)).cast("int")) == 1


def keep_words(text: Column, drop: Column) -> Column:
    """The keep bitmap of a text as an array of 64-bit words, from its drop map: a set bit at every line that stays."""
    lines = F.size(split_lines(text))

    def word(i: Column) -> Column:
        inside = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - F.least(F.lit(64), lines - 64 * i))
        return inside.bitwiseAND(F.bitwise_not(F.coalesce(F.element_at(drop, i), F.lit(0).cast("long"))))

    return F.transform(F.sequence(F.lit(0), F.ceil(lines / 64).cast("int") - 1), word)


def with_bitmaps(docs: DataFrame, **limits: int) -> DataFrame:
    """All rows and columns of ``docs``, with the column ``__drop`` (null where a row loses nothing)."""
    maps = drop_bitmaps(docs, **limits).select(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__row"), F.col("drop").alias("__drop"))
    return docs.join(maps, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__row")), "left").drop("__doc", "__row")


def kept_text(text: Column, drop: Column) -> Column:
    """The lines that stay, joined by a line feed."""
    lines = split_lines(text)
    return F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda _, i: ~is_dropped(drop, i)), "\n"))


def dedup_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` with every text reduced to the lines that stay (a null text stays null), ``n_chars`` following where there is one."""
    out = with_bitmaps(docs, **limits).withColumn("text", F.when(F.col("text").isNotNull(), kept_text(F.col("text"), F.col("__drop"))))
    if "n_chars" in docs.columns:
        changed = F.col("__drop").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
