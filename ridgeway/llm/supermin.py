r"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set is its distinct shingles of ``size`` words, five unless told otherwise (A-Z lower-cased, words
outside ASCII white space); with fewer words the whole sequence is its one shingle; without words the set is empty and links with nothing.  Documents
link when 100 * |A and B| >= 80 * |A or B|; the grouping is the transitive closure of links.

Steps, all distributed:

1. Each text yields its set size, a 128-bit fingerprint of the set, and a SuperMinHash signature: every
   element carries one pseudo-random permutation of the positions and ranks along it, so its ranks at different
   positions exclude one another, and a document stops as soon as no further rank can lower a position.
2. Equal sets collapse to one representative (smallest doc_id) by a partial aggregation.
3. Signatures of 128 positions are cut into 32 bands of 4.  A pair at similarity 0.8 misses all bands with
   probability (1 - 0.8^4)^32 < 5e-8.
4. In a bucket every member is paired with the bucket's smallest id only.  Pairs whose signatures agree at fewer than 72
   of 128 positions go (a pair at 0.8 does so with probability 1e-8); the rest is confirmed on full sets and grouped.
   Pairs within a group need no further look: they couldn't change it.
5. Members of a bucket that then lie in different groups may still link.  A shingle that no other such member holds
   can't be shared, so with m shared-able of n shingles, documents link only if 180 * min(m, m') >= 80 * (n + n').
   This exact bound drops documents on their own (m < 0.8 n).  The others are first paired with their bucket's most
   typical member (largest m / n), which gathers the copies of one text with edits of their own, the usual large
   group.  What is still apart is compared in blocks of bounded size; pairs that the bound, the signatures or bitmaps
   of the sets exclude are dropped, and the rest is confirmed.  A bitmap only ever overstates an intersection.

Definitions.  Rows with one doc_id count as one document that holds both sets.  A row with a null doc_id links
with nothing; its component is null and it is kept.  An empty table gives an empty result.  Only doc_id and text
are read.  Sets hold 64-bit shingle hashes.  A text is held whole in a task, however long, with some 15 bytes per byte.

A link can be lost where signatures decide: a pair at similarity 0.8 that meets in no band (5e-8) or agrees at fewer than
72 positions (1e-8).  There is no exact way for those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .graph import components
from .store import small_batches, stored

SHINGLE = 5
POSITIONS = 128
ROWS = 4
BANDS = POSITIONS // ROWS
AGREE = 72
BLOCK = 512
PERCENT = 80
BITS_EACH = 8

_U = np.uint64


def shingles(block: tb.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), distinct within each row and sorted by row, then hash."""
    block = block.lowered()
    row, start, end = block.words()
    word = block.hash(start, end)
    at, h = tb.windows(row, word, size)
    owner = row[at]
    n = np.bincount(row, minlength=block.n)
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n[short] > k
            total[has] = tb.mix(total[has] + word[first[short[has]] + k] + _U(0xD1B54A32D192ED03 + k))
        owner, h = np.concatenate([owner, short]), np.concatenate([h, total])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def signatures(owner: np.ndarray, element: np.ndarray, n: int, positions: int = POSITIONS) -> np.ndarray:
    """SuperMinHash of ``n`` sets given as (owner, element): (n, positions), all ones where a set is empty.

    At level j an element draws from its own stream the position at rank j of its permutation (Fisher-Yates) and
    a fraction; the level in the upper bits makes every later level larger than all earlier ones.  So once all
    positions of a document hold a value of level j or less, levels beyond j can't change it and it stops.
    """
    best = np.full((n, positions), ~_U(0))
    flat = best.reshape(-1)
    live, seed, perm = owner, element, None
    for level in range(positions):
        if len(live) == 0:
            break
        draw = tb.mix(seed + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = level + ((draw >> _U(40)) * _U(positions - level) >> _U(24)).astype(np.int64)
        if perm is None:
            place = pick
        else:
            lines = np.arange(len(live))
            place = perm[lines, pick].astype(np.int64)
            perm[lines, pick] = perm[:, level]
        value = (draw * _U(0xD6E8FEB86659FD93) >> _U(8)) | _U(level << 56)
        slot = live * positions + place
        order = np.lexsort((value, slot)) if len(slot) < 4096 else np.argsort(slot, kind="stable")
        if len(slot) < 4096:
            lead = np.ones(len(order), bool)
            lead[1:] = slot[order[1:]] != slot[order[:-1]]
            where = slot[order[lead]]
            flat[where] = np.minimum(flat[where], value[order[lead]])
        else:
            ordered = slot[order]
            lead = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            where = ordered[lead]
            flat[where] = np.minimum(flat[where], np.minimum.reduceat(value[order], lead))
        open_ = (best == ~_U(0)).any(axis=1)
        go = open_[live]
        if not go.any():
            break
        if perm is None:
            live, seed, first = live[go], seed[go], pick[go]
            perm = np.tile(np.arange(positions, dtype=np.uint8), (len(live), 1))
            perm[np.arange(len(live)), first] = 0
        elif not go.all():
            live, seed, perm = live[go], seed[go], perm[go]
    return best


def _features(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch.column(1), tb.BLOCK_BYTES // 2):
            owner, h = shingles(block, words)
            size = np.bincount(owner, minlength=block.n)
            sig = signatures(owner, h, block.n)
            sums = [np.zeros(block.n, np.uint64) for _ in range(2)]
            for k, s in enumerate(sums):
                np.add.at(s, owner, tb.mix(h + _U(k + 1)))
            band = np.zeros((block.n, BANDS), np.uint64)
            for k in range(ROWS):
                band = tb.mix(band + sig[:, k::ROWS] + _U(k + 1))
            band = tb.mix(band + np.arange(BANDS, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))
            small = (tb.mix(sig) & _U(255)).astype(np.uint8)
            full = size > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.n),
                    pa.array(size, pa.int64()),
                    *(pa.array(s.view(np.int64), mask=~full) for s in sums),
                    pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * BANDS, pa.int32()), pa.array(band.reshape(-1).view(np.int64))),
                    pa.array([r.tobytes() for r in small], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
            )


def features(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands, sig) per row; f1 and f2, the set's fingerprint, are null for an empty set."""
    return small_batches(docs.select("doc_id", "text")).mapInArrow(partial(_features, words=size), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, sig binary")


def _confirm(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Of (u, v, text of u, text of v), the pairs that link; a text that repeats from row to row is hashed once."""
    last: dict[str, np.ndarray] = {}

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for text in column:
            key = text.as_py() or ""
            if key not in last:
                if len(last) > 64:
                    last.clear()
                block = next(tb.blocks(pa.array([key], pa.large_string())))
                last[key] = shingles(block, words)[1]
            yield last[key]

    for batch in batches:
        keep = []
        for a, b in zip(sets(batch.column(2)), sets(batch.column(3))):
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Of distinct (u, v): those that link.  ``texts``: (id, text); it is cut down to the ids in question first."""
    some = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    texts = stored(texts.join(some, "id", "left_semi"), "texts")
    a = texts.select(F.col("id").alias("v"), F.col("text").alias("tv"))
    b = texts.select(F.col("id").alias("u"), F.col("text").alias("tu"))
    return pairs.join(a, "v").join(b, "u").select("u", "v", "tu", "tv").mapInArrow(partial(_confirm, words=size), "u bigint, v bigint")


def _members(block: pa.StructArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The numbers of a block's members by name, and their signatures, one per line."""
    sig = np.frombuffer(b"".join(block.field("sig").to_pylist()), np.uint8)
    return {k: block.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "grp", "n", "m")}, sig.reshape(-1, POSITIONS)


def _bitmaps(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Of (id, text): the set as a bitmap of 8 to 16 bits per shingle, a power of two; a larger one folds onto a smaller one by halves."""
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            owner, h = shingles(block, words)
            bits = 1 << np.ceil(np.log2(np.maximum(BITS_EACH * np.bincount(owner, minlength=block.n), 64))).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(bits)])
            flag = np.zeros(first[-1], bool)
            flag[first[owner] + (h & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
            packed = np.packbits(flag)
            maps = [packed[a:b].tobytes() for a, b in zip(first[:-1] // 8, first[1:] // 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.array(maps, pa.binary())], names=["id", "bits"])


def _folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps, one per line, folded to ``size`` words."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _shareable(one: bytes, n: int, bits: list, many: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An upper bound of the intersection of a set of ``n`` with each of those at ``at``: a bit that only one of them sets is a shingle that the other lacks."""
    most = np.minimum(n, many[at])
    if one is None:
        return most
    length = np.array([len(bits[i] or b"") for i in at])
    for size in set(length.tolist()) - {0}:
        some = np.flatnonzero(length == size)
        words = min(size, len(one)) // 8
        a = _folded(np.frombuffer(one, np.uint64)[None, :], words)
        b = _folded(np.frombuffer(b"".join(bits[i] for i in at[some]), np.uint64).reshape(len(some), -1), words)
        lacks_b, lacks_a = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a & ~b, b & ~a))
        most[some] = np.minimum(n - lacks_b, many[at[some]] - lacks_a)
    return most


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with two blocks of members: the pairs of different groups that the bound and the signatures allow to link."""
    for batch in batches:
        same = batch.column(2).to_pylist()
        for at in range(batch.num_rows):
            # one row of two blocks at a time, as arrays: a batch holds many
            (a, sa), (b, sb) = (_members(batch.column(side)[at].values) for side in (0, 1))
            bits_a, bits_b = (batch.column(side)[at].values.field("bits").to_pylist() for side in (0, 1))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(sa)):
                ok = (b["grp"] != a["grp"][k]) & ((100 + PERCENT) * np.minimum(a["m"][k], b["m"]) >= PERCENT * (a["n"][k] + b["n"]))
                if same[at]:
                    ok &= b["rep"] > a["rep"][k]
                near = np.flatnonzero(ok)
                near = near[(sb[near] == sa[k]).sum(axis=1) >= AGREE]
                if len(near):
                    near = near[(100 + PERCENT) * _shareable(bits_a[k], a["n"][k], bits_b, b["n"], near) >= PERCENT * (a["n"][k] + b["n"][near])]
                us.append(np.minimum(a["rep"][k], b["rep"][near]))
                vs.append(np.maximum(a["rep"][k], b["rep"][near]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _exploded(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            owner, h = shingles(block, words)
            ids = batch.column(0).slice(block.first, block.n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(h.view(np.int64))], names=["rep", "h"])


def _own_shingles(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(rep, own): how many of a member's shingles no other member holds."""
    some = texts.join(members.select(F.col("rep").alias("id")), "id", "left_semi")
    each = some.select("id", "text").mapInArrow(partial(_exploded, words=size), "rep bigint, h bigint")
    single = each.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).filter("rep = last")
    return single.groupBy(F.col("rep").alias("holder")).agg(F.count(F.lit(1)).alias("own"))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
        keep = pa.array((a == b).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of distinct (u, v): those whose signatures allow a link."""
    a, b = reps.select(F.col("rep").alias("u"), F.col("sig").alias("su")), reps.select(F.col("rep").alias("v"), F.col("sig").alias("sv"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "su", "sv").mapInArrow(_agreeing, "u bigint, v bigint").distinct()


def _mixed(bands: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, rep, grp, size): members of the buckets that hold several groups."""
    named = bands.join(roots.select(F.col("v").alias("rep"), "root"), "rep", "left").select(*bands.columns, F.coalesce("root", "rep").alias("grp"))
    some = named.groupBy("bucket").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    return named.join(some.select("bucket", "size"), "bucket")


def _may_link(mixed: DataFrame, reps: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(rep, sig, n, m, bits) of the members that the bound doesn't exclude on their own; bits, the set's bitmap, is null for a document of several sets."""
    members = stored(mixed.select("rep").distinct(), "members")
    own = _own_shingles(members, texts, size)
    known = reps.join(members, "rep", "left_semi").select("rep", "sig", F.col("n_shingles").alias("n"), "sets")
    known = known.join(own, F.col("rep") == F.col("holder"), "left")
    # rows of one doc_id with several sets aren't bounded
    known = known.withColumn("m", F.when(F.col("sets") == 1, F.col("n") - F.coalesce("own", F.lit(0))).otherwise(F.col("n")))
    known = stored(known.filter(f"100 * m >= {PERCENT} * n").select("rep", "sig", "n", "m", "sets"), "bounded")
    some = texts.join(known.filter("sets = 1").select(F.col("rep").alias("id")), "id", "left_semi").select("id", "text")
    maps = some.mapInArrow(partial(_bitmaps, words=size), "id bigint, bits binary").groupBy("id").agg(F.max_by("bits", F.length("bits")).alias("bits"))
    return known.join(maps, F.col("rep") == F.col("id"), "left").select("rep", "sig", "n", "m", "bits")


def _typical_stars(mixed: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v): members of a mixed bucket with its most typical member, where they are in different groups and the bound allows it."""
    named = mixed.join(known.drop("sig", "bits"), "rep")
    best = named.groupBy("bucket").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("share"), (-F.col("rep")).alias("id"), "grp", "n", "m")).alias("h"))
    pairs = named.join(best, "bucket").filter(f"grp <> h.grp AND {100 + PERCENT} * least(m, h.m) >= {PERCENT} * (n + h.n)")
    return pairs.select(F.least("rep", -F.col("h.id")).alias("u"), F.greatest("rep", -F.col("h.id")).alias("v")).distinct()


def _open_pairs(mixed: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that share a bucket but no group, and that may link by the bound and by their signatures.

    Buckets are cut into blocks of about ``BLOCK`` members, and blocks meet in pairs.
    """
    cuts = F.ceil(F.col("size") / BLOCK).cast("int")
    named = mixed.select("bucket", "rep", "grp", cuts.alias("cuts"), F.pmod(F.xxhash64("rep"), cuts.cast("long")).cast("int").alias("cut"))
    named = named.join(known, "rep")
    box = stored(named.groupBy("bucket", "cut", "cuts").agg(F.collect_list(F.struct("rep", "grp", "sig", "n", "m", "bits")).alias("m")), "boxes")
    left = box.select("bucket", F.col("cut").alias("a"), F.col("m").alias("l"), F.explode(F.sequence(F.col("cut"), F.col("cuts") - 1)).alias("b"))
    right = box.select("bucket", F.col("cut").alias("b"), F.col("m").alias("r"))
    met = left.join(right, ["bucket", "b"]).select("l", "r", (F.col("a") == F.col("b")).alias("same"))
    return met.mapInArrow(_cross, "u bigint, v bigint").distinct()


def _of_several_sets(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(several), the ids whose rows hold different sets, and (u, v): the classes that such an id ties together, with the id itself."""
    each = rows.filter("f1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(*(g(c).alias(f"{k}_{c}") for c in ("f1", "f2") for k, g in (("lo", F.min), ("hi", F.max))))
    several = stored(each.filter("lo_f1 <> hi_f1 OR lo_f2 <> hi_f2").select(F.col("doc_id").alias("several")), "several-sets")
    held = rows.join(several, F.col("doc_id") == F.col("several"), "left_semi").select("doc_id", "f1", "f2").distinct()
    same = held.join(classes, ["f1", "f2"]).select(F.least("doc_id", "rep").alias("u"), F.greatest("doc_id", "rep").alias("v")).filter("u < v").distinct()
    return several, stored(same, "same-id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``, compared by shingles of ``size`` words: doc_id, n_shingles, component_id (smallest doc_id of its group), kept."""
    docs = docs.select("doc_id", "text")
    rows = stored(features(docs, size), "features")
    reps = rows.filter("f1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = stored(reps, "classes")
    known = rows.join(classes, (rows.doc_id == classes.rep) & (rows.f1 == classes.f1) & (rows.f2 == classes.f2)).select("rep", "n_shingles", "bands", "sig").dropDuplicates(["rep", "sig", "n_shingles"])
    known = stored(known, "representatives")
    bands = known.select("rep", F.explode("bands").alias("bucket"))
    # buckets of one are dropped at once
    heads = bands.groupBy("bucket").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).filter("head <> tail")
    shared = stored(bands.join(heads, "bucket").select("bucket", "rep", "head"), "shared-bands")
    # rows of one doc_id with different sets are one document
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    stars = shared.filter("rep <> head").select(F.col("head").alias("u"), F.col("rep").alias("v")).distinct()
    several, same = _of_several_sets(rows, classes)
    counted = known.join(several.withColumn("sets", F.lit(2)), known.rep == several.several, "left").select("rep", "n_shingles", "sig", F.coalesce("sets", F.lit(1)).alias("sets"))
    roots = components(confirmed(stored(_plausible(stars, known), "stars"), texts, size).union(same))

    bands = shared.select("bucket", "rep").distinct()
    may = stored(_may_link(_mixed(bands, roots), counted, texts, size), "may-link")
    bands = stored(bands.join(may.select("rep"), "rep", "left_semi"), "may-link-bands")
    for pairs in (lambda m: _plausible(_typical_stars(m, may), may), lambda m: _open_pairs(m, may)):
        some = stored(pairs(stored(_mixed(bands, roots), "mixed")), "open-pairs")
        more = stored(confirmed(some, texts, size), "more-links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("root").alias("u"), "v").union(more))
    # an id of several sets may be no class's smallest, yet join classes
    named = classes.join(roots, classes.rep == roots.v, "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("root", "rep").alias("component"))
    return rows.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull(), True).otherwise(F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"),
    )


def keep_one_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose document is not its group's smallest id; repeated rows of a kept doc_id shrink to one."""
    kept = near_duplicates(docs, size).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)
