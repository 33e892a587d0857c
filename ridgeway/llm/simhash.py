r"""Near-duplicate grouping by SimHash fingerprints: meet-in-the-middle ball hashing, verification, union-find.

A text (A-Z lower-cased) is cut into words outside ASCII white space and into shingles of four words, repeats included, joined by
single blanks; with fewer words the whole sequence is its one shingle.  Each shingle is hashed (XXH64 of its UTF-8, seed 42);
a bit of the fingerprint is set where over half of the hashes set it.  A text without words has fingerprint zero.
Fingerprints link at ``RADIUS`` = 4 or fewer differing bits; the grouping is the transitive closure of links.

Two fingerprints link exactly if some 64-bit word lies within two flips of both.  So every distinct fingerprint emits all
2,081 variants within two flips, variants are shuffled, and who meets there is a pair.  What crosses the shuffle is shorter than
that list, though: variants go to tasks by their lowest ``bits`` bits, and a fingerprint is sent once to each such key that its
variants fall on (1 + s + s(s-1)/2 keys for s bits), where the rest of the variants is made.  The number of bits follows the
number of fingerprints, so a key's variants stay about ``KEY_VARIANTS``.  Keys that still get over ``KEY_ROWS``
fingerprints, as in a crowd of near copies, are cut by further bits until none does; a full variant can't be
emitted by more than 2,081 fingerprints.  Within a task a key is cut in the same way, so that at most about ``MADE`` variants are held at a time.

All that emit one variant are tied to one of them instead of to each other, after their distance was verified; a task passes
on a spanning forest.  Nothing is approximate.

Definitions.  Rows with one doc_id count as one document that holds all their fingerprints.  A row with a null doc_id links with
nothing; its component is null.  A null text is empty.  An empty table gives an empty result.  Only doc_id and text are read.
A text is held whole in a task, however long, with some 40 bytes per byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .graph import components, local_forest
from .store import small_batches, stored

SHINGLE = 4
RADIUS = 4
HALF = RADIUS // 2
SEED = 42
WIDTH = 64
KEY_VARIANTS = 1 << 21
KEY_ROWS = 1 << 18
LEAST_BITS = 10
MORE_BITS = 6
MADE = 1 << 21
PIECE = 1 << 16

_U = np.uint64
# fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LANES = _U(0x0101010101010101)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``data[start : start + size]``; ``data`` (bytes) needs 8 more bytes behind the last of them."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    h = np.full(len(start), _U((seed + int(_P5)) % (1 << 64)))
    at, left = start.copy(), size.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [np.full(len(long), _U(x % (1 << 64))) for x in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
        stripes, go = size[long] // 32, np.arange(len(long))
        for k in range(int(stripes.max())):
            go = go[stripes[go] > k]
            base = start[long[go]] + 32 * k
            for j in range(4):
                acc[j][go] = _round(acc[j][go], eight[base + 8 * j])
        total = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            total = (total ^ _round(np.zeros(len(a), _U), a)) * _P1 + _P4
        h[long] = total
        at[long] += 32 * stripes
        left[long] -= 32 * stripes
    h += size.astype(_U)
    for k in range(3):
        go = np.flatnonzero(left >= 8 * (k + 1))
        h[go] = _rot(h[go] ^ _round(np.zeros(len(go), _U), eight[at[go] + 8 * k]), 27) * _P1 + _P4
    at += left // 8 * 8
    left %= 8
    go = np.flatnonzero(left >= 4)
    h[go] = _rot(h[go] ^ four[at[go]].astype(_U) * _P1, 23) * _P2 + _P3
    at[go] += 4
    left[go] -= 4
    for k in range(3):
        go = np.flatnonzero(left > k)
        h[go] = _rot(h[go] ^ data[at[go] + k].astype(_U) * _P5, 11) * _P1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def _bit_counts(h: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` (rows x 64) how many hashes of each owner set each bit; owners come in order.

    Bytes of a word count eight bits at once, over runs of at most 255 hashes.
    """
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    since = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    runs = np.flatnonzero(since % 255 == 0)
    for b in range(8):
        sums = np.add.reduceat((h >> _U(b)) & _LANES, runs)
        np.add.at(out[:, b::8], owner[runs], sums.astype("<u8").view(np.uint8).reshape(-1, 8))


def fingerprints(block: tb.Block, words: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row of ``block``."""
    block = block.lowered()
    row, start, end = block.words()
    counts, n = np.zeros((block.n, WIDTH), np.int64), np.zeros(block.n, np.int64)
    if len(row):
        size = end - start
        to = np.cumsum(size + 1)  # one past the blank that follows a word
        blank = np.zeros(to[-1], bool)
        blank[to - 1] = True
        text = np.full(to[-1] + 8, 32, np.uint8)
        text[: to[-1]][~blank] = block.data[~tb._SPACE[block.data]]
        begin, owned = to - size - 1, np.bincount(row, minlength=block.n)
        last = np.cumsum(owned)[row] - 1
        head = np.flatnonzero((np.arange(len(row)) + words - 1 <= last) | ((owned[row] < words) & (np.arange(len(row)) == last - owned[row] + 1)))
        stop = to[np.minimum(head + words - 1, last[head])] - 1
        for i in range(0, len(head), PIECE):
            some = head[i : i + PIECE]
            h = xxh64(text, begin[some], stop[i : i + PIECE] - begin[some])
            _bit_counts(h, row[some], counts)
        n = np.bincount(row[head], minlength=block.n)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch.column(1), tb.BLOCK_BYTES // 2):
            out = pa.array(fingerprints(block, words).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), out], names=["doc_id", "print"])


def prints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, print) per row; the 64 bits as a signed number."""
    return small_batches(docs.select("doc_id", "text")).mapInArrow(partial(_prints, words=words), "doc_id bigint, print bigint")


def flips(bits: list[int], most: int) -> list[int]:
    """All words with at most ``most`` bits set, all of them among ``bits``."""
    return [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _low(bits: int) -> int:
    return _signed((1 << bits) - 1)


def _sent(rows: DataFrame, done: int, bits: int) -> DataFrame:
    """(key, print): ``rows`` sent on to the keys of ``bits`` bits that their variants fall on; keys had ``done`` bits so far."""
    left = HALF - F.bit_count(F.col("print").bitwiseXOR(F.col("key")).bitwiseAND(F.lit(_low(done))))
    some = F.array(*(F.lit(_signed(m)) for m in flips(list(range(done, bits)), HALF)))
    if done:
        some = F.filter(some, lambda m: F.bit_count(m) <= left)
    rest = F.col("print").bitwiseAND(F.lit(_signed((1 << bits) - (1 << done))))
    return rows.select(F.explode(some).alias("flip"), "key", "print", rest.alias("rest")).select(F.col("key").bitwiseOR(F.col("rest").bitwiseXOR(F.col("flip"))).alias("key"), "print")


def _met(x: np.ndarray, left: np.ndarray, bits: list[int]) -> Iterator[np.ndarray]:
    """Pairs (first emitter, other emitter) of fingerprints ``x`` that emit a common variant, each with ``left`` flips among ``bits``."""
    made = sum(np.count_nonzero(left == r) * sum(math.comb(len(bits), k) for k in range(r + 1)) for r in range(HALF + 1))
    if len(x) < 2:
        return
    if made > MADE and bits:
        now, later = bits[:4], bits[4:]
        mask = _U(sum(1 << b for b in now))
        for word in flips(now, len(now)):
            used = np.bitwise_count((x ^ _U(word)) & mask).astype(np.int64)
            some = used <= left
            yield from _met(x[some], left[some] - used[some], later)
        return
    whose = [np.flatnonzero(left == r) for r in range(HALF + 1)]
    rest = _U(sum(1 << b for b in bits))
    masks = [np.array(flips(bits, r), _U) for r in range(HALF + 1)]
    variants = np.concatenate([((x[i] & rest)[:, None] ^ m[None, :]).ravel() for i, m in zip(whose, masks)])
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        where = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
        hit = np.flatnonzero(twice[where] == variants)
        owner = np.concatenate([np.repeat(i, len(m)) for i, m in zip(whose, masks)])[hit]
        order = np.lexsort((owner, where[hit]))
        where, owner = where[hit][order], owner[order]
        new = np.concatenate([[True], where[1:] != where[:-1]])
        head = owner[new][np.cumsum(new) - 1]
        both = np.unique(head * len(x) + owner)
        yield np.stack([x[both // len(x)], x[both % len(x)]], axis=1)


def _collide(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of (key, print) in order of key: a spanning forest of the pairs that meet, as (print, print)."""

    def groups() -> Iterator[tuple[int, np.ndarray]]:
        key, have = None, []
        for batch in batches:
            keys, words = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    if have and keys[a] != key:
                        yield key, np.concatenate(have)
                        have = []
                    key = keys[a]
                    have.append(words[a:b])
        if have:
            yield key, np.concatenate(have)

    def edges() -> Iterator[pa.RecordBatch]:
        for key, words in groups():
            x = np.unique(words.view(_U))
            left = HALF - np.bitwise_count((x ^ np.int64(key).astype(_U)) & _U((1 << bits) - 1)).astype(np.int64)
            for pairs in _met(x, left, list(range(bits, WIDTH))):
                pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(_U).view(np.int64)) for i in (0, 1)], names=["u", "v"])

    yield from local_forest(edges())


def links(words: DataFrame) -> DataFrame:
    """(u, v) of distinct fingerprints (column ``print``): pairs within ``RADIUS`` that connect all that such pairs connect."""
    n = words.count()
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n) * len(flips(list(range(WIDTH)), HALF)) / KEY_VARIANTS)))
    rows, done, out = words.select(F.lit(0).cast("long").alias("key"), "print"), 0, []
    while True:
        sent = _sent(rows, done, bits)
        crowded = sent.groupBy("key").count().filter(F.col("count") > KEY_ROWS).select("key") if bits < WIDTH else None
        crowded = stored(crowded, "crowded-keys") if crowded is not None else None
        last = crowded is None or crowded.isEmpty()
        kept = sent if last else sent.join(crowded, "key", "left_anti")
        out.append(kept.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_collide, bits=bits), "u bigint, v bigint"))
        if last:
            break
        rows, done = stored(sent.join(crowded, "key", "left_semi"), "crowds"), bits
        bits = min(WIDTH, bits + MORE_BITS)
    edges = out[0]
    for more in out[1:]:
        edges = edges.union(more)
    return edges


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, print (64 bits as a signed number), component_id (smallest doc_id of its group)."""
    rows = stored(prints(docs, words), "prints")
    named = rows.filter("doc_id IS NOT NULL")
    held = stored(named.groupBy("print").agg(F.min("doc_id").alias("rep")), "distinct-prints")
    # an id with several fingerprints ties them
    several = named.groupBy("doc_id").agg(F.min("print").alias("u"), F.max("print").alias("top")).filter("u <> top").select("doc_id", "u")
    tied = named.join(several, "doc_id").select("u", F.col("print").alias("v")).filter("u <> v").distinct()
    roots = components(links(held.select("print")).union(tied))
    tops = held.join(roots, held.print == roots.v, "left").select(F.col("print").alias("own"), "rep", F.coalesce("root", "print").alias("root"))
    least = tops.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = stored(tops.join(least, "root").select("own", "component_id"), "print-classes")
    return rows.join(classes, rows.print == classes.own, "left").select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
