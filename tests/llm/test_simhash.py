"""SimHash fingerprints and ball hashing against plain loops."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ridgeway.llm import simhash
from ridgeway.llm import textblocks as tb

SCHEMA = "doc_id long, text string, print long, key long, rep long"


def plain_print(text):
    low = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = low.split()
    cut = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in cut]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{print: set of prints} by flooding."""
    left, out = set(prints), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        out |= dict.fromkeys(group, group)
    return out


def test_xxh64_of_every_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3008, dtype=np.uint8)
    size = np.array([*range(150), 1000, 2000])
    start = rng.integers(0, 1000, len(size))
    for seed in (0, 42, 2**63):
        assert simhash.xxh64(data, start, size, seed).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(start, size)]


def test_fingerprints_of_odd_and_long_texts(monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " \n ", "One", "one\t\vTWO  three", "é É x\x00y z", "w" * 5000, "same " * 900]
    texts += [" ".join(rng.choice(["Alpha", "be", "ça", "d" * 40]) + "\n" * rng.randrange(2) for _ in range(rng.randrange(60))) for _ in range(40)]
    texts.append(" ".join(str(rng.random()) for _ in range(30_000)))
    for piece in (simhash.PIECE, 7):
        monkeypatch.setattr(simhash, "PIECE", piece)
        some = texts if piece > 7 else texts[:-1]
        assert [int(x) for b in tb.blocks(pa.array(some), 1000) for x in simhash.fingerprints(b)] == [plain_print(t) for t in some]


def crowd(rng, n, centre, most):
    return {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(most + 1))) for _ in range(n)}


def test_ball_hashing_loses_no_link(spark, monkeypatch):
    """Crowds, chains and strangers; keys are cut further when few fingerprints crowd them."""
    rng = random.Random(11)
    words = {0, 2**64 - 1, 1 << 63} | {rng.getrandbits(64) for _ in range(150)}
    words |= crowd(rng, 150, rng.getrandbits(64), 5) | crowd(rng, 40, 0, 3)
    x = rng.getrandbits(64)
    for _ in range(20):  # a chain of steps of exactly four bits, and a step of five
        words.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
    words.add(x ^ 0b11111)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(signed(w),) for w in words], "print long")
    want = {frozenset(g) for g in plain_components(words).values()}
    for rows, made in ((simhash.KEY_ROWS, simhash.MADE), (12, 3000)):
        monkeypatch.setattr(simhash, "KEY_ROWS", rows)
        monkeypatch.setattr(simhash, "MADE", made)
        got = plain_components_of_edges(words, simhash.links(table).collect())
        assert got == want


def plain_components_of_edges(words, edges):
    root = {w: w for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        assert (u ^ v) % 2**64 in range(2**64)
        root[find(u % 2**64)] = find(v % 2**64)
    out = {}
    for w in words:
        out.setdefault(find(w), set()).add(w)
    return {frozenset(g) for g in out.values()}


def test_groups_of_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "\n \t"), (4, "Only three words"), (5, "only three  WORDS"), (None, "only three words"), (9, "nine"), (9, "only three words"), (9, "nine")]
    for k in range(30):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(400)] = rng.choice(words)
        rows.append((100 - k, " ".join(own)))
    rows += [(200 + k, " ".join(rng.choice(words) for _ in range(30))) for k in range(20)]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", F.col("print"), "component_id").collect()), key=str)
    groups = plain_components([plain_print(t) for _, t in rows if _ is not None])
    ids = {}
    for i, t in rows:
        if i is not None:
            ids.setdefault(i, set()).update(groups[plain_print(t)])
    changed = True
    while changed:  # ids with several fingerprints tie groups
        changed = False
        for a in ids.values():
            for b in ids.values():
                if a & b and a != b:
                    a |= b
                    b |= a
                    changed = True
    least = {i: min(j for j in ids if ids[j] & ids[i]) for i in ids}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert got == sorted(((i, signed(plain_print(t)), least.get(i)) for i, t in rows), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
