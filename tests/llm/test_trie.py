"""The conversation trie against a plain model and its SQL."""

import collections
import hashlib
import random
import zlib

import pytest

from ridgeway.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, part int, up long"


def plain_rebuilt(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    own = collections.defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        out[c] = own.get(c - base, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.add((min(who), len(p), up, len(who), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def tables(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 230), -7, 512, 10**12]:
        n = rng.choice([1, 2, 3, 5, 9])
        rows += [(c, rng.choice([None, t, t, t, 2]), rng.choice([None, "user", "bot"]), rng.choice(["", None, "hi", "é\x00x", "hello, you"])) for t in range(n)]
    rows += [(3, 7, "user", "again")] * 40 + [(None, 1, "user", "lost")] * 3
    copy = [(t, "user", f"turn {t}") for t in range(300)]  # a long conversation with copies and beginnings of it
    for c, n in ((700, 300), (701, 300), (702, 300), (703, 120), (704, 7)):
        rows += [(c, *x) for x in copy[:n]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("members, held, stretch", [(1000, 1 << 18, 4096), (3, 4, 7)])
def test_nodes_equal_the_plain_model(spark, monkeypatch, members, held, stretch):
    monkeypatch.setattr(trie, "HELD", held)
    monkeypatch.setattr(trie, "STRETCH", stretch)
    monkeypatch.setattr(trie, "RUN_READ", 2)
    rows = tables(members)
    table = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], SCHEMA).repartition(5)
    turns, ids = trie.rebuilt(trie.positions(table))
    got = [tuple(r) for r in trie.nodes(turns, ids, members).collect()]
    want = plain_nodes(plain_rebuilt(rows))
    assert len(got) == len(want) and set(got) == want


def test_no_conversations(spark):
    turns, ids = trie.rebuilt(trie.positions(spark.createDataFrame([], SCHEMA)))
    assert trie.nodes(turns, ids).count() == 0


def test_messages_come_in_order_from_heap_and_runs(monkeypatch):
    monkeypatch.setattr(trie, "RUN_READ", 3)
    rng = random.Random(2)
    queue, want = trie.Messages(6), collections.Counter()
    for _ in range(500):
        key = (rng.randrange(5), rng.randrange(9))
        queue.push((*key, 1, 10))
        want[key] += 1
    assert len(queue.heap) <= 6 and queue.runs
    for key in sorted(want):
        assert queue.take(*key) == (want[key], 10 * want[key])
    assert queue.take(9, 9) == (0, 0) and not queue.heap and not queue.runs


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op11_prefix_trie(spark, folder).collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert got == set(duckdb.sql(queries.OP11_SQL).fetchall())
