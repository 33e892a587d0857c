"""Prefix trie of conversations with subtree totals by time-forward processing.

A conversation is a sequence of turns (role, text).  Every distinct sequence of first d turns is a node of depth d; its members are
the conversations that start with it.  Steps:

1. ``positions`` numbers the turns: rows are range-partitioned by conversation and place, so a conversation of any length
   is dealt over tasks, and the few that cross a border get their offset from the counts before it.
2. A prefix is named by 128 bits: the exclusive or of two hashes of each of its turns with its place.  Running values
   are taken within stretches of ``STRETCH`` turns, then over stretches.  Members of a node are counted by partial aggregation.
3. Consecutive nodes with the same members are one link of the compressed trie, known by its smallest member and its number of
   members.  Within a link a node's totals differ from the link's by a difference of running lengths, so a conversation
   that nobody shares, however long, costs one link with known totals.
4. Links pass (leaves, saved) up by time-forward processing.  Round k takes the links of ``members``^(k-1) to ``members``^k members; a shard is a
   subtree whose top has a parent beyond that.  A task sorts its shards' links by reverse level order (Spark's sort, which spills),
   takes the messages for each link from a priority queue (which spills, too), and sends its totals to its parent.  What shard roots send is
   added up for each receiver and enters the next round.  Rounds grow with the logarithm of the number of conversations.

A shard has at most ``members``^k conversations and no more than twice ``members`` branching links for each; a chain of n links takes n * n / 2
turns to write, so no shard holds an unbounded share of the rows.

Definitions.  Rows with a null conv_id take no part.  A null role or text is empty.  Turns are ordered by turn, nulls first; ties by role, then by the
MD5 of the text; repeated rows are turns of their own.  Only the four columns are read.  No conversations give no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import stored

STRETCH = 4096
MEMBERS = 1000
HELD = 1 << 18
RUN_READ = 4096


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation, numbered from 1 in their order."""
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("tie", F.md5(F.encode("text", "UTF-8")))
    order = ["conv_id", "turn", "role", "tie"]
    # the last key deals out repeated rows, which are alike
    dealt = rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*order, "any").sortWithinPartitions(*order)
    dealt = stored(dealt.drop("any").withColumn("part", F.spark_partition_id()), "turns")
    place = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:], "text"))
    sizes = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.withColumn("ahead", F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    ahead = F.broadcast(ahead.filter("ahead IS NOT NULL").select("conv_id", "part", "ahead"))  # a part continues one conversation at most
    numbered = dealt.withColumn("place", place).join(ahead, ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) after each conversation c took its first h turns from conversation c - c % ``every``; h is the CRC-32 of c modulo ``most``.

    ``turns``: from ``positions``.  Where the other conversation is shorter, all its turns are taken; where there is none, none.
    """
    h = lambda c: (F.crc32(c.cast("string")) % most).cast("long")
    ids = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "conversations")
    bases = ids.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.least(F.col("n"), F.lit(most - 1)).alias("has"))
    base = F.col("conv_id") - F.col("conv_id") % every
    own = turns.filter(F.col("pos") > h(F.col("conv_id"))).withColumn("base", base).join(bases, "base", "left")
    own = own.select("conv_id", (F.col("pos") - h(F.col("conv_id")) + F.least(h(F.col("conv_id")), F.coalesce("has", F.lit(0)))).alias("pos"), "role", "text")
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    taken = ids.select("conv_id", base.alias("base"), h(F.col("conv_id")).alias("h")).filter("h > 0").join(first, "base").filter("pos <= h")
    return own.unionByName(taken.select("conv_id", "pos", "role", "text")), ids.select("conv_id")


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, len, upto): for each conversation its prefixes, what each extends, its last text's length and all lengths so far."""
    rows = turns.select("conv_id", F.col("pos").cast("long").alias("depth"), (F.col("pos") / STRETCH).cast("long").alias("stretch"), *(F.xxhash64(F.lit(k), "pos", "role", "text").alias(f"t{k}") for k in (1, 2)), F.char_length("text").cast("long").alias("len"))
    within = W.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("conv_id", "stretch").agg(*(F.bit_xor(f"t{k}").alias(f"x{k}") for k in (1, 2)), F.sum("len").alias("l"))
    before = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv_id", "stretch", *(F.bit_xor(f"x{k}").over(before).alias(f"b{k}") for k in (1, 2)), F.sum("l").over(before).alias("bl")).filter("bl IS NOT NULL")
    rows = rows.select("*", *(F.bit_xor(f"t{k}").over(within).alias(f"w{k}") for k in (1, 2)), F.sum("len").over(within).alias("wl"))
    rows = rows.join(totals, ["conv_id", "stretch"], "left")
    p = [F.col(f"w{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    rows = rows.select("conv_id", "depth", p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("t1")).alias("q1"), p[1].bitwiseXOR(F.col("t2")).alias("q2"), "len", (F.col("wl") + F.coalesce("bl", F.lit(0))).alias("upto"))
    zero = F.lit(0).cast("long")
    return rows.unionByName(ids.select("conv_id", *(zero.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "len", "upto"))))


class Messages:
    """Priority queue of (order, id, leaves, saved).  Beyond ``held`` entries the later half goes to a sorted run.

    Runs are scratch files of the task in Spark's own local directories, like the spills of its sorts: without a name, and gone with the task.
    """

    def __init__(self, held: int):
        self.held, self.heap, self.runs = held, [], []

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self.heap.sort()
            later = self.heap[self.held // 2 :]
            del self.heap[self.held // 2 :]
            self._advance(self._run(later))

    @staticmethod
    def _run(messages: list) -> Iterator[tuple]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
            for i in range(0, len(messages), RUN_READ):
                file.write(np.array(messages[i : i + RUN_READ], np.int64).tobytes())
            n, at = len(messages), 0
            del messages
            yield ()  # written
            while at < n:
                file.seek(32 * at)
                some = np.frombuffer(file.read(32 * RUN_READ), np.int64).reshape(-1, 4)
                at += len(some)
                yield from map(tuple, some.tolist())

    def _advance(self, run: Iterator[tuple]) -> None:
        if (first := next(run, None)) == ():
            first = next(run, None)
        if first is not None:
            heapq.heappush(self.runs, (first, id(run), run))

    def take(self, order: int, whose: int) -> tuple[int, int]:
        """The sum of all messages for the link that comes now."""
        leaves = saved = 0
        while True:
            if self.heap and self.heap[0][:2] == (order, whose):
                message = heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][:2] == (order, whose):
                message, _, run = heapq.heappop(self.runs)
                self._advance(run)
            else:
                return leaves, saved
            leaves, saved = leaves + message[2], saved + message[3]


def _forward(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Totals of links that come in reverse level order: bottom, conv_id, up, up_bottom, inner, leaves, saved."""
    queue = Messages(held)
    for batch in batches:
        leaves, saved = [], []
        for bottom, own, up, up_bottom, inner, n, s in zip(*(c.to_pylist() for c in batch.columns[:7])):
            more = queue.take(-bottom, own)
            leaves.append(n + more[0])
            saved.append(s + more[1])
            if inner:
                queue.push((-up_bottom, up, leaves[-1], saved[-1]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n"), batch.column("before"), batch.column("up"), batch.column("up_n"), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["conv_id", "n", "before", "up", "up_n", "leaves", "saved"])


def _totals(links: DataFrame, roots: DataFrame, rounds: int, members: int) -> DataFrame:
    """(conv_id, n, before, leaves, saved) of every link.  ``roots``: for each conversation its shard's top in each round."""
    columns = ["conv_id", "n", "before", "up", "up_n", "leaves", "saved"]
    done = links.filter("n = 1").withColumns({"leaves": F.lit(1).cast("long"), "saved": F.lit(0).cast("long")}).select(columns)
    everything, mail = done, done
    for k in range(1, rounds + 1):
        low, high = members ** (k - 1), members**k
        inbox = mail.filter(F.col("up_n") > low).groupBy(F.col("up").alias("to"), F.col("up_n").alias("to_n")).agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
        now = links.filter((F.col("n") > low) & (F.col("n") <= high))
        now = now.join(inbox, (F.col("conv_id") == F.col("to")) & (F.col("n") == F.col("to_n")), "left").join(roots.select(F.col("member").alias("conv_id"), F.col(f"root{k}").alias("shard")), "conv_id")
        now = now.select(
            "bottom", "conv_id", "up", (F.col("top") - 1).alias("up_bottom"), F.coalesce(F.col("up_n") <= high, F.lit(False)).alias("inner"),
            (F.col("leaf").cast("long") + F.coalesce("in_leaves", F.lit(0))).alias("leaves"), (F.col("own") + F.coalesce("in_saved", F.lit(0))).alias("saved"), "n", "before", "up_n", "shard",
        )
        out = now.repartition("shard").sortWithinPartitions(F.desc("bottom"), "conv_id").mapInArrow(partial(_forward, held=HELD), ", ".join(f"{c} bigint" for c in columns))
        out = stored(out, "subtrees")
        mail = mail.filter(F.col("up_n") > high).unionByName(out.filter(F.col("up_n") > high))
        everything = everything.unionByName(out)
    return everything.drop("up", "up_n")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, which come in order, joined by commas: (depth, conv_id, run, text)."""
    key, state = None, None
    for batch in batches:
        out = []
        for depth, own, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "text"))):
            if (depth, own) == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, own), hashlib.sha256()
            state.update(text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends_sha256"), x)) for x in out], _DIGESTS)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "conv_id", "ends_sha256"), (*key, state.hexdigest())))], _DIGESTS)


_DIGESTS = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of (depth, conv_id, member): ids ascending, joined by commas.

    Ids become texts where the range partitioning put them; a node that many conversations end at is read as one text for each range.
    """
    cut = ends.repartitionByRange("depth", "conv_id", "member").withColumn("run", F.spark_partition_id())
    texts = cut.groupBy("depth", "conv_id", "run").agg(F.array_sort(F.collect_list("member")).alias("ids"))
    texts = texts.select("depth", "conv_id", "run", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"))
    return texts.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "run").mapInArrow(_digest, "depth bigint, conv_id bigint, ends_sha256 string")


def _same(*pairs: tuple[str, str]) -> Column:
    on = F.lit(True)
    for a, b in pairs:
        on = on & (F.col(a) == F.col(b))
    return on


def nodes(turns: DataFrame, ids: DataFrame, members: int = MEMBERS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv_id, pos, role, text) numbered from 1; ``ids``: conv_id of all conversations, those without turns too, each once.
    """
    path = stored(paths(turns, ids), "paths")
    name = ["depth", "p1", "p2"]
    known = path.groupBy(*name).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("q1", "q2", "len", "upto")))
    known = stored(known, "nodes")
    above = known.select((F.col("depth") + 1).alias("d"), F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("node").alias("up"), F.col("n").alias("up_n"))
    linked = known.join(above, _same(("depth", "d"), ("q1", "a1"), ("q2", "a2")), "left")
    linked = stored(linked.select(F.col("node").alias("conv_id"), "depth", "n", "len", "upto", "up", "up_n"), "linked")

    n, rounds = ids.count(), 1
    while members**rounds < n:
        rounds += 1
    tops = (F.min(F.when(F.col("n") <= members**k, F.struct("depth", "node"))).alias(f"root{k}") for k in range(1, rounds + 1))
    each = path.select("conv_id", *name).join(known.select(*name, "node", "n"), name).groupBy(F.col("conv_id").alias("member")).agg(F.max(F.struct("depth", "node")).alias("end"), *tops)
    each = stored(each.select("member", "end", *(F.col(f"root{k}.node").alias(f"root{k}") for k in range(1, rounds + 1))), "members")

    links = linked.groupBy("conv_id", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), ((F.col("n") - 1) * F.sum("len")).alias("own"), F.min(F.col("upto") - F.col("len")).alias("before"), F.min_by("up", "depth").alias("up"), F.min_by("up_n", "depth").alias("up_n"),
    )
    links = stored(links, "links")
    parents = links.filter("up IS NOT NULL").select(F.col("up").alias("p"), F.col("up_n").alias("p_n"), F.lit(False).alias("no")).distinct()
    links = links.join(parents, _same(("conv_id", "p"), ("n", "p_n")), "left").withColumn("leaf", F.coalesce("no", F.lit(True))).drop("p", "p_n", "no")
    totals = _totals(stored(links, "leaf-links"), each, rounds, members).select(F.col("conv_id").alias("t"), F.col("n").alias("t_n"), "before", "leaves", "saved")

    children = linked.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = end_digests(each.select("end.depth", F.col("end.node").alias("conv_id"), "member"))
    out = linked.join(totals, _same(("conv_id", "t"), ("n", "t_n"))).join(children, ["depth", "conv_id"], "left").join(ends, ["depth", "conv_id"], "left")
    return out.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("upto") - F.col("len") - F.col("before"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
