"""The single-slot priority queue: batch replay, streaming state, and a client admission bucket; the re-index stream.

Effective priority is priority + 0.2 * seconds waited; as all waiters age alike their order is that of the static key
priority - 0.2 * arrival.  One request is served at a time, without preemption; ties go to the smaller sequence number.
At most ten wait; abandoned waiters leave before the count is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import catalogue, stage

AGEING = 0.2
CAPACITY = 10
RESULT = "queue_id bigint, seq bigint, outcome string, start double, finish double, depth int"


class Slot:
    """One queue's state: who waits, and until when the slot is taken.  Times are seconds."""

    def __init__(self, waiting: list | None = None, busy_until: float = float("-inf")):
        self.waiting = waiting or []  # heap of (-key, seq, service, depth)
        self.busy_until = busy_until

    def advance(self, now: float) -> Iterator[tuple[int, float, float, int]]:
        """Requests that start before or at ``now``."""
        while self.waiting and self.busy_until <= now:
            _, seq, service, depth = heapq.heappop(self.waiting)
            start, self.busy_until = self.busy_until, self.busy_until + service
            yield seq, start, self.busy_until, depth

    def arrive(self, now: float, seq: int, priority: float, service: float) -> tuple[str, float, float, int] | None:
        """The outcome, if it is settled at once."""
        if now >= self.busy_until and not self.waiting:
            self.busy_until = now + service
            return "served", now, self.busy_until, 0
        depth = len(self.waiting) + 1
        if len(self.waiting) >= CAPACITY:
            return "rejected", now, now, depth
        heapq.heappush(self.waiting, (-(priority - AGEING * now), seq, service, depth))
        return None

    def drain(self) -> Iterator[tuple[int, float, float, int]]:
        yield from self.advance(float("inf"))


def _replay(slot: Slot, queue: int, rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Outcomes of a queue's arrivals.  Who hangs up (``abandoned``) gives up at once when it has to wait; a free slot it gets."""
    out = []
    for r in rows.sort_values(["arrival", "seq"]).itertuples():
        now = r.arrival / 1e6
        out += [(queue, s, "served", a, b, d) for s, a, b, d in slot.advance(now)]
        waits = now < slot.busy_until or slot.waiting
        if r.abandoned and waits and len(slot.waiting) < CAPACITY:
            out.append((queue, r.seq, "abandoned", now, now, len(slot.waiting) + 1))
        elif settled := slot.arrive(now, r.seq, r.priority, r.service):
            out.append((queue, r.seq, *settled))
    if last:
        out += [(queue, s, "served", a, b, d) for s, a, b, d in slot.drain()]
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def schedule(requests: DataFrame) -> DataFrame:
    """Replay of (queue_id, seq, arrival in microseconds, priority, service, abandoned): one row per request."""
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _replay(Slot(), key[0], rows, True)

    return requests.groupBy("queue_id").applyInPandas(one, RESULT)


class QueueProcessor(StatefulProcessor):
    """The same queue over a stream: what waits and until when the slot is taken is kept between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slot", "busy double, waiting array<struct<k:double,seq:bigint,service:double,depth:int>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slot = Slot()
        if self.state.exists():
            busy, waiting = self.state.get()
            slot = Slot([(w[0], w[1], w[2], w[3]) for w in waiting], busy)
            heapq.heapify(slot.waiting)
        out = _replay(slot, int(key[0]), pd.concat(list(rows)), False)
        self.state.update((slot.busy_until, [tuple(w) for w in slot.waiting]))
        yield out

    def close(self) -> None:
        pass


def schedule_stream(requests: DataFrame) -> DataFrame:
    """Streaming form of ``schedule``; needs the RocksDB state store.  Waiters stay in state until later arrivals let them start."""
    return requests.groupBy("queue_id").transformWithStateInPandas(QueueProcessor(), RESULT, "Append", "None")


def admission(requests: DataFrame, per_minute: float = 20.0, burst: int = 10) -> DataFrame:
    """(client, seq, admitted): a leaky bucket per client, with a burst that isn't delayed.  ``requests``: client, seq, arrival."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, level, before, out = rows.sort_values(["arrival", "seq"]), 0.0, None, []
        for t in rows["arrival"] / 1e6:
            drained = 0.0 if before is None else (t - before) * per_minute / 60.0
            now = max(0.0, level - drained)
            ok = now <= burst
            if ok:
                level, before = now + 1.0, t
            out.append(ok)
        return pd.DataFrame({"client": rows["client"], "seq": rows["seq"], "admitted": out})

    return requests.groupBy("client").applyInPandas(one, "client bigint, seq bigint, admitted boolean")


def reindex(spark, folder: str, layers: DataFrame, table: str, checkpoint: str, every: str | None = None):
    """Keeps the level index current while tiles are built: paths (``location``) that appear as Parquet in ``folder`` replace what ``table`` held of the same tile.

    Each batch rewrites the levels it touches and no other, so a batch that runs again after a crash changes nothing.  With ``every`` ("30 minutes")
    it goes on at that interval; without, it takes all there is and stops, which is the last pass after a build.
    """
    tile = ["level", "source_id", "tx", "ty"]

    def replace(batch: DataFrame, _: int) -> None:
        fresh = catalogue.level_index(catalogue.tiles_of(batch), layers)
        fresh = stage.stored(fresh.groupBy(*tile).agg(F.max_by(F.struct(*fresh.columns), "location").alias("row")).select("row.*"), "fresh-tiles")
        if fresh.isEmpty():
            return
        new = fresh
        if stage.exists(spark, table):
            old = spark.read.schema(fresh.schema).parquet(table).join(fresh.select("level").distinct(), "level", "left_semi")
            new = old.join(fresh.select(*tile), tile, "left_anti").unionByName(fresh)
        catalogue.write_index(stage.stored(new, "level-index"), table)  # stored: what is read is overwritten

    stream = spark.readStream.schema("location string").parquet(folder).writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
