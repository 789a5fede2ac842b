"""The index queue as a stream: one state per persona, with leases that expire, retries, and rebuilds that supersede what waits.

Commands (``COMMANDS``) come in as rows; every change of a queue row goes out. ``enqueue`` adds a row; ``claim`` takes the next ``n`` open ones (pending
or failed) by priority, age and id into work; ``complete`` and ``fail`` end the work; ``rebuild`` supersedes all open rows, unless
some are in work. Rows that no claim has taken stay in the state for later batches. A row in work for longer than the lease fails with one more
attempt: when a claim or rebuild of its persona comes, or, without one, when the watermark passes the lease's end (a timer).

State: the open rows of a persona, one entry each in a map, so a command reads or writes single entries and a claim streams through the
map with a heap of ``n``. Done rows leave the state. Commands of a batch are handled in the order of their time and number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEASE_S = 15 * 60
EXPIRED, SUPERSEDED = "mirror queue lease expired", "superseded by mirror rebuild"

#: kind: enqueue, claim, complete, fail or rebuild. at_s: seconds, in whose order (then seq) a persona's commands count. n: limit of a claim, priority of a new row.
COMMANDS = "persona_id bigint, at_s bigint, seq bigint, kind string, queue_id bigint, n bigint, message string"
CHANGES = "persona_id bigint, queue_id bigint, at_s bigint, status string, attempts bigint, message string"
ENTRY = T.StructType([T.StructField(x, T.LongType()) for x in ("priority", "created_s", "working", "attempts", "updated_s", "open_s")])
KEY = T.StructType([T.StructField("queue_id", T.LongType())])


class QueueProcessor(StatefulProcessor):
    """``backoff_s``: a failed row may be claimed again after so many seconds, doubled with every further attempt; 0: at once."""

    def __init__(self, lease_s: int = LEASE_S, backoff_s: int = 0):
        self.lease_s, self.backoff_s = lease_s, backoff_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", KEY, ENTRY)

    def _failed(self, entry: tuple, now: int) -> tuple:
        priority, created, _, attempts, _, _ = entry
        wait = self.backoff_s << min(attempts, 16) if self.backoff_s else 0
        return priority, created, 0, attempts + 1, now, now + wait

    def _expire(self, now: int) -> list[tuple]:
        """The leases that ended before ``now``, as changes."""
        stale = [(k, v) for k, v in self.rows.iterator() if v[2] and v[4] < now - self.lease_s]
        out = []
        for key, entry in stale:
            entry = self._failed(entry, now)
            self.rows.updateValue(key, entry)
            out.append((key[0], now, "failed", entry[3], EXPIRED))
        return out

    def _handle(self, c) -> list[tuple]:
        at, row = int(c.at_s), (int(c.queue_id),) if pd.notna(c.queue_id) else None
        held = self.rows.getValue(row) if row and self.rows.containsKey(row) else None
        if c.kind == "enqueue":
            if held is None and row:
                self.rows.updateValue(row, (int(c.n), at, 0, 0, at, at))
                return [(row[0], at, "pending", 0, None)]
        elif c.kind == "complete" and held:
            self.rows.removeKey(row)
            return [(row[0], at, "done", held[3], None)]
        elif c.kind == "fail" and held:
            entry = self._failed(held, at)
            self.rows.updateValue(row, entry)
            return [(row[0], at, "failed", entry[3], c.message)]
        elif c.kind == "claim":
            out = self._expire(at)
            free = ((v[0], v[1], k[0], v) for k, v in self.rows.iterator() if not v[2] and v[5] <= at)
            for _, _, queue_id, entry in heapq.nsmallest(int(c.n), free):
                self.rows.updateValue((queue_id,), (*entry[:2], 1, entry[3], at, at))
                self.handle.registerTimer((at + self.lease_s + 1) * 1000)
                out.append((queue_id, at, "processing", entry[3], None))
            return out
        elif c.kind == "rebuild":
            out = self._expire(at)
            waiting = [(k, v) for k, v in self.rows.iterator()]
            if any(v[2] for _, v in waiting):
                return [*out, (None, at, "refused", 0, "rows are being processed")]
            for key, entry in waiting:
                self.rows.removeKey(key)
                out.append((key[0], at, "done", entry[3], SUPERSEDED))
            return out
        return [(row[0] if row else None, at, "ignored", 0, c.kind)]

    def _changes(self, key, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            names = ["queue_id", "at_s", "status", "attempts", "message"]
            frame = pd.DataFrame(found, columns=names).astype({"queue_id": "Int64", "at_s": "int64", "attempts": "int64"})
            frame.insert(0, "persona_id", key[0])
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values(["at_s", "seq"], kind="stable")
        found = [x for c in commands.itertuples(index=False) for x in self._handle(c)]
        yield from self._changes(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._changes(key, self._expire(expiredTimerInfo.getExpiryTimeInMs() // 1000))

    def close(self) -> None:
        pass


def queue_changes(commands: DataFrame, delay: str = "0 seconds", lease_s: int = LEASE_S, backoff_s: int = 0) -> DataFrame:
    """The changes (``CHANGES``) that a stream of ``COMMANDS`` makes. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). Commands that come later than ``delay`` behind the latest are dropped, as all late rows are."""
    timed = commands.withColumn("at", F.timestamp_seconds("at_s")).withWatermark("at", delay)
    return timed.groupBy("persona_id").transformWithStateInPandas(
        statefulProcessor=QueueProcessor(lease_s, backoff_s), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )
