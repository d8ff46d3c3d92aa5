"""The life of documents as a stream: status events in, moves out; what the machine does not allow is told and changes nothing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import MOVES

MOVE = "document_id string, at timestamp, seq long, was string, status string, accepted boolean, reason string"


class Machine(StatefulProcessor):
    """One document's status and since when. With stuck_s, one that stays in indexing for so long (in event time) has failed."""

    def __init__(self, stuck_s: int | None):
        self.stuck_ms = stuck_s * 1000 if stuck_s else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "status string")

    def _watch(self, status: str | None, at: pd.Timestamp | None) -> None:
        if self.stuck_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status == "indexing" and at is not None:
            self.handle.registerTimer(int(at.value // 1_000_000) + self.stuck_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = self.held.get()[0] if self.held.exists() else None
        before, since, out = was, None, []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples():
            ok = r.status in MOVES[was]
            out.append((key[0], r.at, r.seq, was, r.status, ok, None if ok else "unknown status" if r.status not in MOVES else f"{was} may not become {r.status}"))
            if ok:
                was, since = r.status, r.at
        if was != before:
            self.held.update((was,))
        if since is not None:
            self._watch(was, since)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in MOVE.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists() and self.held.get()[0] == "indexing":
            self.held.update(("failed",))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([(key[0], at, None, "indexing", "failed", True, "stuck")], columns=[x.split()[0] for x in MOVE.split(", ")]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def status_moves(events: DataFrame, stuck_s: int | None = None, late: str = "1 hour") -> DataFrame:
    """events, a stream of (document_id, at, seq, status) -> a row for each, in MOVE's columns, and one for each document found stuck.

    Events of one batch are taken in the order of (at, seq), batches as they come. Rows without document_id or status go.
    The stream that reads it must run inside `state_store`.
    """
    rows = events.where("document_id is not null and status is not null").select("document_id", "at", "seq", "status")
    if stuck_s:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("document_id").transformWithStateInPandas(Machine(stuck_s), MOVE, "Append", "EventTime" if stuck_s else "None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that begin in it keep their state in RocksDB, as transformWithState needs; the session's own setting comes back after it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
