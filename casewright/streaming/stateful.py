"""The life of jobs as a stream: keyed state, leases that expire by event time, and events that come twice.

Per document: the step, status, attempts and lease of its job, and the ids of
events of late.  A lease ends by a timer, or when a later event of the document
comes first; either way at the same time, so that the outcome does not depend
on how the stream is cut into batches.  Late rows are dropped by the watermark.

events: document bigint, event bigint, kind string, at timestamp.  Kinds:
submit, claim, done, fail; others change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casewright.streaming.lifecycle import STEPS

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "document bigint, at_ms bigint, step string, status string, attempt int, cause string"
OPEN = ("PENDING", "RETRYING")
HOUR = 3_600_000


class Jobs(StatefulProcessor):
    """Transitions of the job of one document."""

    def __init__(self, lease_ms: int, keep_ms: int, most: int, graph: bool):
        self.lease_ms, self.keep_ms, self.most, self.graph = lease_ms, keep_ms, most, graph

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "step int, status string, attempt int, lease bigint")
        self.seen = handle.getValueState("seen", "pairs binary")

    def close(self) -> None:
        pass

    def _known(self) -> dict[int, int]:
        """Times of the events of late by their ids."""
        if not self.seen.exists():
            return {}
        pairs = np.frombuffer(bytes(self.seen.get()[0]), np.int64).reshape(-1, 2)
        return dict(pairs.tolist())

    def _keep(self, seen: dict[int, int]) -> None:
        """One write and one timer for all ids: the first hour in which one can go."""
        if not seen:
            self.seen.clear()
            return
        self.seen.update((np.array(list(seen.items()), np.int64).tobytes(),))
        self.handle.registerTimer(-(-(min(seen.values()) + self.keep_ms) // HOUR) * HOUR)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # each call to the state crosses to the JVM: one read and one write a document and batch, not one an event
        now = self.job.get() if self.job.exists() else None
        seen, before, out = self._known(), now, []
        many = len(seen)
        for event, kind, at in sorted(((int(e), k, int(t)) for b in rows for e, k, t in zip(b["event"], b["kind"], b["at_ms"], strict=True)), key=lambda r: (r[2], r[0])):
            if event in seen:
                continue
            seen[event] = at
            now = self._expired(now, at, out, key[0])
            after = self._after(now, kind, at)
            if after is not None:
                now = after
                out.append((key[0], at, STEPS[now[0]], now[1], now[2], kind))
        if len(seen) > many:
            self._keep(seen)
        if now is not None and now is not before:
            self.job.update(tuple(now))
            if now[3] is not None:
                self.handle.registerTimer(now[3])
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        seen = self._known()
        left = {k: v for k, v in seen.items() if v + self.keep_ms > at}
        if len(left) < len(seen):
            self._keep(left)
        if self.job.exists():
            before = self.job.get()
            after = self._expired(before, at, out, key[0])
            if after is not before:
                self.job.update(tuple(after))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["document", "at_ms", "step", "status", "attempt", "cause"]).astype({"document": "int64", "at_ms": "int64", "attempt": "int32"})

    def _failed(self, job: tuple) -> tuple:
        n = job[2] + 1
        return job[0], "DEAD_LETTER" if n >= self.most else "RETRYING", n, None

    def _expired(self, job: tuple | None, at: int, out: list, document: int) -> tuple | None:
        if job is None or job[1] != "PROCESSING" or job[3] is None or job[3] > at:
            return job
        lost = self._failed(job)
        out.append((document, job[3], STEPS[lost[0]], lost[1], lost[2], "expired"))
        return lost

    def _after(self, job: tuple | None, kind: str, at: int) -> tuple | None:
        """The job after an event; None where the event changes nothing."""
        status = job[1] if job is not None else None
        if kind == "submit" and status in (None, "DONE", "DEAD_LETTER"):
            return 0, "PENDING", 0, None
        if kind == "claim" and status in OPEN:
            return job[0], "PROCESSING", job[2], at + self.lease_ms
        if kind == "fail" and status == "PROCESSING":
            return self._failed(job)
        if kind == "done" and status == "PROCESSING":
            last = job[0] + 1 >= len(STEPS) or (STEPS[job[0]] == "EMBED" and not self.graph)
            return (job[0], "DONE", job[2], None) if last else (job[0] + 1, "PENDING", 0, None)
        return None


def transitions(events: DataFrame, delay: str = "1 hour", lease_minutes: int = 30, keep_hours: int = 24, most: int = 3, graph: bool = True) -> DataFrame:
    """Stream of (document, at, step, status, attempt, cause) of a stream of events."""
    rows = events.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    jobs = Jobs(lease_minutes * 60_000, keep_hours * HOUR, most, graph)
    out = rows.groupBy("document").transformWithStateInPandas(jobs, CHANGE, "Append", "EventTime")
    return out.select("document", F.timestamp_millis("at_ms").alias("at"), "step", "status", "attempt", "cause")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, with its state and output below ``folder``, and read the output.

    The same folder continues where an earlier run, also a broken one, ended.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
