"""A queue of files whose details are to be read, as a stream with state by file: what was asked for, what came back, what failed.

It resumes from its checkpoint: a file that was handed out isn't handed out again unless it changes, its reader stays silent for longer than
a lease, or details of a newer kind are wanted; one that couldn't be read waits for a change.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the stream hands out: a file as it was seen, and the how manieth time it is handed out as such.
WORK = "path string, modified_ns long, version int, attempt int"
#: What it is told, in the order of `at` within a batch: seen (with modified_ns), read, failed (both with the modified_ns that was read) or missing.
EVENTS = "path string, at long, event string, modified_ns long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Details(StatefulProcessor):
    """State of a file: modified_ns and version of what was handed out last, its status (asked, done, failed) and attempts."""

    def __init__(self, version: int, lease_ms: int):
        self.version, self.lease_ms = version, lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "modified_ns long, version int, status string, attempts int")

    def _timers(self, due: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.file.get() if self.file.exists() else None
        modified, version, status, attempts = held or (None, 0, None, 0)
        asked = False
        for row in sorted(rows, key=lambda r: (r.at, r.event)):
            if row.event == "missing":
                modified, version, status, attempts, asked = None, 0, None, 0, False
            elif row.event == "seen":
                if status is None or row.modified_ns != modified or version < self.version:
                    modified, version, status, attempts, asked = row.modified_ns, self.version, "asked", 1, True
            elif status is not None and row.modified_ns == modified:  # an answer about an older state of the file doesn't count
                status, asked = ("done" if row.event == "read" else "failed"), False
        if status is None:
            self.file.clear()
            self._timers(None)
            return
        self.file.update((modified, version, status, attempts))
        if status != "asked":
            self._timers(None)
        elif asked:
            self._timers(timerValues.getCurrentProcessingTimeInMs() + self.lease_ms)
            yield Row(path=key[0], modified_ns=modified, version=version, attempt=attempts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.file.exists():
            return
        modified, version, status, attempts = self.file.get()
        if status == "asked":
            self.file.update((modified, version, status, attempts + 1))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.lease_ms)
            yield Row(path=key[0], modified_ns=modified, version=version, attempt=attempts + 1)

    def close(self) -> None:
        pass


def details_queue(spark: SparkSession, events: DataFrame, version: int = 1, lease_ms: int = 600_000) -> DataFrame:
    """A stream of WORK from a stream of EVENTS; state is kept by path. Null paths are left out, rows that repeat change nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    held = events.filter("path IS NOT NULL AND event IS NOT NULL").select("path", "at", "event", "modified_ns")
    return held.groupBy("path").transformWithState(statefulProcessor=Details(version, lease_ms), outputStructType=WORK, outputMode="Append", timeMode="ProcessingTime")
