"""The queue of files whose details are read, over restarts."""

from __future__ import annotations

from collections import Counter

import pytest

from fotolith.streaming import details


@pytest.fixture
def queue(spark, tmp_path):
    def run(rows, **how):
        """Adds events, runs the stream to their end from its checkpoint, and gives all work so far."""
        if rows:
            spark.createDataFrame(rows, details.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(details.EVENTS).parquet(str(tmp_path / "events"))
        work = details.details_queue(spark, stream, **how)
        going = work.writeStream.format("parquet").option("path", str(tmp_path / "work")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert going.awaitTermination(240) and going.exception() is None
        return Counter(tuple(r) for r in spark.read.schema(details.WORK).parquet(str(tmp_path / "work")).collect())

    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "false")  # a stream that ends with its data doesn't wait for timers
    yield run
    for n, value in before.items():
        spark.conf.set(n, value)


def test_nothing_is_lost_or_repeated_over_restarts(queue):
    files = [(f"/p/{k}", k, "seen", 10) for k in range(40)]
    asked = Counter((f"/p/{k}", 10, 1, 1) for k in range(40))
    assert queue(files + files[:5] + [(None, 1, "seen", 1)]) == asked
    # Half of the answers, seen again as they were: nothing more is handed out.
    assert queue([(f"/p/{k}", 50, "read" if k % 4 else "failed", 10) for k in range(0, 40, 2)] + [(f"/p/{k}", 60, "seen", 10) for k in range(40)]) == asked
    # Changed files go out again, failed ones and those whose old state is answered late too; a lost one that comes back as well.
    more = [(f"/p/{k}", 70, "seen", 11) for k in (0, 1, 2)] + [("/p/1", 71, "read", 10), ("/p/3", 72, "missing", None)]
    asked += Counter((f"/p/{k}", 11, 1, 1) for k in (0, 1, 2))
    assert queue(more) == asked
    asked += Counter([("/p/3", 10, 1, 1)])
    assert queue([("/p/3", 80, "seen", 10), ("/p/1", 81, "seen", 11)]) == asked
    # Details of a newer kind are wanted of every file that is seen.
    asked += Counter((f"/p/{k}", 10, 2, 1) for k in (10, 11))
    assert queue([("/p/10", 90, "seen", 10), ("/p/11", 90, "seen", 10)], version=2) == asked


def test_silent_readers_are_asked_again(queue):
    assert queue([("/a", 1, "seen", 5), ("/b", 1, "seen", 5)], lease_ms=1) == Counter([("/a", 5, 1, 1), ("/b", 5, 1, 1)])
    got = queue([("/a", 2, "read", 5), ("/c", 2, "seen", 5)], lease_ms=1)
    assert got[("/b", 5, 1, 2)] == 1 and ("/c", 5, 1, 1) in got and max(got.values()) == 1
    assert sum(n for (path, *_), n in got.items() if path == "/a") == 1
