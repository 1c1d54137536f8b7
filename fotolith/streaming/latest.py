"""Streaming forms: the latest event of each key, and indexing by micro-batches. Both are additions to what the catalogue does in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import outcomes


def latest_by_key(events: DataFrame, key: str, at: str, delay: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """The last event of each key in each span of time; events later than `delay` are dropped with their state."""
    rest = [c for c in events.columns if c not in (key, at)]
    held = events.withWatermark(at, delay).groupBy(F.window(at, span), key)
    return held.agg(F.max(at).alias(at), F.max_by(F.struct(*rest), F.col(at)).alias("e")).select(key, at, "e.*")


def index_stream(spark: SparkSession, manifests: DataFrame, known: Callable[[], DataFrame], present: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Compares each micro-batch of manifests (path, size, modified_ns, fingerprint) with what is known by then.

    A batch holds some files of the folder, so files outside it aren't gone for that: present gives the paths (path) that still exist, and only
    a file that isn't among them can have moved. Of the known files those are compared that share a path, or size and fingerprint, with the batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        held = known()
        by_path = held.join(df.select("path"), "path", "left_semi")
        by_bytes = held.join(df.select("size", "fingerprint").distinct(), ["size", "fingerprint"], "left_semi").join(df.select("path"), "path", "left_anti")
        asked = by_path.unionByName(by_bytes.select(*by_path.columns))
        sink(outcomes(asked, df, present()).filter("outcome <> 'missing'"), number)

    return manifests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
