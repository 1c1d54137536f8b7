"""Written tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where the setting is unset and the executors are on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fotolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one operator's run. Executors that are lost cost no more than the tasks that were running: what is written stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/t{self.n}"

    def table(self, df: DataFrame, partitions: list[str] | None = None) -> DataFrame:
        """Writes df, by folders of the columns in partitions, and reads it again; the result's `_at` is its place, for drop()."""
        at = self.path()
        df.write.option("compression", "snappy").parquet(at, partitionBy=partitions)
        back = self.spark.read.schema(df.schema).parquet(at)
        back._at = at
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            self._delete(t._at)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all tables of the run but these."""
        kept = {t._at for t in tables}
        for k in range(1, self.n + 1):
            if f"{self.base}/t{k}" not in kept:
                self._delete(f"{self.base}/t{k}")

    def clear(self) -> None:
        """Deletes all tables of the run; called when the driver ends."""
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass

    def _delete(self, at: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes and rows of an Arrow batch at most, whichever operator runs.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes and rows of Arrow batches, the same for all operators; a setting of the user stays."""
    for name, standard, bound in (("maxBytesPerBatch", "67108864b", BATCH_BYTES), ("maxRecordsPerBatch", "10000", BATCH_ROWS)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == standard:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))
