"""Small tables between the rounds of a loop, written to the folder that the cluster names in spark.checkpoint.dir and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """df as a table that outlives executors and cuts its plan; deleted when the driver ends. Where the setting is unset, as in tests, a local folder serves a local master.

    group_bytes: the size of row groups, where rows are large: they are held, written and read by groups.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fotolith-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.size": str(group_bytes)} if group_bytes else {})).parquet(at)

    def clear() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass

    atexit.register(clear)
    return spark.read.schema(df.schema).parquet(at)
