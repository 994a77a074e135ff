"""A folder that the driver and the executors share, for streams and their checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode without it, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="parcelspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_staged: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _staged:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already; the shared folder is then cleaned with it
            return


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, with a lineage that ends there. Kept until exit."""
    path = scratch(df.sparkSession, "staged")
    df.write.parquet(path)
    if not _staged:
        atexit.register(_clean)
    _staged.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
