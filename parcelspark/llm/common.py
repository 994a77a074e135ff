"""What several of the corpus operators share: word expressions, shared storage, size-checked semi-joins, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Most rows of a key table that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="parcelspark-")
    spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/parcelspark/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for `df`, once all that reads it has been written itself."""
    _delete(df.sparkSession, df._staged)
    _written.remove((df.sparkSession, df._staged))


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already; the shared folder is then cleaned with it
            return


def by_key(df: DataFrame, groups: int, key: str) -> DataFrame:
    """`df` dealt by an integer key from 0 to `groups` - 1 to a task for each, so that no task's share grows with the input."""
    return df.repartitionById(groups, F.col(key))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the built-in lower(), the others a translation."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def keep_ids(docs: DataFrame, keys: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi- or anti-join on a written key table; broadcast only if it has at most `limit` rows, shuffled otherwise."""
    few = len(keys.limit(limit + 1).groupBy().count().where(F.col("count") <= limit).head(1)) == 1
    marked = keys.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)])
    same = None
    for i, c in enumerate(on):
        part = docs[c].eqNullSafe(marked[f"__k{i}"])
        same = part if same is None else same & part
    return docs.join(F.broadcast(marked) if few else marked, same, how)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component the least node reachable.

    Minimum labels travel along the edges and are then replaced by their own label's label, so the rounds grow with
    the logarithm of the longest path. Aggregation combines before the shuffle, so a hub costs no single task.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = stage(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct())
    labels = stage(links.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        seen = (
            links.join(labels.select(F.col("node").alias("y"), "component"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(seen, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = stage(step.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = step.select("node", "component")
        if not step.where("component <> was").head(1):
            return labels
