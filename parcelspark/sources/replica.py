"""Tables that are replicated into a shared folder: rewritten by bucket of the key, committed by a journal.

A table's folder holds `data/<token>/__bucket=<n>`, files that are never changed, and `journal/<version>.json`, which
names the folder of each bucket. A run writes the buckets that it changes into a folder of its own and then renames its
journal entry into place. Readers see the version before or the one after; a run that fails leaves the one before, and
one that has been committed does nothing when it is run again. Where a rename replaces what is there, as in object
stores, a table may have one writer at a time; elsewhere the later of two writers raises and may be run again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import replicated
from .scratch import stage

BUCKETS, FILES = 64, 4
JOURNAL = "version long, run string, changed long, schema string, homes map<string,string>"


def _fs(spark: SparkSession, path: str):
    """(file system, function from a name under `path` to its path)."""
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: new(f"{path.rstrip('/')}/{name}")


def history(spark: SparkSession, path: str) -> DataFrame:
    """The journal: a row for each version; empty where there is no table yet."""
    fs, at = _fs(spark, path)
    if not fs.exists(at("journal")):
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).json(f"{path.rstrip('/')}/journal")


def latest(spark: SparkSession, path: str, version: int | None = None) -> Row | None:
    """The journal's last entry, or that of a version; None where there is none."""
    rows = history(spark, path)
    return (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()


def _rows(spark: SparkSession, path: str, entry: Row, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(entry.schema))
    homes = [f"{path.rstrip('/')}/{home}" for n, home in entry.homes.items() if only is None or int(n) in only]
    return spark.read.schema(schema).parquet(*sorted(homes)) if homes else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is, or as it was in an earlier version that vacuum() has kept."""
    entry = latest(spark, path, version)
    if entry is None:
        raise ValueError(f"no table in {path}" if version is None else f"no version {version} in {path}")
    return _rows(spark, path, entry)


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    fs, at = _fs(spark, path)
    draft, final = at(f"journal/.{uuid.uuid4().hex}"), at(f"journal/{entry['version']:08d}.json")
    out = fs.create(draft)
    out.write(json.dumps(entry).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another run has committed version {entry['version']} of {path}")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rewrite(rows: DataFrame, path: str, key: str, run: str, before: Row | None, touched: list[int], changed: int, buckets: int) -> None:
    """Writes `rows`, all that the touched buckets hold from now on, and commits."""
    spark, home = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    out = rows.withColumn("__bucket", _bucket(key, buckets)).repartition(F.col("__bucket"), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(FILES)))
    out.write.partitionBy("__bucket").parquet(f"{path.rstrip('/')}/{home}")
    fs, at = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at(home)) if f.isDirectory()]
    homes = {n: h for n, h in (before.homes if before else {}).items() if int(n) not in touched}
    homes |= {n.partition("=")[2]: f"{home}/{n}" for n in names if n.startswith("__bucket=")}
    _commit(spark, path, {"version": before.version + 1 if before else 1, "run": run, "changed": changed, "schema": rows.schema.json(), "homes": homes})


def replicate(new: DataFrame, path: str, key: str, run: str, buckets: int = BUCKETS) -> bool:
    """Puts `new`, one row a key, in place of the rows of their keys; True if that made a new version.

    Rows that the table holds as they are count for nothing: only buckets with changed rows are read again and written.
    Rows of a null key are added and never replaced. Columns must be comparable (no maps); `buckets` is the table's own
    for good. An empty `new` makes an empty table where there is none.
    """
    spark = new.sparkSession
    if history(spark, path).where(F.col("run") == run).head(1):
        return False
    before, fresh = latest(spark, path), new
    if before:
        old = _rows(spark, path, before)
        if set(old.columns) != set(new.columns):
            raise ValueError(f"columns {new.columns} are not the table's {old.columns}")
        fresh = new.select(old.columns).alias("n").join(old.alias("o"), reduce(lambda a, b: a & b, [F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in old.columns]), "left_anti")
    fresh = stage(fresh)
    per = {r.b: r.n for r in fresh.groupBy(_bucket(key, buckets).alias("b")).agg(F.count("*").alias("n")).collect()}  # a row a bucket
    if before and not per:
        return False
    rows = replicated(_rows(spark, path, before, list(per)), fresh, key) if before else fresh
    _rewrite(rows, path, key, run, before, list(per), sum(per.values()), buckets)
    return True


def purge(spark: SparkSession, path: str, old: Column, archived: DataFrame, key: str, run: str, buckets: int = BUCKETS) -> bool:
    """Takes the rows that are `old` out of the table, but only if the archive holds the key of each; True if it did."""
    before = latest(spark, path)
    if before is None or history(spark, path).where(F.col("run") == run).head(1):
        return False
    gone = _rows(spark, path, before).where(old)
    per = {r.b: r.n for r in gone.groupBy(_bucket(key, buckets).alias("b")).agg(F.count("*").alias("n")).collect()}
    if not per or gone.join(archived, key, "left_anti").head(1):
        return False
    rest = _rows(spark, path, before, list(per)).where(~F.coalesce(old, F.lit(False)))
    _rewrite(rest, path, key, run, before, list(per), sum(per.values()), buckets)
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the folders that none of the last `keep` versions names, those of failed runs too; no run may be under way."""
    fs, at = _fs(spark, path)
    if not fs.exists(at("data")):
        return 0
    kept = history(spark, path).orderBy(F.desc("version")).limit(keep).select("homes").collect()
    used = {home.split("/")[1] for r in kept for home in r.homes.values()}
    unused = [f.getPath() for f in fs.listStatus(at("data")) if f.getPath().getName() not in used]
    for p in unused:
        fs.delete(p, True)
    return len(unused)
