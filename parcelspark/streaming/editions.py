"""Editions taken in as their files arrive: each file once, later ones in place of earlier ones of their date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import replica
from ..sources.files import EDITION


def follow(spark: SparkSession, folder: str, path: str) -> None:
    """Takes the edition files that have come into `folder`, at any depth, since the last call.

    The table at `path`/editions has (date, file, body), of several files of a date in a call the one last by name; files
    that are no JSON object with a date are listed in `path`/refused; Spark reads no row from an empty file. A call that fails is taken up where it stopped:
    its batch carries the same number again, and a table that has it already leaves it out.
    """
    def step(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("date", F.get_json_object("value", "$.date")).persist()
        good = rows.where("date is not null").groupBy("date").agg(F.max_by(F.struct("file", "value"), "file").alias("e"))
        replica.replicate(good.select("date", "e.file", F.col("e.value").alias("body")), f"{path}/editions", "date", f"batch-{n}")
        replica.replicate(rows.where("date is null").select("file"), f"{path}/refused", "file", f"batch-{n}")
        rows.unpersist()

    files = spark.readStream.option("recursiveFileLookup", "true").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    files.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def followed(spark: SparkSession, path: str) -> DataFrame:
    """The editions taken in so far, with the fields of an edition."""
    return replica.read(spark, f"{path}/editions").select("file", F.from_json("body", EDITION).alias("e")).select("file", "e.*")
