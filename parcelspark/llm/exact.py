"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text, its runs of white space made one space, is cut where its own content says so. Each chunk gets a 64-bit
identifier, and a text becomes its recipe, the ordered list of identifiers. A chunk's characters are moved once, to
verify that an identifier stands for one content: equal chunks are combined before that shuffle, and whole documents
are never moved. Texts with equal recipes are equal; should identifiers collide (the check finds them), the texts
holding such a chunk are compared by their characters as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage

#: A chunk has at least 128 and at most 2,048 characters. It ends after a word that ends in one of a few letters or in one
#: beyond ASCII, or, in scripts that have no spaces, after a mark or one of their commonest characters.
CHUNK = r"(?s).{128,2046}?(?:(?:[dnstr]|[^\x00-\x7F])\x20|[。．，、！？；：…的一是了不のはをにがでกานรา])|.{1,2048}"
#: Most colliding identifiers that go into the plan as values; beyond, all texts are compared by their characters too.
MOST_COLLIDING = 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def colliding(parts: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content of the chunks (part)."""
    distinct = parts.groupBy(F.xxhash64("part").alias("id"), "part").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal one another. keep_id is the least doc_id of the equal texts; rows
    without a doc_id are counted but stay only where no row of their group has one. Rows that repeat the kept doc_id
    with an equal text are all marked kept. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    bad = [r[0] for r in colliding(rows.select(F.explode(chunks(F.col("text"))).alias("part"))).limit(MOST_COLLIDING + 1).collect()]
    recipe = F.transform(chunks(F.col("text")), lambda c: F.xxhash64(c)).alias("recipe")
    rows = rows.select("doc_id", recipe, F.sha2("text", 256).alias("text_sha256"), *([F.col("text")] if bad else []))
    if not bad:
        rows = rows.withColumn("exact", F.lit(""))
    elif len(bad) > MOST_COLLIDING:
        rows = rows.withColumn("exact", F.col("text")).drop("text")
    else:
        unsure = F.arrays_overlap("recipe", F.array(*[F.lit(x) for x in bad]))
        rows = rows.withColumn("exact", F.when(unsure, F.col("text")).otherwise("")).drop("text")
    rows = stage(rows)  # the texts are read no more
    # A hot recipe is spread over salts: combined per salt, then per recipe, and joined back per salt.
    salts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(salts)).cast("int"))
    part = rows.groupBy("recipe", "exact", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    whole = part.groupBy("recipe", "exact").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    spread = part.select("recipe", "exact", "salt").join(whole, ["recipe", "exact"])
    return rows.join(spread, ["recipe", "exact", "salt"]).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), "text_sha256",
    )
