"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The documents of a source are spread over shards; a shard's documents, in a seeded order, are one stream of words cut
into equal blocks. Blocks go to sources by the highest quotients of their targets, then within a source to its shards
the same way, so that each shard has an integer quota. A quota takes whole passes over the shard and, of the last pass,
as many blocks as remain, chosen by a seeded affine permutation of the block numbers.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stage

#: Words of a block; a shard of fewer than 64 such blocks is cut into 64, or into single words.
BLOCK_WORDS = 32
LEAST_BLOCKS = 64
DOCS_PER_SHARD = 4096
#: Primes; a shard has fewer blocks than the least of them.
STEPS = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Add `out`: of its group's `seats`, those that go to each row by the highest quotients votes / (2 k - 1).

    Only the seats in doubt are listed. With n rows in a group, votes scaled to seats - n and rounded never exceed
    the right result, and scaled to seats + n never fall short of it; between them lie at most 3 n seats.
    """
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    n, total = F.count("*").over(w), F.sum(votes).over(w)
    sure = df.select("*", n.alias("__n"), total.alias("__v"))
    share = F.col(votes) / F.greatest(F.col("__v"), F.lit(1e-300))
    low = F.round(share * F.greatest(F.lit(0), F.col(seats) - F.col("__n"))).cast("long")
    high = F.round(share * (F.col(seats) + F.col("__n"))).cast("long")
    sure = sure.withColumn("__low", low).withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    doubt = F.when(high > F.col("__low"), F.sequence(F.col("__low") + 1, F.greatest(high, F.col("__low") + 1)))
    listed = sure.withColumn("__k", F.explode_outer(doubt))
    quotient = F.when(F.col("__k").isNotNull(), F.col(votes) / (2 * F.col("__k") - 1))
    by = w.orderBy(quotient.desc_nulls_last(), *order)
    won = (F.row_number().over(by) <= F.col("__left")) & F.col("__k").isNotNull()
    listed = listed.withColumn("__won", won.cast("long"))
    kept = [c for c in df.columns]
    return listed.groupBy(*kept, "__low").agg(F.sum("__won").alias("__more")).select(
        *kept, (F.col("__low") + F.col("__more")).alias(out)
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Add `target` to (source, source_size): shares of the whole by weight, at most `cap` times the source's size.

    Sources take the weights in turn, in code point order, null last. What lies over a cap is shared again by weight
    among the others until none is over: sources are met in the order of cap to weight, so those stopped come first.
    One row per source, so the windows over all of them hold as many rows as there are sources.
    """
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("__w", weight).withColumn("__cap", F.when(F.col("source_size") > 0, F.col("source_size") * F.lit(float(cap))).otherwise(0.0))
    order = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    free_size = F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    free_weight = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    rows = rows.withColumn("__level", free_size / free_weight)
    # The level rises with each source that is stopped and falls behind the first that is not: that one's level holds.
    target = F.least(F.col("__cap"), F.col("__w") * F.max("__level").over(every))
    return rows.select(*sources.columns, target.alias("target"))


def plan(sizes: DataFrame, seed: int, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, bucket) shards with their quota: words, blocks, quota, source_size, target.

    sizes: (source, bucket, size), one row per document.
    """
    shards = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    fit = F.greatest(F.round(F.col("words") / BLOCK_WORDS), F.least(F.col("words"), F.lit(LEAST_BLOCKS))).cast("long")
    shards = stage(shards.withColumn("blocks", fit))
    sources = shards.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("__blocks"))
    sources = targets(sources, weights, cap).where("source_size > 0")  # one without words has its place, but no blocks
    votes = F.col("target") * F.col("__blocks") / F.col("source_size")
    sources = sources.withColumn("__votes", votes).withColumn("__all", F.round(F.sum("__votes").over(W.partitionBy(F.lit(0)))).cast("long"))
    sources = sainte_lague(sources, [], "__votes", "__all", ["source"], "__seats").withColumn("__name", F.col("source"))
    own = shards.where("words > 0").join(sources.drop("source"), F.col("source").eqNullSafe(F.col("__name")))
    own = own.select("source", "bucket", "words", "blocks", "source_size", "target", "__seats")
    own = sainte_lague(own, ["source", "source_size", "target", "__seats"], "blocks", "__seats", ["bucket"], "quota")
    most = F.floor(F.col("blocks") * F.lit(float(cap)) + 1e-9) if cap != inf else F.col("quota")
    return own.withColumn("quota", F.least(F.col("quota"), most.cast("long"))).drop("__seats")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 11,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, passes, spans.

    passes: whole times the document is taken; spans: word ranges [from, to) taken once more, in order. taken counts
    all words, repeats too. A null text has no words; a null source is a source, the last one. Rows that share a doc_id
    are documents of their own. Other columns, whatever their names, are ignored. The result depends on the rows and the seed, not on how they lie.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = stage(sizes)
    n = sizes.count()
    buckets = max(1, -(-n // DOCS_PER_SHARD))
    mark = F.xxhash64("doc_id", "size", F.lit(seed))
    sizes = sizes.withColumn("__mark", mark).withColumn("bucket", F.pmod("__mark", F.lit(buckets)).cast("int"))
    quotas = plan(sizes, seed, weights, cap).withColumnsRenamed({"source": "__source", "bucket": "__bucket"})
    rows = sizes.join(quotas, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bucket") == F.col("__bucket")), "left")
    stream = W.partitionBy("source", "bucket").orderBy(F.xxhash64("__mark", F.lit(1)), "doc_id", "size")
    rows = rows.withColumn("__end", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)))
    start, end, words, blocks = F.col("__end") - F.col("size"), F.col("__end"), F.col("words"), F.col("blocks")
    # Block b of the stream holds the words [b * words / blocks, (b + 1) * words / blocks), rounded down.
    edge = lambda b: F.floor(b * words / blocks).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor(start * blocks / words).cast("long") - 1)
    last = F.least(blocks - 1, F.floor(end * blocks / words).cast("long") + 1)
    rest, draw = F.pmod("quota", "blocks"), F.xxhash64("__source", "__bucket", F.lit(seed))
    # b -> (step * b + shift) mod blocks is a permutation, as a step is a prime above any number of blocks.
    step = F.array(*[F.lit(x) for x in STEPS])[F.pmod(draw, F.lit(len(STEPS))).cast("int")]
    shift = F.pmod(F.xxhash64(draw, F.lit(-1)), blocks)
    rows = rows.withColumn("__step", step).withColumn("__shift", shift)
    chosen = F.filter(
        F.sequence(first, F.greatest(first, last)),
        lambda b: (F.pmod(b * F.col("__step") + F.col("__shift"), blocks) < rest) & (edge(b + 1) > start) & (edge(b) < end),
    )
    spans = F.transform(
        chosen,
        lambda b: F.struct((F.greatest(edge(b), start) - start).alias("from"), (F.least(edge(b + 1), end) - start).alias("to")),
    )
    taken_any = (F.col("size") > 0) & words.isNotNull()
    rows = rows.withColumn("spans", F.when(taken_any, spans).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")))
    rows = rows.withColumn("passes", F.when(taken_any, F.floor(F.col("quota") / blocks)).otherwise(0).cast("long"))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return rows.select(
        "doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("passes") * F.col("size") + extra).alias("taken"), "passes", "spans",
    )


def mixed_documents(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mix as documents with the columns of `docs`: each whole pass is a row, and the spans of the last pass one more.

    The text of such a partial row is its words joined by single spaces; a column n_chars follows the text. Null and empty
    texts, which have no words, are not in the mix; rows that repeat are taken each as mix() says; an empty table gives an
    empty mix. All columns are carried, whatever their names.
    """
    keys = ["__id", "__source", "__size"]
    plan_ = mix(docs, seed=seed, **options).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
        F.col("passes").alias("__passes"), F.col("spans").alias("__spans"),
    )
    # Documents that agree in all keys may differ in their spans: they are matched in turn.
    def nth(*more: str):
        return F.row_number().over(W.partitionBy(*keys).orderBy(*more))

    plan_ = plan_.withColumn("__nth", nth("__spans", "__passes"))
    own = docs.columns
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"))
    rows = rows.withColumn("__nth", nth("row.text"))
    p = plan_.withColumnsRenamed({k: f"p{k}" for k in [*keys, "__nth"]})
    same = F.col("__nth") == F.col("p__nth")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p{k}"))
    rows = rows.join(p, same)
    text, none = F.col("row.text"), F.array().cast("array<string>")
    whole = F.transform(F.when(F.col("__passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("__passes"))).otherwise(F.array().cast("array<bigint>")), lambda _: text)
    # The outer transform binds the words: a text is split once, however many spans it has.
    part = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        lambda ws: F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(ws, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " "),
    )
    texts = F.concat(whole, F.when(F.size("__spans") > 0, part).otherwise(none))
    out = rows.select("row", F.explode(texts).alias("taken"))
    swap = {"text": F.col("taken")} | ({"n_chars": F.length("taken").cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    return out.select(*[swap.get(c, F.col("row")[c]).alias(c) for c in own])
