"""Benchmark decontamination in DataFrame operations only: a broadcast hash set of normalised test n-grams.

Items and documents are lower-cased (A-Z) and cut into words. The windows of the items make a hash set that is broadcast
when its counted size is bounded, and joined by shuffle otherwise. A document's windows are scanned segment by segment,
so a very long text is never expanded at once. A filter of a byte a slot, made of the first words of all windows of the
items, is in the plan: only places that pass it become windows, whether these then meet the set by broadcast or by
shuffle. A window matches by its characters,
so a hit is verified as it is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_ids, stage

#: Runs of letters and digits of ASCII and of all other characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of the benchmark that are broadcast at most (about 100 bytes each).
BROADCAST_WINDOWS = 300_000
SEGMENT = 2048
#: First words of a window (all, if it has fewer) that the filter looks at, and slots of the filter for each window.
LEAD, SLOTS = 3, 16
#: The filter's slots at most, a byte each; beyond a million windows more places pass it.
MOST_SLOTS = 1 << 24


_BITS = [bytes(x >> k & 1 for k in range(8)) for x in range(256)]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(ws: Column, n: int) -> Column:
    """All windows of n words, joined by a space (which no word contains)."""
    last = F.size(ws) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(ws, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def slot(word_at, lead: int, slots: int) -> Column:
    """The filter's slot for `lead` words, word_at(0) and on."""
    return F.pmod(F.xxhash64(*[word_at(k) for k in range(lead)]), F.lit(slots)).cast("int")


def lead_filter(windows: DataFrame, slots: int) -> bytes:
    """A byte for each slot, 1 where a window's first words fall. Slots come to the driver as bitmaps of 32,768."""
    ws = F.split("gram", " ")
    lead = F.least("len", F.lit(LEAD))
    own = F.coalesce(*[F.when(lead == n, slot(lambda k: ws[k], n, slots)) for n in range(1, LEAD + 1)])
    rows = windows.select(own.cast("long").alias("slot"))
    maps = rows.groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % 32_768).alias("bits")).collect()
    out = bytearray(slots)
    for row in maps:
        begin = row.part << 15
        out[begin : begin + 32_768] = b"".join([_BITS[x] for x in row.bits])[: slots - begin]
    return bytes(out)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(gram, len, items): each distinct window of the items and the sorted ids, as strings, of those that have it.

    An item of fewer words than the window, but not none, is one window. Null ids are left out of `items`.
    """
    ws = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws"))
    size = F.size("ws")
    rows = ws.where(size > 0).select(
        "item", F.least(size, F.lit(window)).alias("len"),
        F.explode(F.when(size < window, F.array(F.array_join("ws", " "))).otherwise(grams(F.col("ws"), window))).alias("gram"),
    )
    return rows.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row per document: doc_id, mark, n_words, n_hit, items, spans.

    spans: the hit word ranges [from, to), merged; items: sorted ids of the items with a window in the document. A null
    text has no words. Rows with equal doc_id and text get equal results, a row each; a null doc_id is one like any
    other. mark is a hash of the text, which tells apart documents that share a doc_id. An empty benchmark hits nothing,
    an empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    grams_ = stage(benchmark_windows(benchmark, window=window))
    lengths = sorted(r[0] for r in grams_.select("len").distinct().collect())  # at most `window` of them
    n_windows = grams_.limit(BROADCAST_WINDOWS + 1).count()
    few = n_windows <= BROADCAST_WINDOWS
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), words(F.col(text_col)).alias("ws")
    ).withColumn("n_words", F.size("ws"))
    # Segments overlap by a window less one word, so that each window lies in one of them.
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(SEGMENT))
    rows = rows.select(
        "doc_id", "mark", "n_words",
        F.explode(F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("ws", s + 1, SEGMENT + window - 1).alias("ws")))).alias("seg"),
    )
    found = none = F.array().cast("array<struct<at:int,gram:string>>")
    ws = F.col("seg.ws")
    if lengths:
        slots = min(MOST_SLOTS, 1 << max(10, (SLOTS * (n_windows if few else grams_.count()) - 1).bit_length()))
        passes = F.lit(lead_filter(grams_, slots))
        for lead in sorted({min(n, LEAD) for n in lengths}):
            last = F.size(ws) - lead
            hit = F.filter(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                lambda i: F.substring(passes, slot(lambda k: F.get(ws, i + k), lead, slots) + 1, F.lit(1)) == F.lit(b"\x01"),  # noqa: B023
            )
            rows = rows.withColumn(f"lead{lead}", F.when(last >= 0, hit).otherwise(F.array().cast("array<int>")))
    for n in lengths:
        last = F.least(F.size(ws) - n, F.lit(SEGMENT - 1))
        places = F.filter(f"lead{min(n, LEAD)}", lambda i: i <= last)  # noqa: B023
        every = F.transform(places, lambda i: F.struct((i + F.col("seg.at")).cast("int").alias("at"), F.array_join(F.slice(ws, i + 1, n), " ").alias("gram")))  # noqa: B023
        found = F.concat(found, F.when(last >= 0, every).otherwise(none))
    # One more row per document, without a window, keeps documents that nothing hits.
    self = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("gram"))
    found = F.when(F.col("seg.at") == 0, F.concat(F.array(self), found)).otherwise(found)
    scanned = rows.select("doc_id", "mark", "n_words", F.explode(found).alias("w")).select("doc_id", "mark", "n_words", "w.at", "w.gram")
    hits = scanned.join(F.broadcast(grams_) if few else grams_, "gram", "left").where("len is not null or at = -1")
    per = hits.groupBy("doc_id", "mark", "n_words").agg(
        F.collect_set(F.when(F.col("len").isNotNull(), F.struct(F.col("at").alias("from"), (F.col("at") + F.col("len")).alias("to")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count(F.when(F.col("at") == -1, 1)).alias("copies"),
    )
    # The ranges in order, each joined to the last one that it meets; kept as (from, to) pairs.
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<from:int,to:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["from"] <= F.element_at(acc, -1)["to"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], s["to"]).alias("to"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))),
    )
    per = per.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    per = per.select("doc_id", "mark", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), "items", "spans", "copies")
    again = F.when(F.col("copies") > 1, F.sequence(F.lit(1).cast("long"), F.greatest(F.col("copies"), F.lit(1).cast("long")))).otherwise(F.array(F.lit(1).cast("long")))
    return per.withColumn("copies", F.explode(again)).drop("copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """`docs` without the contaminated documents, or (remove="spans") with the hit words taken out of the text.

    In a text that loses words, those kept are lower-case and joined by single spaces; all others stay as they are, with
    all their columns. Null and empty texts stay; rows that repeat go or stay together.
    """
    own = docs.columns
    docs = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    hit = stage(contamination(docs, benchmark, window=window).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("spans").alias("__spans")).distinct())
    rows = docs.withColumn("__id", F.col("doc_id")).withColumn("__mark", F.xxhash64("text"))
    if remove == "documents":
        return keep_ids(rows, hit, ["__id", "__mark"], "left_anti").select("row.*")
    h = hit.withColumnsRenamed({"__id": "__id2", "__mark": "__mark2"})
    rows = rows.join(h, F.col("__id").eqNullSafe(F.col("__id2")) & F.col("__mark").eqNullSafe(F.col("__mark2")), "left")
    left = F.filter(words(F.col("text")), lambda w, i: ~F.exists("__spans", lambda s: (i >= s["from"]) & (i < s["to"])))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(left, " "))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own])
