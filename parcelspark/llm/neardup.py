"""Near-duplicate detection by bottom-k sketches from one hash function.

Each distinct shingle set keeps its k least hashes. Inverted lists of the retained values that at least two sets have
generate overlaps: a linked pair shares least_shared() of its k values (a pair at the least Jaccard that is linked shares
fewer with a chance under MISS; sets of at most k shingles are their own sketch, so there the bound is exact), hence it
meets in one of the lists of its first values in the order of (list length, value), and only those lists are kept. Pairs
from short lists pass an estimate on the union's sketch and are then verified on full sets. In long lists, as large groups
of copies make them, every member is first held against a few leaders of its list. What is connected by then needs no
further look: a list's members are cut into blocks within their components, and only pairs of blocks with more than one
component are verified, on full sets where they lie; they give out a spanning forest of their links rather than the
links. No list is cut short, and no pair of a list is left out unless it is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as bh
from .common import components, keep_ids, stage

WIDTH = 5
K = 32
MISS = 1e-8
#: Members of a list whose pairs are listed as rows; longer lists go by leaders, then by blocks.
SHORT = 64
LEADERS = 3
#: Members of a block at most, about, and their shingles.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20


def shingle_sets(batch: pa.RecordBatch, w: bh.Words, width: int) -> Iterator[np.ndarray]:
    """Per row its sorted distinct shingle hashes (63 bits); a text of fewer words is one shingle."""
    h = w.hashes()
    s = bh.windows(h, width) >> bh.U(1)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            yield np.array([bh.sequence(h[a:b]) >> bh.U(1)], bh.U)
        else:
            yield np.zeros(0, bh.U)


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([bh.mix(s).sum(dtype=bh.U), bh.mix(s ^ bh.U(0x5851F42D4C957F2D)).sum(dtype=bh.U) + bh.U(len(s))], bh.U).tobytes()


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(doc_id, ref, n, fp, sketch) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in bh.rows(batches, "text", lower=True):
            sets = list(shingle_sets(batch, w, width))
            kept = [s[:k].astype(np.int64) for s in sets]
            off = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("ref"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                ],
                names=["doc_id", "ref", "n", "fp", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, ref long, n long, fp binary, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(fp, hashes) per row, hashes the sorted set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in bh.rows(batches, "text", lower=True):
            sets = list(shingle_sets(batch, w, width))
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["fp", "hashes"])

    return docs.mapInArrow(run, "fp binary, hashes array<long>")


def least_shared(percent: int, k: int) -> int:
    """The most values of which a pair at `percent` hundredths shares fewer, of k, with a chance (binomial) of at most MISS."""
    p, below, n = percent / 100, 0.0, 0
    while n < k and (below := below + comb(k, n) * p**n * (1 - p) ** (k - n)) <= MISS:
        n += 1
    if not n:
        raise ValueError(f"sketches of {k} values miss pairs at {percent} hundredths with a chance over {MISS}: take a larger k")
    return n


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows whose sets, ha and hb, are linked."""
    both = F.size(F.array_intersect("ha", "hb"))
    rows = pairs.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), both.alias("both"))
    return rows.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def forest(reps: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links between the two sides (or within one) connect, one less than members at most."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, name = np.unique(flat, return_inverse=True)
    by = np.argsort(name, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(name))])
    posting = owner[by]
    first = np.concatenate([[0], np.cumsum(sizes)])
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, two = [], side.any() and not side.all()
    for i in range(m):
        if two and side[i]:
            continue
        own = name[first[i] : first[i + 1]]
        lengths = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[at], minlength=m)
        hit = 100 * both >= percent * (sizes + sizes[i] - both)
        for j in np.flatnonzero(hit):
            if (side[j] if two else j > i) and (x := find(i)) != (y := find(int(j))):
                root[y] = x
                out.append((int(reps[i]), int(reps[j])))
    return out


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links within lists, pair of blocks by pair of blocks. members: (v, i, j, own, rep, hashes)."""
    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("hashes")]
        side = table.column("own").to_numpy() != table.column("i").to_numpy()
        alone = table.column("i")[0].as_py() != table.column("j")[0].as_py() and (side.all() or not side.any())
        edges = [] if alone else forest(reps, sets, side, percent)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return members.groupBy("v", "i", "j").applyInArrow(run, "a long, b long")


def leader_pairs(long: DataFrame, percent: int) -> DataFrame:
    """(a, b): every member of a long list with the list's leaders, if their sizes allow a link. long: (v, rep, n, m)."""
    ranks = [F.min_by(F.struct("rep", "n"), F.xxhash64("rep", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = long.groupBy("v").agg(*ranks)
    leaders = leaders.select("v", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("l"))
    pairs = long.join(leaders, "v").where("rep <> l.rep")
    near = (F.col("n") * 100 >= F.col("l.n") * percent) & (F.col("l.n") * 100 >= F.col("n") * percent)
    return pairs.where(near).select(F.least("rep", "l.rep").alias("a"), F.greatest("rep", "l.rep").alias("b")).distinct()


def open_blocks(long: DataFrame, known: DataFrame) -> DataFrame:
    """(v, rep, own, i, j): members of long lists in the pairs of blocks that have more than one component.

    known: (rep, component) of the links found so far; who is not in it is a component of its own. Large components of
    a list have blocks to themselves, the others share blocks.
    """
    size = lambda: F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    rows = long.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = rows.groupBy("v", "component").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    sizes = sizes.withColumn("own", F.when((F.col("members") * 2 > BLOCK) | (F.col("n") * 2 > BLOCK_SHINGLES), F.col("component")).otherwise(-1))
    # A list whose members are all one component is done with.
    several = sizes.groupBy("v").agg(F.count("*").alias("components")).where("components > 1").select("v")
    rows = stage(rows.join(sizes.select("v", "component", "own").join(several, "v"), ["v", "component"]).select("v", "rep", "n", "own"))
    cuts = rows.groupBy("v", "own").agg(size().alias("blocks"))
    rows = rows.join(cuts, ["v", "own"]).select("v", "rep", "own", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("part"))
    rows = rows.withColumn("block", F.xxhash64("own", "part"))
    blocks = stage(rows.select("v", "own", "block").distinct())
    one, two = (blocks.select("v", F.col("own").alias(f"o{x}"), F.col("block").alias(x)) for x in "ij")
    pairs = one.join(two, "v").where("i <= j and (oi <> oj or oi = -1)").select("v", "i", "j")
    each = pairs.select("v", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return each.join(rows.select("v", "rep", "block"), ["v", "block"]).select("v", "rep", F.col("block").alias("own"), "i", "j")


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """(a, b): links between representatives that connect all that is linked. classes: (rep, ref, n, fp, sketch)."""
    values = classes.select("rep", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(common, "v").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    enough = least_shared(percent, k)
    need = F.least(F.lit(enough), F.ceil(F.col("n") * percent / 100).cast("int"))
    kept = F.slice("vs", 1, F.greatest(F.size("vs") - need + 1, F.lit(0)))
    index = stage(shared.where(F.size("vs") >= need).select("rep", "n", F.explode(kept).alias("x")).select("rep", "n", "x.v"))
    lengths = index.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    lists = stage(index.join(lengths, "v"))
    a = lists.where(F.col("m") <= SHORT).select("v", F.col("rep").alias("a"), F.col("n").alias("na"))
    b = lists.where(F.col("m") <= SHORT).select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = a.join(b, "v").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    long = stage(lists.where(F.col("m") > SHORT).select("v", "rep", "n", "m"))
    # The estimate on the union's sketch: of its k least values, those that both sets have.
    sk = classes.select("rep", "sketch")
    pairs = pairs.union(leader_pairs(long, percent)).distinct()
    pairs = pairs.join(sk.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sk.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    least = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(least, F.array_intersect("sa", "sb")))
    pairs = stage(pairs.where(both * k >= F.size(least) * enough).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(long.select("rep")).distinct()
    wanted = stage(wanted.join(classes.select("rep", "ref", "fp"), "rep"))
    own = full_sets(keep_ids(docs, wanted, ["ref"], "left_semi"), width).dropDuplicates(["fp"])
    own = stage(own.join(wanted, "fp").select("rep", "hashes"))
    two = pairs.join(own.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(own.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b")
    found = stage(verified(two, percent))
    if not long.head(1):
        return found
    rest = open_blocks(long, components(found, "a", "b").withColumnRenamed("node", "rep"))
    return found.union(block_links(rest.join(own, "rep"), percent))


def with_ref(docs: DataFrame) -> DataFrame:
    return docs.withColumn("ref", F.xxhash64("doc_id", "text"))


def found_classes(docs: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of (doc_id, text, ref): the sketches, and one row for each distinct set that is not empty.

    A class is named by a number of its own, rep. Its (anonymous, doc_id, ref) are those of its least row, rows without
    a doc_id last.
    """
    rows = stage(sketches(docs, width, k))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "ref")).alias("x")
    classes = rows.where("n > 0").groupBy("fp").agg(least, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return rows, stage(classes.select(F.monotonically_increasing_id().alias("rep"), "fp", "x.*", "n", "sketch"))


def same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of rows that share a doc_id."""
    rows = rows.where("n > 0 and doc_id is not null")
    mark = F.xxhash64("fp")
    many = stage(rows.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low < high").select("doc_id"))
    own = stage(keep_ids(rows, many, ["doc_id"], "left_semi").select("doc_id", "fp").distinct().join(classes.select("fp", "rep"), "fp").select("doc_id", "rep"))
    # An id may have many classes: they meet the least of them by salted keys.
    salts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = own.withColumn("salt", F.pmod("rep", F.lit(salts)).cast("int"))
    part = own.groupBy("doc_id", "salt").agg(F.min("rep").alias("least"))
    spread = part.select("doc_id", "salt").join(part.groupBy("doc_id").agg(F.min("least").alias("a")), "doc_id")
    return own.join(spread, ["doc_id", "salt"]).where("a <> rep").select("a", F.col("rep").alias("b"))


def with_component(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """`classes` plus component, the least class that the edges reach."""
    joined = components(edges, "a", "b").withColumnRenamed("node", "rep")
    return classes.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 85, k: int = K
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Sets are of lower-cased (A-Z) words, `width` to a shingle; a text of fewer words is one shingle, one without words
    has none and is linked with nothing. Equal sets are linked as one class first. Documents whose sets have at least
    `percent` hundredths of their union in common are linked, and component_id is the least doc_id reachable. Rows
    that share a doc_id are one node, whatever their texts. A row without a doc_id gets its class's component; where
    no row of the component has an id, null, and is kept. An empty table gives an empty result. Other columns, whatever
    their names, are ignored.
    """
    docs = with_ref(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    rows, classes = found_classes(docs, width, k)
    top = with_component(classes, links(docs, classes, width, percent, k).union(same_ids(rows, classes)))
    # Classes meet their component, and rows their class, by salted keys, so that a large group is not one task.
    salts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top = top.withColumn("salt", F.pmod("rep", F.lit(salts)).cast("int"))
    part = top.groupBy("component", "salt").agg(F.min("doc_id").alias("least"))
    named = part.select("component", "salt").join(part.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    top = top.join(named, ["component", "salt"]).select("fp", "component_id")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    spread = rows.select("fp", "salt").distinct().join(top, "fp")
    out = rows.join(spread, ["fp", "salt"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        (component.isNull() | F.col("doc_id").eqNullSafe(component)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 85, k: int = K) -> DataFrame:
    """One row of each group of near duplicates, with all columns of `docs`: the one with the least doc_id.

    Groups are of texts, linked as in near_duplicates(): rows that share a doc_id or have none are in one group only
    if their texts are. Rows without words stay; all columns are carried, whatever their names.
    """
    own = with_ref(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows, classes = found_classes(own, width, k)
    top = with_component(classes, links(own, classes, width, percent, k))
    best = top.groupBy("component").agg(F.min(F.struct("anonymous", "doc_id", "ref")).alias("x")).select("x.ref")
    refs = rows.where("n > 0").groupBy("ref").agg(F.count("*").alias("copies"))
    refs = stage(refs.join(best.withColumn("best", F.lit(True)), "ref", "left").where("best is null or copies > 1"))
    # The input's columns travel as one, so that none of them can clash.
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__ref"))
    out = keep_ids(marked, refs.select(F.col("ref").alias("__ref")), ["__ref"], "left_anti").select("row.*")
    twice = refs.where("best").select(F.col("ref").alias("__ref"))
    if not twice.head(1):
        return out
    # Rows equal in id and text are combined before the shuffle: a large group of them is not one task.
    one = keep_ids(marked, twice, ["__ref"], "left_semi").groupBy("__ref").agg(F.min("row").alias("row"))
    return out.union(one.select("row.*"))
