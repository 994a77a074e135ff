"""Merkle trees over the rows of a table: subroots of ordered groups under one root, with a proof for each row.

The trees are built in supersteps over an RDD of vertices. A vertex is a block of 2^LEVELS consecutive nodes of one
tree. Going up, children send their digests to the vertex that holds their parents; a vertex that has heard from all
of its children hashes the levels inside it and sends its top on. Going down, each vertex sends its children the
siblings on their way to the root, and the leaves recompute the root from their own digest and these. With LEVELS = 1 a
superstep is one level of the tree; with more, siblings inside a block are not sent at all, and a path of the levels
above is sent once a block instead of once a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, stage

#: Levels of a tree in one vertex.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the trees' roots.
TOP = -1


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """The hash of a row: of each value `-` if null, else its UTF-8 byte count, a colon and itself."""
    said = []
    for c in columns:
        value = c.cast("string")
        said.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*said), 256)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` in the order of its columns (nulls first) with `at`, its place from 0 on; written once.

    Rows are sorted by ranges; how many rows the partitions before hold is a table of one row a partition.
    """
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    rows = stage(tied.orderBy(*[F.col(c).asc_nulls_first() for c in order], "tie").drop("tie").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())
    offsets, at = [], 0
    for part_id, n in sizes:
        offsets.append((part_id, at))
        at += n
    known = df.sparkSession.createDataFrame(offsets, "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(known), "part").withColumn("at", F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).drop("part", "before", "m")


def width(n: int, steps: int, levels: int) -> int:
    """Nodes that are left of n leaves after `steps` supersteps."""
    return -(-n // (1 << levels * steps))


def block_levels(nodes: list[str], whole: bool, levels: int) -> list[list[str]]:
    """The levels of a block from its nodes up: each run of two, or the last node alone, is hashed to its parent.

    A block of a tree that goes on above it (not `whole`) has all of its levels, a tree's last block those up to one node.
    """
    out = [nodes]
    while len(out[-1]) > 1 or not whole and len(out) <= levels:
        low = out[-1]
        out.append([digest(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def heard(messages: RDD, n_parts: int, step: int, levels: int) -> RDD:
    """Vertices ((tree, n, block), children), each child (digest, payload), that have heard from all of their children."""
    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        got: dict[tuple, dict[int, tuple]] = {}
        for key, (slot, *child) in rows:
            got.setdefault(key, {})[slot] = tuple(child)
        for (tree, n, block), children in got.items():
            expected = min(1 << levels, width(n, step, levels) - (block << levels))
            if len(children) != expected:
                raise ValueError(f"block {block} of tree {tree} has heard from {len(children)} of {expected} children")
            yield (tree, n, block), [children[i] for i in range(expected)]

    return messages.partitionBy(n_parts).mapPartitions(gather, preservesPartitioning=True)


def kept(rdd: RDD) -> RDD:
    """The RDD written to the shared folder, so that a lost executor does not bring back the supersteps before."""
    rdd = rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    return rdd


def climb(leaves: RDD, most: int, n_parts: int, levels: int) -> tuple[list[RDD], RDD]:
    """(the vertices of each superstep, (tree, root)). leaves: ((tree, n, place), (digest, payload)) of trees of 2 to `most`."""
    mask = (1 << levels) - 1
    messages = leaves.map(lambda r: ((r[0][0], r[0][1], r[0][2] >> levels), (r[0][2] & mask, *r[1])))
    states, roots, steps = [], None, 0
    while not steps or width(most, steps, levels) > 1:
        states.append(kept(heard(messages, width(n_parts, steps, levels), steps, levels)))
        steps += 1

        def top(row: tuple, steps: int = steps) -> tuple:
            (tree, n, block), children = row
            whole = width(n, steps, levels) == 1
            return whole, tree, n, block, block_levels([c[0] for c in children], whole, levels)[-1][0]

        tops = states[-1].map(top)
        done = tops.filter(lambda r: r[0]).map(lambda r: (r[1], r[4]))
        roots = done if roots is None else roots.union(done)
        messages = tops.filter(lambda r: not r[0]).map(lambda r: ((r[1], r[2], r[3] >> levels), (r[3] & mask, r[4], None)))
    return states, roots


def descend(states: list[RDD], news: RDD, levels: int) -> RDD:
    """Per leaf (tree, digest, payload, path, told) from news, (tree, (path above its root, *told)).

    A path has (own side, sibling) at each level from the leaf up; the sibling is None where a node is alone.
    """
    sent = None
    for step in range(len(states) - 1, -1, -1):
        state, n_parts = states[step], states[step].getNumPartitions()
        # The block under a tree's root hears the news of its tree, all others what the blocks above them send.
        last = state.keys().filter(lambda key, step=step: width(key[1], step + 1, levels) == 1)
        told = last.map(lambda key: (key[0], key)).join(news, n_parts).values()
        told = (told if sent is None else told.union(sent)).partitionBy(n_parts)

        def tell(row: tuple, step: int = step) -> Iterator[tuple]:
            (tree, n, block), (children, (above, *more)) = row
            inside = block_levels([c[0] for c in children], width(n, step + 1, levels) == 1, levels)
            for i, child in enumerate(children):
                path, at = [], i
                for low in inside[:-1]:
                    path.append((at & 1, low[at ^ 1] if at ^ 1 < len(low) else None))
                    at >>= 1
                yield (tree, n, block << levels | i), child, path + above, more

        spread = state.join(told, n_parts).flatMap(tell)
        sent = spread.map(lambda r: (r[0], (r[2], *r[3])))
    return spread.map(lambda r: (r[0][0], *r[1], r[2], r[3]))


def fold(start: str, path: list[tuple[int, str | None]]) -> str:
    """The root that follows from a leaf's digest and the siblings on its way."""
    for right, sibling in path:
        start = digest(start) if sibling is None else digest(sibling, start) if right else digest(start, sibling)
    return start


def proofs(leaves: DataFrame, tree: str, order: str, carried: tuple[str, ...] = (), levels: int = LEVELS) -> RDD:
    """Per row (digest, the carried columns, path, subroot, root) from `leaves` with the column leaf.

    The rows of a value of `tree` are the leaves of a tree in the order of `order`, nulls first; its root is a leaf of
    the tree over the values of `tree`, in their order, null first. A lone leaf is its tree's root. Rows of one value
    of `order` lie in the order of their digests, equal rows in any. Values of `tree` may be few or as many as rows.
    """
    spark = leaves.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(numbered(leaves.withColumnRenamed(tree, "tree"), ["tree", order, "leaf"]))
    trees = stage(numbered(rows.groupBy("tree").agg(F.min("at").alias("start"), F.count("*").alias("n")), ["tree"]).withColumnRenamed("at", "number"))
    n_trees, most = trees.agg(F.count("*"), F.max("n")).first()
    known = trees.select(F.col("tree").alias("t"), "start", "n", "number")
    placed = rows.join(F.broadcast(known) if n_trees <= BROADCAST_ROWS else known, F.col("tree").eqNullSafe(F.col("t")))
    placed = placed.select("number", "n", (F.col("at") - F.col("start")).alias("at"), "leaf", F.struct(*[F.col(c) for c in carried]).alias("carried"))
    as_leaf = lambda r: ((r[0], r[1], r[2]), (r[3], tuple(r[4])))
    alone = placed.where("n = 1").rdd.map(as_leaf).map(lambda r: (r[0][0], *r[1]))
    subroots = alone.map(lambda r: (r[0], r[1]))
    states: list[RDD] = []
    if (most or 0) > 1:
        states, roots = climb(placed.where("n > 1").rdd.map(as_leaf), most, n_parts, levels)
        subroots = kept(subroots.union(roots))
    if (n_trees or 0) > 1:
        upper, root = climb(subroots.map(lambda r: ((TOP, n_trees, r[0]), (r[1], r[0]))), n_trees, min(n_parts, n_trees), levels)
        news = kept(descend(upper, root.map(lambda r: (r[0], ([], r[1]))), levels).map(lambda r: (r[2], (r[3], r[1], *r[4]))))
    else:
        news = subroots.map(lambda r: (r[0], ([], r[1], r[1])))
    out = alone.map(lambda r: (r[0], r[1:])).join(news).values().map(lambda r: (*r[0], r[1][0], *r[1][1:]))
    if states:
        out = out.union(descend(states, news, levels).map(lambda r: (r[1], r[2], r[3], *r[4])))
    return out


def manifest(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", changed: str = "n_chars", levels: int = LEVELS) -> DataFrame:
    """One row per input row: doc_id (the value of `order`), leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are the hashes of `fields` (all others are ignored, whatever their names). Where `altered` holds, the row is
    verified as if its column `changed` were one more (a null stays): folded_root is what its hash and the original
    siblings give, and verified whether that is root. proof_sha256: the hash of the siblings from the leaf up, of none
    if there are none. Texts may be null, empty or very long (they are hashed where they lie, and only digests move on);
    rows that repeat are leaves each; an empty table gives an empty result.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)
    columns = [docs[c] for c in fields]
    more = [(docs[c].cast("decimal(38,0)") + 1) if c == changed else docs[c] for c in fields]
    other = F.when(altered, leaf(more)) if altered is not None else F.lit(None).cast("string")
    leaves = docs.select(docs[tree].alias("tree"), docs[order].alias("own"), leaf(columns).alias("leaf"), other.alias("other"))

    def said(row: tuple) -> tuple:
        own_leaf, (own, other), path, subroot, root = row
        folded = fold(other or own_leaf, path)
        return own, own_leaf, subroot, root, digest(*[s for _, s in path if s is not None]), folded, folded == root

    found = proofs(leaves, "tree", "own", ("own", "other"), levels).map(said)
    return spark.createDataFrame(found, f"doc_id {kind[order]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", verifySchema=False)
