"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Every word is a customer of the restaurant of its context. The `contexts` most frequent words, and the boundary of a
text, have a restaurant each for the word that follows them; its parent is the restaurant of the context's ending (the
last two bytes), which all words of that ending share and where the words behind rarer contexts sit down directly; the
parent of the endings is the root. A table of a restaurant is a customer of its parent. The root draws each kind of word
once; all words that were never learnt are one more kind, as in the base score, with what the root leaves to new tables.

Pairs (context, word) are counted into buckets: by the word if it is rare, else by the context's ending and the word, so
that all restaurants' tables of one word and ending lie together. A bucket is one row of packed arrays. Seating is
sampled by Gibbs: a sweep takes all customers of each pair from their tables and seats them again at once, first in the
contexts, then in the endings, given the other restaurants' numbers as the last sweep left them. All that the model asks
of a seating is its number of tables, whose law is known by generalised Stirling numbers. Those numbers (tables and
customers of each restaurant, the root's customers of the frequent words) are vectors of a length that `contexts` bounds;
they are summed by slices and broadcast. Predictive probabilities are averaged over the sweeps after the first ones.

Scoring asks the buckets for the pairs of each text. The pairs that occur most often are broadcast, at most TOP_PAIRS,
with their probabilities, so that no bucket is asked for one of them by every text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as bh
from .common import by_key, stage, unstage

#: Words with a context restaurant of their own; the vectors that tasks hold and the driver sums grow with it alone.
CONTEXTS = 1 << 17
ENDINGS = 1 << 16
TOP_PAIRS = 1 << 18
#: Tokens of a bucket and documents of a group of results, about; sizes of tasks, without effect on a score.
BUCKET_TOKENS = 2 << 20
HOME_DOCS = 1 << 14
SLICES = 16
BURN_IN, SAMPLES = 2, 3
#: Customers up to which the law of tables is taken from a table of all its weights, tables under which it is a finite sum
#: beyond, places at which it is taken there, and numbers held at once.
EXACT = 1024
FEW = 12
GRID = 256
CELLS = 1 << 18
STRENGTH = 1.0
RARE = bh.U(1 << 63)
BOUNDARY_ENDING = 10  # a line feed, which no word ends in
_codec = pa.Codec("zstd")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one value: byte planes one after another, compressed."""
    planes = {k: (a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for k, a in arrays.items()}
    raw = pickle.dumps(planes, protocol=5)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpack(value: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(_codec.decompress(value[8:], int.from_bytes(value[:8], "little"), asbytes=True))
    return {k: np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, -1).T.copy().view(t).ravel() if b else np.zeros(0, t) for k, (t, b) in planes.items()}


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


# Seating


@lru_cache(maxsize=4)
def stirling(d: float) -> list[np.ndarray]:
    """log S(c, t) for each c up to EXACT and t from 1 to c: the weight of all seatings of c customers at t tables, each
    table of n having (1 - d)(2 - d) ... (n - 1 - d). S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t)."""
    rows = [np.zeros(0), np.zeros(1)]
    with np.errstate(divide="ignore"):
        for c in range(2, EXACT + 1):
            last, t = rows[-1], np.arange(1, c + 1)
            opened = np.append(-np.inf, last)
            joined_ = np.append(last + np.log(c - 1 - d * t[:-1]), -np.inf)
            rows.append(np.logaddexp(opened, joined_))
    return rows


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_lgamma(np.asarray(x, float))).astype(float)


def far_stirling(c: np.ndarray, t: np.ndarray, d: float, y: np.ndarray) -> np.ndarray:
    """log S(c, t) but for what depends on c alone, of c over EXACT (rows) and t (columns, real numbers from 1 on).

    S(c, t) t! / c! is the c-th coefficient of ((1 - (1 - z)^d) / d)^t: taken by its saddle point (at z = 1 - y, found
    from `y` by Newton's steps) from FEW tables on, below by its finite sum, which loses no digits for so few tables.
    """
    c = c[:, None].astype(float)
    v = np.repeat(np.log(y)[:, None], t.shape[1], 1)
    for _ in range(8):
        y, yd = np.exp(v), np.exp(d * v)
        gap = np.log(t) + np.log1p(-y) + (d - 1) * v + np.log(d) - np.log1p(-yd) - np.log(c)
        v = np.minimum(v - gap / (-y / (1 - y) + (d - 1) + d * yd / (1 - yd)), -1e-12)
    y, yd = np.exp(v), np.exp(d * v)
    spread = c * (1 + (1 - d) * (1 - y) / y - c / t)
    log_factorial = (t + 0.5) * np.log(t) - t + 0.5 * np.log(2 * np.pi) + 1 / (12 * t) - 1 / (360 * t**3)
    out = t * np.log((1 - yd) / d) - c * np.log1p(-y) - log_factorial - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))
    if (few := t < FEW).any():
        row, column = np.nonzero(few)
        k, cc = np.maximum(np.round(t[few]), 1).astype(np.int64), c[row, 0]
        head = lgamma(cc - d) - lgamma(cc + 1)  # the sum's first term, of all seatings at one table but for a factor
        total = np.zeros(len(k))
        for j in range(1, FEW + 1):
            use = k >= j
            choose = np.where(use, np.exp(lgamma(k + 1.0) - lgamma(j + 1.0) - lgamma(np.maximum(k - j, 0) + 1.0)), 0.0)
            total += (-1) ** j * choose * np.exp(lgamma(cc - j * d) - lgamma(cc - d)) * recip_gamma(-j * d)
        out[few] = head + np.log(np.maximum(total, 1e-300)) - k * np.log(d) - lgamma(k + 1.0)
    return out


def recip_gamma(x: float) -> float:
    """1 / gamma(x), 0 at its poles."""
    return 0.0 if x <= 0 and x == int(x) else 1.0 / math.gamma(x)


def seated(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """How many tables c customers of a dish open in a restaurant where a new table weighs `new`, all of them seated anew
    at once: drawn from its law given all else, in which t has the weight new^t S(c, t)."""
    t = np.minimum(c, 1)
    log_new, u = np.log(np.maximum(new, 1e-300)), rng.random(len(c))
    near = np.flatnonzero((c > 1) & (c <= EXACT))
    near = near[np.argsort(c[near], kind="stable")]
    cuts = np.append(starts_of(c[near]), len(near)) if len(near) else np.zeros(1, int)
    table = stirling(d)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(c[near[lo]])
        step = max(1, CELLS // n)
        for a in range(lo, hi, step):
            at = near[a : min(a + step, hi)]
            weight = table[n] + log_new[at, None] * np.arange(1, n + 1)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            t[at] = 1 + (weight < u[at, None] * weight[:, -1:]).sum(1)
    far = np.flatnonzero(c > EXACT)
    for a in range(0, len(far), max(1, CELLS // GRID)):
        at = far[a : a + max(1, CELLS // GRID)]
        n, w = c[at].astype(float), np.maximum(new[at], 1e-300)
        low, high = np.full(len(at), -700.0), np.full(len(at), -1e-9)  # log y at the mode: new (1 - y) y^(d - 1) = c
        for _ in range(60):
            v = (low + high) / 2
            over = np.log(w) + np.log1p(-np.exp(v)) + (d - 1) * v > np.log(n)
            low, high = np.where(over, v, low), np.where(over, high, v)
        y = np.exp((low + high) / 2)
        mode = np.clip(w * (1 - y**d) / d, 1, n)
        reach = 8 * np.sqrt(mode) + 8
        first, last = np.maximum(1, np.floor(mode - reach)), np.minimum(n, np.ceil(mode + reach))
        step = np.maximum((last - first) / (GRID - 1), 1)
        grid = first[:, None] + np.arange(min(GRID, int((last - first).max()) + 1)) * step[:, None]
        inside = grid <= last[:, None] + 1e-9
        grid = np.minimum(grid, last[:, None])
        weight = np.where(inside, far_stirling(n, grid, d, y) + log_new[at, None] * grid, -np.inf)
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        pick = np.minimum((weight < u[at, None] * weight[:, -1:]).sum(1), grid.shape[1] - 1)
        within = np.where(step > 1, (rng.random(len(at)) - 0.5) * step, 0.0)  # a place stands for the numbers about it
        t[at] = np.clip(np.round(grid[np.arange(len(at)), pick] + within), 1, c[at]).astype(np.int64)
    return t


# The model


@dataclass
class Words:
    """The frequent words: sorted hashes, their codes from 1 on, and by code (0: the boundary) endings and counts."""

    h: np.ndarray
    code: np.ndarray
    ending: np.ndarray
    count: np.ndarray

    @property
    def contexts(self) -> int:
        """Contexts with a restaurant of their own; a context's number below it is a word's code, from it on an ending."""
        return len(self.ending)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Codes of frequent words; of the others the hash, marked."""
        out = h | RARE
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            out = np.where(self.h[at] == h, self.code[at].astype(bh.U), out)
        return out

    def ending_of(self, ctx: np.ndarray) -> np.ndarray:
        own = ctx < self.contexts
        return np.where(own, self.ending[np.where(own, ctx, 0)], ctx - self.contexts)


@dataclass
class World:
    """What restaurants know of one another: tables and customers by context number, the root's customers by code."""

    tables: np.ndarray
    customers: np.ndarray
    root: np.ndarray
    root_all: float
    kinds: int
    d: tuple[float, float, float]  # of the root, the endings and the contexts

    def root_p(self, c: np.ndarray) -> np.ndarray:
        """The root's probability of words with c customers there; 0: of the kind that was never learnt."""
        unknown = STRENGTH + self.d[0] * self.kinds
        return np.where(c > 0, c - self.d[0], unknown) / (STRENGTH + self.root_all)

    def new(self, ctx: np.ndarray, above: np.ndarray, level: int) -> np.ndarray:
        """The weight of a new table, given the parent's probability."""
        return (STRENGTH + self.d[level] * self.tables[ctx]) * above

    def p(self, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, above: np.ndarray, level: int) -> np.ndarray:
        return (c - self.d[level] * t + self.new(ctx, above, level)) / (STRENGTH + self.customers[ctx])


class Bucket:
    """The pairs of one bucket in the order (word, ending, context), and the groups of equal (word, ending)."""

    def __init__(self, words: Words, ctx: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        self.words, self.ctx, self.w, self.c = words, ctx.astype(np.int64), w, c.astype(np.int64)
        self.ending = words.ending_of(self.ctx)
        self.own = self.ctx < words.contexts  # the others sit in the ending's restaurant
        self.group = starts_of(w, self.ending)
        self.group_of = np.cumsum(np.isin(np.arange(len(w)), self.group, assume_unique=True)) - 1 if len(w) else np.zeros(0, np.int64)
        self.gw, self.gctx = w[self.group], self.ending[self.group] + words.contexts
        self.kind = starts_of(self.gw)
        self.kind_of = np.repeat(np.arange(len(self.kind)), np.diff(np.append(self.kind, len(self.gw))))

    def sums(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)

    def customers(self, t: np.ndarray) -> np.ndarray:
        """Customers of the groups: the contexts' tables, and all customers without a restaurant of their own."""
        return self.sums(np.where(self.own, t, self.c), self.group)

    def root(self, world: World, gt: np.ndarray) -> np.ndarray:
        """The root's customers of each group's word: of rare words all tables are here."""
        rare = self.gw >= RARE
        local = self.sums(gt, self.kind)[self.kind_of] if len(gt) else gt
        return np.where(rare, local, world.root[np.where(rare, 0, self.gw).astype(np.int64)])

    def numbers(self, t: np.ndarray, gt: np.ndarray) -> np.ndarray:
        """This bucket's part of a World, as one vector: tables, customers, root, root_all."""
        size = self.words.contexts + ENDINGS
        common = self.gw < RARE
        return np.concatenate([
            np.bincount(self.ctx[self.own], t[self.own], size) + np.bincount(self.gctx, gt, size),
            np.bincount(self.ctx[self.own], self.c[self.own], size) + np.bincount(self.gctx, self.customers(t), size),
            np.bincount(self.gw[common].astype(np.int64), gt[common], self.words.contexts), [gt.sum()],
        ]).astype(np.int64)

    def learnt(self) -> np.ndarray:
        """How often each group's word was learnt, if it is rare."""
        return self.sums(self.sums(self.c, self.group), self.kind)[self.kind_of]


@dataclass
class Model:
    words: Words
    tokens: int
    kinds: int
    buckets: int
    pairs: DataFrame  # (bucket, state, sums): a row for each bucket that has pairs
    top: int  # of octaves (16 to a doubling) of counts, the least at which there are at most TOP_PAIRS pairs
    worlds: list[World] = field(default_factory=list)


def learnt(id_col: Column) -> Column:
    """Whether the model may learn from a document."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) != 1, F.lit(True))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, ending, c) of all words of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in bh.rows(batches, "text", lower=True):
            h, at, c = np.unique(w.hashes(), return_index=True, return_counts=True)
            columns = [pa.array(h.view(np.int64)), pa.array(w.endings()[at].astype(np.int32)), pa.array(c, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "ending", "c"])

    return docs.select("text").mapInArrow(run, "h long, ending int, c long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def frequent(vocab: DataFrame, ends: int, most: int) -> Words:
    """The `most` words of the highest counts, of equal counts those of the least hashes."""
    top = vocab.orderBy(F.desc("c"), "h").limit(most).toArrow()
    h, c, ending = top.column("h").to_numpy().view(bh.U), top.column("c").to_numpy(), top.column("ending").to_numpy()
    by = np.lexsort((h, -c))  # codes in the order of counts: the commonest are the smallest numbers
    code = np.empty(len(h), np.int64)
    code[by] = np.arange(1, len(h) + 1)
    to = np.argsort(h)
    return Words(h[to], code[to], np.concatenate([[BOUNDARY_ENDING], ending[by]]).astype(np.int64), np.concatenate([[ends], c[by]]).astype(np.int64))


def pairs_of(w: bh.Words, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, document) of every token of a piece of documents; each begins and ends at the boundary, 0."""
    n = len(w.first) - 1
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(n), counts)
    ids = words.ids(w.hashes())
    word, ctx = np.zeros(len(ids) + n, bh.U), np.zeros(len(ids) + n, np.int64)
    at = np.arange(len(ids)) + owner
    word[at] = ids
    ctx[at + 1] = np.where(ids < RARE, ids, bh.U(0)).astype(np.int64)
    rare = np.flatnonzero(ids >= RARE)
    ctx[at[rare] + 1] = w.endings()[rare] + words.contexts
    return ctx, word, np.repeat(np.arange(n), counts + 1)


def pair_key(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    return bh.mix(word ^ bh.mix(ctx.astype(bh.U) + bh.U(1)))


def bucket_of(words: Words, ctx: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    by = np.where(word >= RARE, word, words.ending_of(ctx).astype(bh.U) << bh.U(32) | word)
    return (bh.mix(by) % bh.U(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, **arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed arrays) of arrays that are sorted by bucket."""
    cuts = np.append(starts_of(bucket), len(bucket)) if len(bucket) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), pack(**{k: x[a:b] for k, x in arrays.items()})


def joined(values: list[bytes], *names: str) -> list[np.ndarray]:
    parts = [unpack(v) for v in values]
    return [np.concatenate([p[n] for p in parts]) for n in names]


def counted(docs: DataFrame, shared, buckets: int) -> DataFrame:
    """(bucket, state, sums): the pairs of the documents, each with one table, and the sums of Bucket.numbers()."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for _, w in bh.rows(batches, "text", lower=True):
            ctx, word, _ = pairs_of(w, words)
            _, at, c = np.unique(pair_key(ctx, word), return_index=True, return_counts=True)
            ctx, word = ctx[at], word[at]
            bucket = bucket_of(words, ctx, word, buckets)
            by = np.lexsort((ctx, word, bucket))
            rows = list(by_bucket(bucket[by], ctx=ctx[by].astype(np.uint32), w=word[by], c=c[by].astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["bucket", "pairs"])

    def count(table: pa.Table) -> pa.Table:
        words = shared.value
        ctx, w, c = joined(table.column("pairs").to_pylist(), "ctx", "w", "c")
        by = np.lexsort((ctx, words.ending_of(ctx.astype(np.int64)), w))
        ctx, w = ctx[by], w[by]
        at = starts_of(w, ctx)
        b = Bucket(words, ctx[at], w[at], np.add.reduceat(c[by].astype(np.int64), at))
        t, gt = np.ones(len(b.w), np.int64), np.ones(len(b.group), np.int64)
        gc, rare = b.customers(t), b.gw[b.kind] >= RARE
        root = b.sums(gt, b.kind)[rare]
        kinds = [(x == n).sum() for x in (root, gc, b.c[b.own]) for n in (1, 2)]
        octaves = np.bincount(octave(b.c), minlength=1024)
        state = pack(ctx=b.ctx.astype(np.uint32), w=b.w, c=b.c)
        return packed_rows(table.column("bucket")[0].as_py(), state, np.concatenate([b.numbers(t, gt), kinds, octaves]))

    return by_key(docs.select("text").mapInArrow(ask, "bucket int, pairs binary"), buckets, "bucket").groupBy("bucket").applyInArrow(count, STATE)


STATE = "bucket int, state binary, sums array<binary>, asks long"


def packed_rows(bucket: int, state: bytes, vector: np.ndarray, asks: int = 0) -> pa.Table:
    sums = [pack(x=part) for part in np.array_split(vector, SLICES)]
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "state": pa.array([state], pa.binary()), "sums": pa.array([sums], pa.list_(pa.binary())), "asks": pa.array([asks], pa.int64())})


def octave(c: np.ndarray) -> np.ndarray:
    """Sixteenths of a doubling, by which counts are put in order."""
    return np.floor(16 * np.log2(c)).astype(np.int64)


def summed(pairs: DataFrame, size: int) -> np.ndarray:
    """The sum of the rows' vectors, slice by slice; the driver gets the sums alone. Zeros without rows."""
    def add(table: pa.Table) -> pa.Table:
        total = 0
        for v in table.column("x"):
            total = total + unpack(v.as_py())["x"]
        return pa.table({"slice": table.column("slice")[:1], "x": pa.array([pack(x=total)], pa.binary())})

    parts = pairs.select(F.posexplode("sums").alias("slice", "x")).groupBy("slice").applyInArrow(add, "slice int, x binary").collect()
    return np.concatenate([unpack(bytes(r.x))["x"] for r in sorted(parts, key=lambda r: r.slice)]) if parts else np.zeros(size, np.int64)


def world_of(vector: np.ndarray, words: Words, kinds: int, d: tuple[float, float, float]) -> World:
    size = words.contexts + ENDINGS
    cut = np.split(vector[: 2 * size + words.contexts + 1].astype(float), [size, 2 * size, 2 * size + words.contexts])
    return World(cut[0], cut[1], cut[2], float(cut[3][0]), kinds, d)


def discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def swept(pairs: DataFrame, shared, world, sweep: int, keep: bool, seed: int, top: int) -> DataFrame:
    """The pairs after one Gibbs sweep; `keep`: the tables of this sweep are a sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, state in zip(batch.column("bucket").to_pylist(), batch.column("state").to_pylist(), strict=True):
                s = unpack(state)
                vector, asks = sweep_bucket(s, shared.value, world.value, sweep, keep, np.random.default_rng([seed, sweep, bucket]), top)
                yield from packed_rows(bucket, pack(**s), vector, asks).to_batches()

    return pairs.select("bucket", "state").mapInArrow(run, STATE)


def sweep_bucket(s: dict[str, np.ndarray], words: Words, world: World, sweep: int, keep: bool, rng: np.random.Generator, top: int) -> tuple[np.ndarray, int]:
    """One sweep over a bucket's state, in place; gives Bucket.numbers() and the customers of pairs that are not broadcast."""
    b = Bucket(words, s["ctx"], s["w"], s["c"])
    t = s["t"].astype(np.int64) if sweep else np.ones(len(b.w), np.int64)
    gt = s["gt"].astype(np.int64) if sweep else np.ones(len(b.group), np.int64)
    above = world.root_p(b.root(world, gt))
    given = world.p(b.gctx, b.customers(t), gt, above, 1)[b.group_of]
    many = np.flatnonzero(b.own & (b.c > 1))
    t[many] = seated(b.c[many], world.new(b.ctx[many], given[many], 2), world.d[2], rng)
    gt = seated(b.customers(t), world.new(b.gctx, above, 1), world.d[1], rng)
    s |= {"t": t.astype(np.uint32), "gt": gt.astype(np.uint32)}
    if keep:
        s |= {f"t{sweep}": s["t"], f"gt{sweep}": s["gt"]}
    return b.numbers(t, gt), int(b.c[octave(b.c) < top].sum())


def train(docs: DataFrame, seed: int = 3, contexts: int = CONTEXTS, samples: int = SAMPLES) -> Model:
    """The model of the documents' texts; an end is counted for each document."""
    spark = docs.sparkSession
    vocab = stage(vocabulary(docs))
    ends = docs.count()
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = frequent(vocab, ends, contexts)
    unstage(vocab)
    tokens, kinds = n + ends, v + (ends > 0)
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    shared = spark.sparkContext.broadcast(words)
    pairs = stage(counted(docs, shared, buckets))
    size = 2 * (words.contexts + ENDINGS) + words.contexts + 1
    vector = summed(pairs, size + 6 + 1024)
    root = vector[size - words.contexts - 1 : size - 1]
    once_twice = vector[size : size + 6].astype(float) + [(root == 1).sum(), (root == 2).sum(), 0, 0, 0, 0]
    d = tuple(discount(*once_twice[i : i + 2]) for i in (0, 2, 4))
    world = world_of(vector, words, kinds, d)
    above = np.append(np.cumsum(vector[size + 6 :][::-1])[::-1], 0)
    model = Model(words, tokens, kinds, buckets, pairs, int(np.argmax(above <= TOP_PAIRS)))
    for sweep in range(BURN_IN + samples):
        keep = sweep >= BURN_IN
        before = model.pairs
        model.pairs = stage(swept(before, shared, spark.sparkContext.broadcast(world), sweep, keep, seed, model.top))
        unstage(before)
        world = world_of(summed(model.pairs, size), words, kinds, d)
        if keep:
            model.worlds.append(world)
    return model


class Judge:
    """Averaged predictive probabilities of pairs that fall into one bucket, known there or not."""

    def __init__(self, s: dict[str, np.ndarray], words: Words, worlds: list[World], tokens: int, kinds: int) -> None:
        self.b, self.words, self.worlds = Bucket(words, s["ctx"], s["w"], s["c"]), words, worlds
        self.samples = [(s[f"t{BURN_IN + i}"].astype(float), s[f"gt{BURN_IN + i}"].astype(float)) for i in range(len(worlds))]
        self.size = tokens + 0.5 * (kinds + 1)

    @staticmethod
    def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether it is there)."""
        if not len(known):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        by = np.argsort(known)
        at = by[np.minimum(np.searchsorted(known, asked, sorter=by), len(known) - 1)]
        return at, known[at] == asked

    def of(self, ctx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability, whether the word is known, base probability)."""
        b = self.b
        row, has_row = self.find(pair_key(b.ctx, b.w), pair_key(ctx, w))
        gctx = self.words.ending_of(ctx) + self.words.contexts
        group, has_group = self.find(pair_key(b.gctx, b.gw), pair_key(gctx, w))
        kind, has_kind = self.find(b.gw[b.kind], w)
        rare = w >= RARE
        at_code = np.where(rare, 0, w).astype(np.int64)
        first = b.kind[kind] if len(b.kind) else kind
        pick = lambda x, at, there: np.where(there, x[at], 0) if len(x) else np.zeros(len(w))
        count = np.where(rare, pick(b.learnt(), first, has_kind), self.words.count[at_code])
        own, p = ctx < self.words.contexts, np.zeros(len(w))
        for world, (t, gt) in zip(self.worlds, self.samples, strict=True):
            root = np.where(rare, pick(b.root(world, gt), first, has_kind), world.root[at_code])
            q = world.p(gctx, pick(b.customers(t), group, has_group), pick(gt, group, has_group), world.root_p(root), 1)
            q = np.where(own, world.p(ctx, pick(b.c.astype(float), row, has_row & own), pick(t, row, has_row & own), q, 2), q)
            p += q / len(self.worlds)
        return p, count > 0, (count + 0.5) / self.size


def top_pairs(model: Model, shared) -> tuple[np.ndarray, ...]:
    """(sorted pair keys, log10 probabilities, log10 base probabilities) of the pairs that occur most often."""
    least, kinds, tokens = model.top, model.kinds, model.tokens
    worlds = model.pairs.sparkSession.sparkContext.broadcast(model.worlds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column("state").to_pylist():
                s = unpack(state)
                top = np.flatnonzero(octave(s["c"]) >= least)
                ctx, w = s["ctx"][top].astype(np.int64), s["w"][top]
                p, _, base = Judge(s, shared.value, worlds.value, tokens, kinds).of(ctx, w)
                yield pa.RecordBatch.from_arrays([pa.array(pair_key(ctx, w).view(np.int64)), pa.array(np.log10(p)), pa.array(np.log10(base))], names=["key", "p", "base"])

    found = model.pairs.select("state").mapInArrow(run, "key long, p double, base double").toArrow()
    key = found.column("key").to_numpy().view(bh.U)
    by = np.argsort(key)
    return key[by], found.column("p").to_numpy()[by], found.column("base").to_numpy()[by]


def shares_of(model: Model) -> tuple[dict[int, tuple[int, int]], int]:
    """({bucket: (number of its second share, shares)}, all numbers): buckets whose pairs texts ask for more often than
    BUCKET_TOKENS are split among the texts that ask; the first share keeps the bucket's number."""
    most = BUCKET_TOKENS
    hot = model.pairs.where(F.col("asks") > most).select("bucket", "asks").orderBy("bucket").collect()  # a row a bucket at most
    out, total = {}, model.buckets
    for bucket, asks in hot:
        n = -(-asks // most)
        out[bucket] = (total, n)
        total += n - 1
    return out, total


ASKED_NAMES = ("bucket", "home", "kind", "value")
ASKED = "bucket int, home int, kind string, value binary"


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 3, contexts: int = CONTEXTS, samples: int = SAMPLES
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod 5 equal to 1 are held out; the model learns from all the others, rows
    without an id too. Null texts are empty: their one token is the end. Scores are log10 probabilities of the words
    (lower-cased, A-Z) and the end; a text's perplexity is 10 ** (-score / n_tokens). Other columns are ignored, whatever
    their names; rows that repeat are learnt from and scored each; an empty table gives none. Words are told apart by
    64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(docs.where(learnt(F.col("doc_id"))), seed, contexts, samples)
    context = docs.sparkSession.sparkContext
    tokens, kinds, buckets = model.tokens, model.kinds, model.buckets
    homes = docs.count() // HOME_DOCS + 1
    shared, worlds = context.broadcast(model.words), context.broadcast(model.worlds)
    best = context.broadcast(top_pairs(model, shared))
    shares, total = shares_of(model)
    share_of = context.broadcast(shares)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (keys, top_p, top_base) = shared.value, best.value
        for batch, w in bh.rows(batches, "text", lower=True):
            ctx, word, doc = pairs_of(w, words)
            n_docs = batch.num_rows
            key = pair_key(ctx, word)
            hit = np.zeros(len(key), bool)
            at = np.zeros(len(key), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
            sums = [np.bincount(doc[hit], x, n_docs) for x in (np.ones(int(hit.sum())), top_base[at[hit]], top_p[at[hit]])]
            refs, ids = batch.column("ref").to_numpy().view(bh.U), batch.column("doc_id")
            home = (refs % bh.U(homes)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            out = [(h % buckets, h, "own", v) for h, v in by_bucket(
                home[by], ref=refs[by], doc_id=ids.fill_null(0).to_numpy(zero_copy_only=False)[by], valid=np.array(ids.is_valid())[by],
                n=(np.diff(w.first) + 1)[by], known=sums[0][by], base=sums[1][by], score=sums[2][by])]
            # What else the texts hold, each pair once a text.
            left = np.flatnonzero(~hit)
            left = left[np.lexsort((key[left], doc[left]))]
            first = starts_of(doc[left], key[left]) if len(left) else left
            times = np.diff(np.append(first, len(left)))
            ctx, word, doc = ctx[left[first]], word[left[first]], doc[left[first]]
            bucket = bucket_of(words, ctx, word, buckets)
            if share_of.value:
                begin, n = (np.array([share_of.value.get(b, (b, 1))[i] for b in range(buckets)]) for i in (0, 1))
                of = (bh.mix(refs)[doc] % n[bucket].astype(bh.U)).astype(np.int64)
                bucket = np.where(of > 0, begin[bucket] + of - 1, bucket)
            by = np.lexsort((doc, word, ctx, bucket))
            for b, v in by_bucket(bucket[by], ctx=ctx[by].astype(np.uint32), w=word[by], doc=doc[by].astype(np.uint32), times=times[by].astype(np.uint32)):
                out.append((b, None, "ask", pickle.dumps((refs.tobytes(), v))))
            yield from asked_rows(out).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        words, kind = shared.value, table.column("kind").to_pylist()
        values = table.column("value").to_pylist()
        asks = [pickle.loads(v) for v, k in zip(values, kind, strict=True) if k == "ask"]
        passed = list(zip(*[[x for x, k in zip(table.column(n).to_pylist(), kind, strict=True) if k == "own"] for n in ASKED_NAMES], strict=True))
        if not asks:
            return asked_rows(passed)
        state = next((unpack(v) for v, k in zip(values, kind, strict=True) if k == "pairs"), None)
        if state is None:
            none = np.zeros(0, np.int64)
            state = {"ctx": none, "w": none.view(bh.U), "c": none} | {f"{x}{BURN_IN + i}": none for x in ("t", "gt") for i in range(len(worlds.value))}
        parts = [unpack(v) | {"refs": np.frombuffer(r, bh.U)} for r, v in asks]
        ref = np.concatenate([p["refs"][p["doc"]] for p in parts])
        ctx, w, times = (np.concatenate([p[n] for p in parts]) for n in ("ctx", "w", "times"))
        del parts, asks, values
        u, at, name = np.unique(pair_key(ctx, w), return_index=True, return_inverse=True)
        p, known, base = Judge(state, words, worlds.value, tokens, kinds).of(ctx[at].astype(np.int64), w[at])
        who, place = np.unique(ref, return_inverse=True)
        known, base, score = (np.bincount(place, times * x[name], len(who)) for x in (known, np.log10(base), np.log10(p)))
        home = (who % bh.U(homes)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        return asked_rows(passed + [(None, h, "part", v) for h, v in by_bucket(home[by], ref=who[by], known=known[by], base=base[by], score=score[by])])

    def gather(table: pa.Table) -> pa.Table:
        parts = {k: [unpack(v) for v, x in zip(table.column("value").to_pylist(), table.column("kind").to_pylist(), strict=True) if x == k] for k in ("own", "part")}
        if not parts["own"]:
            return pa.table({n: pa.array([], k) for n, k in zip(("doc_id", "n", "known", "base", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        own = {n: np.concatenate([p[n] for p in parts["own"]]) for n in ("ref", "doc_id", "valid", "n")}
        who, place, copies = np.unique(own["ref"], return_inverse=True, return_counts=True)
        total = {n: np.zeros(len(who)) for n in ("known", "base", "score")}
        for p in parts["own"] + parts["part"]:
            to = np.searchsorted(who, p["ref"])
            for n, x in total.items():
                x += np.bincount(to, p[n], len(who))
        known, base, score = ((total[n] / copies)[place] for n in ("known", "base", "score"))
        return pa.table({
            "doc_id": pa.array(own["doc_id"], pa.int64(), mask=~own["valid"].astype(bool)), "n": pa.array(own["n"].astype(np.int64)),
            "known": pa.array(np.round(known).astype(np.int64)), "base": pa.array(base), "score": pa.array(score),
        })

    asked = docs.withColumn("ref", F.xxhash64("doc_id", "text")).mapInArrow(ask, ASKED)
    pairs = model.pairs.select("bucket", F.lit(None).cast("int").alias("home"), F.lit("pairs").alias("kind"), F.col("state").alias("value"))
    if shares:  # the state of a bucket that is asked a great deal lies in each of its shares
        more = [(b, begin + i) for b, (begin, n) in shares.items() for i in range(n - 1)]
        copies = docs.sparkSession.createDataFrame(more, "bucket int, share int")
        pairs = pairs.union(pairs.join(F.broadcast(copies), "bucket").select(F.col("share").alias("bucket"), "home", "kind", "value"))
    answers = by_key(asked.union(pairs), total, "bucket").groupBy("bucket").applyInArrow(answer, ASKED)
    found = by_key(answers, homes, "home").groupBy("home").applyInArrow(gather, "doc_id long, n long, known long, base double, score double")
    return found.select(
        "doc_id", (~learnt(F.col("doc_id"))).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )


def asked_rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(ASKED_NAMES, columns, kinds, strict=True)})
