"""A byte-level convolutional network in numpy that scores the quality of whole documents.

Bytes have learned vectors; learned filters run over overlapping chunks that cover the whole document. The filters'
outputs are max-pooled over each chunk; over the chunks the largest and the mean of those pooled values are combined
into one probability. A chunk begins `WIDTH - 1` bytes before the last one's end, so no window is missed.

The network is fitted by Adam on a bounded sample of labelled rows (SAMPLE_ROWS, half of each label); scoring covers
every byte of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytehash as bh

WIDTH, EMBED, FILTERS, CHUNK = 6, 6, 16, 128
#: Labelled rows, half of each label, that the network is fitted on at most; their bytes are bounded as well, by label.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 12 << 20
EPOCHS = 24
F4 = np.float32


class Net:
    """Parameters: byte vectors e, filters w (WIDTH * EMBED, FILTERS) and b, output weights v (2 * FILTERS) and c."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBED)).astype(F4), "w": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(F4),
            "b": np.zeros(FILTERS, F4), "v": rng.normal(0, 0.1, 2 * FILTERS).astype(F4), "c": np.zeros(1, F4),
        }

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): the largest output of each filter in each chunk; data: (chunks, CHUNK + WIDTH - 1) bytes."""
        p = self.p
        best = None
        x = p["e"][data]
        for part in range(0, CHUNK, 32):  # a part of the chunk at a time keeps the windows in cache
            cols = np.lib.stride_tricks.sliding_window_view(x[:, part : part + 32 + WIDTH - 1], WIDTH, axis=1)
            out = cols.transpose(0, 1, 3, 2).reshape(-1, WIDTH * EMBED) @ p["w"]
            top = out.reshape(len(data), -1, FILTERS).max(axis=1)
            best = top if best is None else np.maximum(best, top)
        return np.maximum(best + p["b"], 0)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of the documents whose chunks begin at `first`."""
        counts = np.diff(np.append(first, len(pooled)))[:, None]
        seen = np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts], axis=1)
        # Summed row by row: a document's score does not depend on the others of its batch.
        return 1 / (1 + np.exp(-((seen * self.p["v"]).sum(axis=1) + self.p["c"]).astype(np.float64)))


def rounded(x: np.ndarray, most: int) -> np.ndarray:
    """x as multiples, of `most` at most, of a power of two."""
    step = 2.0 ** np.ceil(np.log2(max(float(np.abs(x).max()), 1e-30) / most))
    return (np.round(x / step) * step).astype(F4)


def exact(net: Net) -> Net:
    """The network with vectors of 8 bits and filters of 10: sums of WIDTH * EMBED products fit into the 24 bits of single
    precision, so that they are exact, and a score does not depend on which chunks are multiplied together."""
    net.p["e"], net.p["w"] = rounded(net.p["e"], 127), rounded(net.p["w"], 511)
    return net


def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks as rows, first chunk of each document): each document padded with zero bytes to whole chunks."""
    size = np.diff(off)
    n = np.maximum(1, -(-size // CHUNK))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.zeros(int(first[-1]) * CHUNK + WIDTH, np.uint8)
    index = np.arange(len(buf)) + np.repeat(first[:-1] * CHUNK - off[:-1], size)
    at[index] = buf
    rows = np.lib.stride_tricks.as_strided(at, (int(first[-1]), CHUNK + WIDTH - 1), (CHUNK, 1)).copy()
    last = np.zeros(int(first[-1]), bool)
    last[first[1:] - 1] = True
    rows[last, CHUNK:] = 0  # what follows a document's last chunk is another document
    return rows, first[:-1]


def scores(net: Net, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows, first = cut(buf, off)
    pooled = np.concatenate([net.pooled(rows[i : i + 256]) for i in range(0, len(rows), 256)])
    return net.combine(pooled, first)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Net:
    """Adam on batches of whole documents, classes weighted alike; the gradient of a maximum goes to where it was."""
    net, rng = Net(seed), np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            batch, p = order[lo : lo + 32], net.p
            parts = [np.frombuffer(texts[i], np.uint8) for i in batch]
            off = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            rows, first = cut(np.concatenate(parts), off)
            x = p["e"][rows]
            cols = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(-1, WIDTH * EMBED)
            out = (cols @ p["w"]).reshape(len(rows), CHUNK, FILTERS)
            arg = out.argmax(axis=1)
            raw = np.take_along_axis(out, arg[:, None], axis=1)[:, 0] + p["b"]
            pooled = np.maximum(raw, 0)
            counts = np.diff(np.append(first, len(rows)))
            doc = np.repeat(np.arange(len(batch)), counts)
            top = np.maximum.reduceat(pooled, first)
            seen = np.concatenate([top, np.add.reduceat(pooled, first) / counts[:, None]], axis=1)
            prob = 1 / (1 + np.exp(-(seen @ p["v"] + p["c"])))
            d = ((prob - labels[batch]) * weight[batch] / len(batch)).astype(F4)
            grad = {"v": seen.T @ d, "c": d.sum(keepdims=True)}
            to = d[:, None] * p["v"][None]
            is_top = pooled == top[doc]
            share = is_top / np.maximum(1, np.add.reduceat(is_top.astype(F4), first))[doc]
            g = (share * to[doc, :FILTERS] + to[doc, FILTERS:] / counts[doc][:, None]) * (raw > 0)
            grad["b"] = g.sum(axis=0)
            hit = (np.arange(len(rows))[:, None] * CHUNK + arg).ravel()  # the windows that were the largest
            gw = np.zeros_like(p["w"])
            gx = np.zeros((len(hit), WIDTH * EMBED), F4)
            taken = cols[hit].reshape(len(rows), FILTERS, -1)
            gw += np.einsum("rfk,rf->kf", taken, g)
            gx = (g[:, :, None] * p["w"].T[None]).reshape(-1, WIDTH, EMBED)
            grad["w"], ge = gw, np.zeros_like(p["e"])
            used = rows[np.repeat(np.arange(len(rows)), FILTERS)[:, None], (arg.ravel()[:, None] + np.arange(WIDTH))]
            for k in range(EMBED):
                ge[:, k] = np.bincount(used.ravel(), gx[:, :, k].ravel(), 256)
            grad["e"] = ge
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-3
            for k, value in net.p.items():
                m, s = moments[k]
                m += 0.1 * (grad[k] - m)
                s += 0.01 * (grad[k] ** 2 - s)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(F4)
    return exact(net)


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, target: str, held_out: tuple[int, int], rows: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """At most `rows` whole labelled texts, half of each label, in the order of a hash of their ids.

    A label has half of `most_bytes`; a text that does not fit into what is left of it is passed over, and those behind
    it still count. Of rows that share a doc_id the shortest is taken, then the least text.
    """
    folds, out = held_out
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold(F.col("doc_id"), folds) != out))
    known = known.groupBy("doc_id").agg(F.max(target).alias("label"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    sized = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(size).alias("bytes")).join(known, "doc_id")
    most = most_bytes // 2
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = [sized.where((F.col("label") == y) & (F.col("bytes") <= most)).orderBy(*order).limit(rows // 2) for y in (0, 1)]
    left, chosen = {0: most, 1: most}, []
    for row in half[0].union(half[1]).orderBy(*order).collect():  # at most `rows` rows without their texts
        if row.bytes <= left[row.label]:
            left[row.label] -= row.bytes
            chosen.append((row.doc_id, row.bytes, row.label))
    missing = {0, 1} - {y for _, _, y in chosen}
    if missing and sized.where(F.col("label").isin(*missing)).head(1):
        raise ValueError(f"no labelled text of label {min(missing)} has at most {most} bytes or `rows` is under 2")
    wanted = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bytes long, label int")
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    got = got.join(F.broadcast(wanted), ["doc_id", "bytes"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(*order).collect()
    return [row.text.encode() for row in got], np.array([row.label for row in got])


def quality_scores(
    docs: DataFrame, labels: DataFrame, target: str = "quality", held_out: tuple[int, int] = (4, 2), cutoff: float = 0.7,
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """`docs` plus held_out, score and predicted (score >= cutoff).

    Labels of documents with crc32(doc_id as text) mod held_out[0] equal to held_out[1] are never learned from. Only
    the text enters a score. The network is fitted on at most `sample_rows` labelled rows and `sample_bytes` bytes. An
    empty table gives an empty result; rows that share a doc_id are scored each. Null and empty texts are scored as a chunk of zero bytes. Without both labels in the
    sample every score is the share of label 1 in it, 0.5 if it is empty. Columns of these names are replaced.
    """
    texts, ys = training_sample(docs, labels, target, held_out, sample_rows, sample_bytes)
    flat = float(ys.mean()) if len(ys) else 0.5
    net = fit(texts, ys) if len(set(ys.tolist())) == 2 else None
    docs = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = bh.texts(batch.column("text"))
            got = [np.zeros(0)]
            for lo, hi in bh.chunks(off):
                own = off[lo : hi + 1] - off[lo]
                got.append(scores(net, buf[off[lo] : off[hi]], own) if net else np.full(hi - lo, flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got))], names=[*batch.schema.names, "score"])

    out = docs.mapInArrow(run, schema)
    held = F.coalesce(fold(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False))
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
