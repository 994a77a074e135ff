"""Removal of long word sequences that occur more than once, by recompression.

Every text is a string of words. Rounds name runs of two equal words and then, twice, adjacent pairs: a symbol belongs
to the left or the right half of the alphabet by its own hash, and a left symbol followed by a right one becomes one
symbol, named by a hash of the two, so that all executors give the same names with nothing to exchange. A symbol's
shape depends on few words around it: of a repeated window of `window` words, all but EDGE words at each end are named
alike wherever it occurs. In those inner words each window has one anchor, the least symbol that starts there. Anchors
with the words around them are the shared symbols that reveal repeats: they are counted over all documents, and only
windows whose anchor is shared are hashed and counted themselves, which verifies the repeat by 128 bits of its words.

A window of 35 words has room for these rounds only: each further one doubles the symbols and the words at a repeat's
ends that may be named differently, and a window would no longer be sure to hold an anchor.

Counting sends packed arrays to buckets by hash. Values that a piece of input holds several times are known as
repeated there and then: one of them is sent, and the places of all of them go to the buckets of their documents, so
a frequent passage loads no bucket with its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as bh
from .common import by_key

WINDOW = 35
#: Words at each end of a repeat that may be named differently: 2 for runs, 2 and 4 for the rounds of pairs.
EDGE = 8
LONGEST = 4
#: Bytes of text for each bucket, so that a bucket's windows fit into a task whatever the input.
BUCKET_BYTES = 16 << 20
NONE = bh.U(0xFFFFFFFFFFFFFFFF)


def symbols(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts of the symbols after the rounds; first: word offsets of the rows, which no symbol crosses."""
    names, starts, n = h, np.arange(len(h)), len(h)
    begins = np.zeros(n + 1, bool)
    begins[first] = True

    def join(left: np.ndarray, salt: int) -> None:
        nonlocal names, starts
        at = np.flatnonzero(left)
        names = names.copy()
        names[at] = bh.mix(names[at] * bh.U(0x9FB21C651E98DF25) + bh.mix(names[at + 1] + bh.U(salt)))
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, starts = names[keep], starts[keep]

    if n > 1:
        same = (h[1:] == h[:-1]) & ~begins[1:-1]
        alone = same.copy()  # runs of exactly two
        alone[1:] &= ~same[:-1]
        alone[:-1] &= ~same[1:]
        join(np.append(alone, False), 1)
        for salt in (2, 3):
            right = (bh.mix(names + bh.U(salt)) & bh.U(1)).astype(bool)
            ends = np.append(starts[1:], n)
            pair = np.append(~right[:-1] & right[1:], False)
            pair[:-1] &= ~begins[starts[1:]] & (ends[1:] - starts[:-1] <= LONGEST)
            join(pair, salt)
    return names, starts


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` successive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, low): per word the name of the symbol that starts there or NONE, and per word q the least of the
    `inner` values from q on. The window that starts at word i has its anchor where value is low[i + EDGE]."""
    names, starts = symbols(h, first)
    value = np.full(len(h), NONE, bh.U)
    value[starts] = names
    inner = window - 2 * EDGE - LONGEST + 1
    low = least(value, inner) if len(value) >= inner else np.zeros(0, bh.U)
    return value, low


def anchor_places(value: np.ndarray, low: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Words at which the anchor of some window lies."""
    inner = window - 2 * EDGE - LONGEST + 1
    picked = np.zeros(len(value), bool)
    i = inside(first, window)
    for step in range(EDGE, EDGE + inner):
        picked[step : step + len(i)] |= i & (value[step : step + len(i)] == low[EDGE : EDGE + len(i)])
    return np.flatnonzero(picked)


def inside(first: np.ndarray, window: int) -> np.ndarray:
    """Whether the window that starts at each word, as far as windows start, lies in one row."""
    sizes = np.diff(first)
    ends = np.repeat(first[1:], sizes)[: max(0, int(first[-1]) - window + 1)]
    return np.arange(len(ends)) + window <= ends


ASK = "bucket int, keys binary, checks binary, refs binary, places binary, many binary, known_refs binary, known_places binary"


def same(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of equal (key, check), in the order of neither."""
    order = np.lexsort((checks, keys))
    head = np.append(True, (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(head) - 1
    return out


def pack(keys: np.ndarray, checks: np.ndarray, refs: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of ASK: of each (key, check) one occurrence, and the places of those that occur here several times."""
    if not len(keys):
        return
    name = same(keys, checks)
    order = np.argsort(name, kind="stable")
    keys, checks, refs, places, name = keys[order], checks[order], refs[order], places[order].astype(np.int32), name[order]
    head = np.append(True, name[1:] != name[:-1])
    size = np.diff(np.append(np.flatnonzero(head), len(keys)))
    many = np.repeat(size > 1, size)
    k_refs, k_places = refs[many], places[many]
    k_bucket = (bh.mix(k_refs) % bh.U(buckets)).astype(np.int64)
    keys, checks, refs, places, many = keys[head], checks[head], refs[head], places[head], size > 1
    bucket = (bh.mix(keys) % bh.U(buckets)).astype(np.int64)
    a, b = np.argsort(bucket, kind="stable"), np.argsort(k_bucket, kind="stable")
    cut_a = np.searchsorted(bucket[a], np.arange(buckets + 1))
    cut_b = np.searchsorted(k_bucket[b], np.arange(buckets + 1))
    for x in np.flatnonzero((np.diff(cut_a) > 0) | (np.diff(cut_b) > 0)):
        p, q = a[cut_a[x] : cut_a[x + 1]], b[cut_b[x] : cut_b[x + 1]]
        yield (int(x), *[y[p].tobytes() for y in (keys, checks, refs, places, many)], k_refs[q].tobytes(), k_places[q].tobytes())


def packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    names = [x.split()[0] for x in ASK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]], names=names)


def packed_column(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


def heads(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins, and its end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int), len(x))


def repeated(asked: DataFrame, buckets: int) -> DataFrame:
    """(ref, places): per document the places whose keys occur more than once over all documents."""
    def find(table: pa.Table) -> pa.Table:
        keys, checks, refs, places = (packed_column(table, n, k) for n, k in (("keys", bh.U), ("checks", bh.U), ("refs", bh.U), ("places", np.int32)))
        if len(keys):
            name = same(keys, checks)
            hit = (np.bincount(name)[name] > 1) & ~packed_column(table, "many", bool)
            refs, places = refs[hit], places[hit]
        refs, places = np.concatenate([refs, packed_column(table, "known_refs", bh.U)]), np.concatenate([places, packed_column(table, "known_places", np.int32)])
        home = (bh.mix(refs) % bh.U(buckets)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        home, refs, places = home[order], refs[order], places[order]
        cuts = heads(home)
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({
            "home": pa.array(home[cuts[:-1]]), "refs": pa.array([refs[x:y].tobytes() for x, y in parts], pa.binary()),
            "places": pa.array([places[x:y].tobytes() for x, y in parts], pa.binary()),
        })

    def gather(table: pa.Table) -> pa.Table:
        refs, places = packed_column(table, "refs", bh.U), packed_column(table, "places", np.int32)
        order = np.argsort(refs, kind="stable")
        refs, places = refs[order], places[order]
        cuts = heads(refs)
        return pa.table({
            "ref": pa.array(refs[cuts[:-1]].view(np.int64)),
            "places": pa.array([places[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    found = by_key(asked, buckets, "bucket").groupBy("bucket").applyInArrow(find, "home int, refs binary, places binary")
    return by_key(found, buckets, "home").groupBy("home").applyInArrow(gather, "ref long, places binary")


def flags(column: pa.Array, first: np.ndarray) -> np.ndarray:
    """One boolean per word from each row's packed places."""
    out = np.zeros(first[-1], bool)
    for start, found in zip(first[:-1], column, strict=True):
        if found.is_valid:
            out[start + np.frombuffer(found.as_buffer(), np.int32)] = True
    return out


def refs_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("ref").to_numpy().view(bh.U)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their `ref`, (ref, places) of the starts of repeated windows)."""
    if window < 2 * EDGE + 2 * LONGEST:
        raise ValueError(f"a window has at least {2 * EDGE + 2 * LONGEST} words")
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("ref"), F.col(text_col).alias("text"))
    around = 2 * EDGE + LONGEST  # words, from EDGE before an anchor on, that all of its windows hold

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in bh.rows(batches, "text", lower=False):
            h = w.hashes()
            value, low = anchors(h, w.first, window)
            at = anchor_places(value, low, w.first, window)
            own = np.searchsorted(w.first, at, "right") - 1
            keys = bh.mix(value[at]) ^ bh.windows(h, around)[at - EDGE]
            yield packed(list(pack(keys, np.zeros_like(keys), refs_of(batch)[own], at - w.first[own], buckets)))

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in bh.rows(batches, "text", lower=False):
            h = w.hashes()
            value, low = anchors(h, w.first, window)
            shared = flags(batch.column("places"), w.first)
            i = np.flatnonzero(inside(w.first, window))
            if len(i):
                inner = window - 2 * EDGE - LONGEST + 1
                marked = least(np.where(shared, value, NONE), inner)
                i = i[marked[i + EDGE] == low[i + EDGE]]
            if len(i):
                own = np.searchsorted(w.first, i, "right") - 1
                # The second number is of the words' hashes mixed anew: a repeat is verified by 128 bits of its words.
                yield packed(list(pack(bh.windows(h, window)[i], bh.windows(bh.mix(h + bh.U(1)), window)[i], refs_of(batch)[own], i - w.first[own], buckets)))

    shared = repeated(rows.select("ref", "text").mapInArrow(ask_anchors, ASK), buckets)
    marked = rows.join(shared.hint("shuffle_hash"), "ref", "left")
    return rows, repeated(marked.mapInArrow(ask_windows, ASK), buckets)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and with_text the kept words as kept_text.

    A word is removed if it lies in a window of `window` words whose sequence also starts elsewhere, in this document
    or another one. Windows are judged on the input. A null text has no words; rows repeated as they are repeat their
    windows, as do equal texts; an empty table gives an empty result. Other columns, whatever their names, are ignored. Positions travel under a 64-bit hash of doc_id and text.
    """
    rows, found = repeated_spans(docs, id_col, text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in bh.rows(batches, "text", lower=False):
            hit = flags(batch.column("places"), w.first)
            level = np.zeros(len(hit) + window + 1, np.int32)
            starts = np.flatnonzero(hit)
            level[starts] += 1
            level[starts + window] -= 1
            gone = np.cumsum(level)[: len(hit)] > 0
            data, out = w.buf.tobytes(), []
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                kept = np.flatnonzero(~gone[a:b]) + a
                text = b" ".join([data[x:y] for x, y in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)])
                out.append((int(b - a), int(b - a - len(kept)), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            n, removed, digest, text = zip(*out, strict=True) if out else ([], [], [], [])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(text, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(found.hint("shuffle_hash"), "ref", "left").mapInArrow(run, schema)
