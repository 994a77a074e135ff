"""Removal of byte strings that also start in an earlier document, by suffix arrays.

A window is `window` successive bytes of one document. Its anchor is the place inside it whose KGRAM bytes have the
least hash; successive windows with one anchor make a span, so each window lies in one span and equal windows have
equal anchors at equal places. Anchors' hashes are counted over the corpus first: spans whose anchor's bytes occur in
one document only hold no repeat and go no further. The others go to the bucket of their anchor's hash (or, for bytes
that a great many documents have, window by window to that of the window's), where equal ones are one.

A bucket aligns its distinct spans at their anchors, reads eight bytes as one symbol and sorts the suffixes that begin
at symbols (suffixarray). Where neighbours in that order agree for long enough, the windows that begin in the symbol
ahead are equal if their bytes in it are; each such set of windows takes the least document, and a window is removed
wherever it starts in a later one.

Documents are dealt to homes by a row number, and all messages speak of places in a home; its texts lie in the order of
the row numbers, so each step finds the same places.
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
from .suffixarray import suffix_array

WINDOW = 50
#: Bytes of an anchor; a span then has at most window - KGRAM + 1 windows.
KGRAM = 16
#: Bytes of text in a home and in a bucket, each in a task of its own: raise both with the executors' memory.
HOME_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: An anchor's bytes that more homes than this have are dealt window by window.
HOT_HOMES = 2_000
#: Window starts handled at once, and symbols sorted at once unless one anchor's spans are more.
STARTS = 1 << 20
SYMBOLS = 1 << 17
WORD = 8
_NUMBER = bh.mix(np.arange(1, 257, dtype=bh.U) * bh.U(0x9E3779B97F4A7C15))
_PLACE = bh.U((1 << 21) - 1)
NO_ID = np.iinfo(np.int64).max


class Home:
    """The texts of a home end to end: buf, off (of the documents), ids, and the spans of its windows."""

    def __init__(self, table: pa.Table, window: int) -> None:
        table = table.combine_chunks()
        order = np.argsort(table.column("row").to_numpy())
        self.table = table.take(pa.array(order))
        self.buf, self.off = bh.texts(self.table.column("text"))
        self.ids = self.table.column("id").to_numpy()
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.off))
        self.window = window

    def spans(self) -> tuple[np.ndarray, ...]:
        """(start, windows, anchor, hash) of each span."""
        width = self.window - KGRAM + 1
        out = []
        ends = self.off[1:]
        for lo in range(0, len(self.buf), STARTS):
            part = self.buf[lo : lo + STARTS + self.window - 1]
            if len(part) < self.window:
                break
            grams = bh.windows(_NUMBER[part], KGRAM)
            # The hash above the place: the least is the first of those with the least hash.
            low = _least(grams & ~_PLACE | np.arange(len(grams), dtype=bh.U), width)
            at = (low & _PLACE).astype(np.int64)
            start = np.arange(lo, lo + len(low))
            inside = start + self.window <= ends[self.doc[lo : lo + len(low)]]
            head = inside.copy()
            head[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
            first = np.flatnonzero(head)
            seen = np.append(np.cumsum(inside), inside.sum())
            n = seen[np.append(first[1:], len(inside)) - 1] - seen[first] + 1 if len(first) else first
            out.append((first + lo, n, at[first] + lo, grams[at[first]]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.view(bh.U))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64), len(x))


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) of each bucket, in ascending order."""
    order = np.argsort(bucket, kind="stable")
    cuts = _runs(bucket[order])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _array(table: pa.Table, name: str, kind: type, row: int) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_py(), kind)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


ASK = "bucket int, home int, hashes binary, several binary"
TOLD = "home int, bucket int, shared binary, hot binary"
SENT = "bucket int, home int, bytes binary, sizes binary, anchors binary, span binary, ids binary, places binary"
GONE = "home int, places binary, masks binary"


def _distinct(home: Home, hashes: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and whether documents of different ids have them in this home."""
    order = np.argsort(hashes, kind="stable")
    ids = home.ids[home.doc[anchors[order]]] if len(order) else np.zeros(0, np.int64)
    cuts = _runs(hashes[order])
    if len(cuts) == 1:
        return hashes[:0], np.zeros(0, bool)
    return hashes[order][cuts[:-1]], np.minimum.reduceat(ids, cuts[:-1]) != np.maximum.reduceat(ids, cuts[:-1])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (bh.mix(hashes) % bh.U(buckets)).astype(np.int32)


def ask(table: pa.Table, window: int, buckets: int) -> pa.Table:
    """A home's anchors' hashes by bucket."""
    home = Home(table, window)
    _, _, anchors, hashes = home.spans()
    known, several = _distinct(home, hashes, anchors)
    number = int(table.column("home")[0].as_py())
    return _table([(b, number, known[i].tobytes(), several[i].tobytes()) for b, i in _dealt(_bucket(known, buckets))], ASK)


def tell(table: pa.Table, hot_homes: int) -> pa.Table:
    """For each home's hashes, whether other documents have them too, and whether very many homes have."""
    sent = [_array(table, "hashes", bh.U, i) for i in range(table.num_rows)]
    several = np.concatenate([_array(table, "several", bool, i) for i in range(table.num_rows)])
    known, name, homes = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared, hot = (homes[name] > 1) | several, homes[name] > hot_homes
    bucket, out, at = int(table.column("bucket")[0].as_py()), [], 0
    for i, h in enumerate(sent):
        part = slice(at, at + len(h))
        out.append((table.column("home")[i].as_py(), bucket, np.packbits(shared[part]).tobytes(), np.packbits(hot[part]).tobytes()))
        at += len(h)
    return _table(out, TOLD)


def send(texts: pa.Table, told: pa.Table, window: int, buckets: int) -> pa.Table:
    """A home's spans whose anchors are shared: the distinct ones' bytes, and for each where it lies and its document's id."""
    if not texts.num_rows or not told.num_rows:
        return _table([], SENT)
    home = Home(texts, window)
    start, n, anchor, hashes = home.spans()
    known, _ = _distinct(home, hashes, anchor)
    shared, hot = np.zeros(len(known), bool), np.zeros(len(known), bool)
    by_bucket = {b: i for i, b in enumerate(told.column("bucket").to_pylist())}
    for b, i in _dealt(_bucket(known, buckets)):
        for flags, name in ((shared, "shared"), (hot, "hot")):
            flags[i] = np.unpackbits(_array(told, name, np.uint8, by_bucket[b]), count=len(i)).astype(bool)
    at = np.searchsorted(known, hashes)
    cold, single = np.flatnonzero(shared[at] & ~hot[at]), np.flatnonzero(shared[at] & hot[at])
    # Windows of hot anchors become spans of their own.
    more = np.repeat(start[single] - np.cumsum(n[single]) + n[single], n[single]) + np.arange(int(n[single].sum()))
    own = bh.windows(_NUMBER[home.buf], window)[more] if len(more) else hashes[:0]
    start, n, anchor, hashes = (np.concatenate([x[cold], y]) for x, y in ((start, more), (n, np.ones_like(more)), (anchor, np.repeat(anchor[single], n[single])), (hashes, own)))
    data, seen, span, first = home.buf.tobytes(), {}, [], []
    for i, (a, b) in enumerate(zip(start.tolist(), (start + n + window - 1).tolist(), strict=True)):
        s = data[a:b]
        k = seen.get(s)
        if k is None:
            k = seen[s] = len(first)
            first.append(i)
        span.append(k)
    distinct, span, first = list(seen), np.array(span, np.int32), np.array(first, np.int64)
    del seen
    size, ahead = (n[first] + window - 1).astype(np.uint8), (anchor[first] - start[first]).astype(np.uint8)
    bucket = _bucket(hashes[first], buckets)
    local, parts = np.zeros(len(first), np.int32), []
    for b, i in _dealt(bucket):
        local[i] = np.arange(len(i))
        parts.append((b, i))
    number, out = int(texts.column("home")[0].as_py()), []
    ids, occurrences = home.ids[home.doc[start]] if len(start) else start, dict(_dealt(bucket[span] if len(span) else span))
    for b, i in parts:
        o = occurrences[b]
        out.append((b, number, b"".join([distinct[k] for k in i.tolist()]), size[i].tobytes(), ahead[i].tobytes(), local[span[o]].tobytes(), ids[o].tobytes(), start[o].astype(np.int32).tobytes()))
    return _table(out, SENT)


def least_ids(text: np.ndarray, size: np.ndarray, ahead: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Per window of distinct spans (end to end in `text`), the least id of all spans that hold the same window."""
    lead = (-ahead) % WORD
    words = (lead + size + WORD - 1) // WORD
    begin = (np.cumsum(words) - words) * WORD + lead  # of each span in the aligned bytes
    place = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(text))
    aligned = np.zeros(int(words.sum()) * WORD, np.uint8)
    aligned[place] = text
    symbols = aligned.view(">u8").astype(bh.U)
    order = suffix_array(np.unique(symbols, return_inverse=True)[1])
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    # Bytes that neighbours in the order have in common, as far as a window asks.
    padded = np.append(symbols, np.zeros(window // WORD + 2, bh.U))
    common, going = np.zeros(len(order) - 1, np.int64), np.ones(len(order) - 1, bool)
    for d in range(window // WORD + 1):
        differ = padded[order[:-1] + d] ^ padded[order[1:] + d]
        same = sum((differ < bh.U(1 << 8 * k)).astype(np.int64) for k in range(1, WORD)) + (differ == 0)
        common += np.where(going, same, 0)
        going &= differ == 0
    n = size - window + 1
    start = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    own = np.repeat(ids, n)
    out = np.empty(len(start), np.int64)
    for inside in range(WORD):
        picked = np.flatnonzero(start % WORD == inside)
        if not len(picked):
            continue
        at = start[picked] // WORD
        ahead_bytes = symbols[at] & bh.U((1 << 8 * (WORD - inside)) - 1)
        run = np.append(0, np.cumsum(common < window - WORD + inside))[rank[at + 1]]
        by = np.lexsort((ahead_bytes, run))
        head = np.append(True, (run[by][1:] != run[by][:-1]) | (ahead_bytes[by][1:] != ahead_bytes[by][:-1]))
        cuts = np.flatnonzero(head)
        least = np.minimum.reduceat(own[picked][by], cuts)
        out[picked[by]] = np.repeat(least, np.diff(np.append(cuts, len(by))))
    return out


def judge(table: pa.Table, window: int) -> pa.Table:
    """For a bucket's spans, by home: places of those with windows to remove, and these windows as bits."""
    seen: dict[bytes, int] = {}
    ahead, span, ids, places, home = [], [], [], [], []
    for i in range(table.num_rows):
        data, size, lead = table.column("bytes")[i].as_py(), _array(table, "sizes", np.uint8, i), _array(table, "anchors", np.uint8, i)
        ends = np.cumsum(size, dtype=np.int64)
        numbers = []
        for a, b, x in zip((ends - size).tolist(), ends.tolist(), lead.tolist(), strict=True):
            s = data[a:b]
            k = seen.get(s)
            if k is None:
                k = seen[s] = len(seen)
                ahead.append(x)
            numbers.append(k)
        span.append(np.array(numbers, np.int32)[_array(table, "span", np.int32, i)])
        ids.append(_array(table, "ids", np.int64, i))
        places.append(_array(table, "places", np.int32, i))
        home.append(np.full(len(span[-1]), table.column("home")[i].as_py(), np.int32))
    span, ids, places, home = (np.concatenate(x) for x in (span, ids, places, home))
    distinct, ahead = list(seen), np.array(ahead, np.int64)
    del seen
    size = np.array([len(s) for s in distinct], np.int64)
    order = np.argsort(span, kind="stable")
    least = np.minimum.reduceat(ids[order], _runs(span[order])[:-1])
    # Spans of one anchor's bytes together, some anchors at a time.
    text, first = np.frombuffer(b"".join(distinct), np.uint8), np.cumsum(size) - size
    gram = np.stack([text[first + ahead + k] for k in range(KGRAM)], 1).view(">u8")
    by = np.lexsort((gram[:, 1], gram[:, 0]))
    cuts = np.flatnonzero(np.append(True, (gram[by][1:] != gram[by][:-1]).any(1)))
    words = np.cumsum(size[by] // WORD + 2)
    windows = size - window + 1
    begin = np.cumsum(windows) - windows
    out_ids = np.empty(int(windows.sum()), np.int64)
    lo = 0
    while lo < len(by):
        hi = int(np.searchsorted(words, (words[lo - 1] if lo else 0) + SYMBOLS))
        later = cuts[(cuts > lo) & (cuts <= max(hi, lo + 1))] if hi < len(by) else cuts[:0]
        hi = len(by) if hi >= len(by) else int(later[-1]) if len(later) else int(np.append(cuts[cuts > lo], len(by))[0])
        part = by[lo:hi]
        joined = np.frombuffer(b"".join([distinct[k] for k in part.tolist()]), np.uint8)
        found = least_ids(joined, size[part], ahead[part], least[part], window)
        n = windows[part]
        out_ids[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(len(found))] = found
        lo = hi
    n = windows[span]
    place = np.repeat(begin[span] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    bit = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    gone = (out_ids[place] < np.repeat(ids, n)).astype(bh.U) << bit.astype(bh.U)
    masks = np.bitwise_or.reduceat(gone, np.cumsum(n) - n)
    hit = np.flatnonzero(masks)
    return _table([(h, places[hit[i]].tobytes(), masks[hit[i]].tobytes()) for h, i in _dealt(home[hit])], GONE)


def remove(texts: pa.Table, gone: pa.Table, window: int, with_text: bool) -> pa.Table:
    """The rows of a home without the bytes under its windows to remove."""
    home = Home(texts, window)
    level = np.zeros(len(home.buf) + 1, np.int32)
    starts = np.zeros(len(home.buf), bool)
    for i in range(gone.num_rows):
        places, masks = _array(gone, "places", np.int32, i), _array(gone, "masks", bh.U, i)
        for k in range(window - KGRAM + 1):
            starts[places[masks >> bh.U(k) & bh.U(1) == 1] + k] = True
    at = np.flatnonzero(starts)
    level[at] += 1
    np.subtract.at(level, at + window, 1)
    out = np.cumsum(level[:-1]) > 0
    begins = out.copy()
    begins[1:] &= ~out[:-1] | (home.doc[1:] != home.doc[:-1])
    removed, spans = (np.append(0, np.cumsum(x))[home.off] for x in (out, begins))
    kept, size = home.buf[~out].tobytes(), np.diff(home.off)
    n_removed = np.diff(removed)
    ends = np.cumsum(size - n_removed)
    texts_kept = [kept[a:b] for a, b in zip((ends - size + n_removed).tolist(), ends.tolist(), strict=True)]
    columns = {"doc_id": home.table.column("doc_id"), "n_bytes": size, "n_removed": n_removed, "n_spans": np.diff(spans), "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts_kept]}
    return pa.table(columns | ({"kept": pa.array(texts_kept, pa.binary())} if with_text else {}))


def remove_later_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False,
    home_bytes: int = HOME_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_homes: int = HOT_HOMES,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes (binary).

    A byte is removed if a window of `window` bytes over it also starts in a row of a smaller doc_id (an integer).
    Windows are judged on the input. A null text is empty; a null doc_id is above all others; rows of one doc_id remove
    nothing of each other, so rows that repeat stay or go alike. An empty table gives an empty result; other columns,
    whatever their names, are ignored. A very long text is a home of its own, and memory grows with it.
    """
    if not 32 <= window <= 79:  # a span's windows are bits of one number and its bytes fit into a byte's count
        raise ValueError("a window has 32 to 79 bytes")
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer, not {kind}")
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    homes, buckets = max(8, -(-size // home_bytes)), max(8, -(-size // bucket_bytes))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("home", F.pmod(F.xxhash64("row"), F.lit(homes)).cast("int"))
    texts = by_key(rows, homes, "home").groupBy("home")
    asked = texts.applyInArrow(lambda t: ask(t, window, buckets), ASK)
    told = by_key(asked, buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: tell(t, hot_homes), TOLD)
    sent = texts.cogroup(by_key(told, homes, "home").groupBy("home")).applyInArrow(lambda t, a: send(t, a, window, buckets), SENT)
    gone = by_key(sent, buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: judge(t, window), GONE)
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def finish(t: pa.Table, g: pa.Table) -> pa.Table:
        return remove(t, g, window, with_text)

    return texts.cogroup(by_key(gone, homes, "home").groupBy("home")).applyInArrow(finish, schema)
