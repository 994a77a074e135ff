"""Alignment of two tokenizers' tokens over the bytes they share.

A text is cut into units at places that neither tokenizer joins tokens over: a space between two visible characters.
Inside mapInPandas each worker encodes the units that it has not met lately, and merges the cumulative ends of the two
sides' tokens with two pointers: each step ends a link between the current tokens, and where both end at once a group
ends. A unit's links and groups are kept in the worker, as texts repeat their units. Spark then counts id pairs over
the corpus, takes the highest count of each id of either side, and joins counts and maxima back to the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage

#: A space between visible characters: byte-level pre-tokenizers begin a token there, and pieces hold spaces only ahead.
CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")
#: The pre-tokens of byte-level tokenizers (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes two libraries might not agree on.
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
VISIBLE = re.compile(r"[!-~\w]*")
#: Units and links that a worker keeps before it starts anew.
KEPT_UNITS = 600_000
KEPT_LINKS = 6_000_000
#: Characters of text whose units are looked up at once.
CHUNK_CHARS = 1 << 21

_workers: dict[tuple[str, str], "Aligner"] = {}


def _byte_decoder() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library: ids of texts that begin with a space, and each id's bytes.

    If its ids follow its merges and its pre-tokenizer is the usual one, texts of Latin letters are encoded by tiktoken
    from the same vocabulary, which gives the same ids in a fraction of the time.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.inner.no_truncation()
        self.inner.no_padding()
        decoder = _byte_decoder()
        names = {i: t for t, i in self.inner.get_vocab(with_added_tokens=True).items()}
        special = {t.content for t in self.inner.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(names) + 1)
        for i, t in names.items():
            self.bytes[i] = t.encode() if t in special else bytes(decoder[c] for c in t)
        said = json.loads(self.inner.to_str())
        ahead, model = said.get("pre_tokenizer") or {}, said["model"]
        # The pre-tokenizer's own pattern begins a pre-token at each cut, and tokens do not cross pre-tokens.
        self.cuts = self.inner.normalizer is None and ahead.get("type") == "ByteLevel" and ahead.get("use_regex", True) and not ahead.get("add_prefix_space")
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        self.fast = None
        if self.cuts and model["type"] == "BPE" and merged == sorted(merged) and not model.get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in special}
            self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == max(ranks.values()) + 1 else None

    def encode(self, spaced: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self.slow(spaced)
        out = [self.fast.encode_ordinary(t) if t.isascii() or not BEYOND_LATIN.search(t) else None for t in spaced]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.slow([spaced[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def slow(self, spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in self.inner.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts the space ahead itself; and each id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.inner.id_to_piece(i) for i in range(self.inner.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.inner.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # A token over a cut would hold a space behind another byte.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.bytes)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return self.inner.encode([t[1:] for t in spaced], num_threads=1)


def load(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def merge(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """(links, groups) of two token lists over the same bytes.

    Links: a << 32 | b of tokens whose bytes overlap, in order. Groups: numbers of (a, b) tokens seen where both end.
    """
    i = j = 0
    n = len(a)
    links, groups = [], []
    if n:
        x, y = a[0], b[0]
        a_end, b_end = a_size[x], b_size[y]
    while i < n:
        links.append(x << 32 | y)
        if a_end == b_end:
            i += 1
            j += 1
            groups.append((i, j))
            if i < n:
                x, y = a[i], b[j]
                a_end += a_size[x]
                b_end += b_size[y]
        elif a_end < b_end:
            i += 1
            x = a[i]
            a_end += a_size[x]
        else:
            j += 1
            y = b[j]
            b_end += b_size[y]
    return links, groups


class Aligner:
    """Units of texts with their tokens, links and groups, kept as long as they are few."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> None:
        self.a, self.b = a, b
        self.a_size, self.b_size = [len(x) for x in a.bytes], [len(x) for x in b.bytes]
        self.a_name, self.b_name = [[str(i) for i in range(len(x.bytes))] for x in (a, b)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = array("q")
        self.links = array("q")
        self.first = array("q", [0])

    def units(self, text: str) -> list[str]:
        """The parts of a text between its cuts, without the space ahead of each."""
        if not (self.a.cuts and self.b.cuts):
            return [text]
        parts = text.split(" ")
        edges = {p[:1] for p in parts} | {p[-1:] for p in parts}
        if "" not in edges and VISIBLE.fullmatch("".join(edges)):
            return parts
        return [p[1:] for p in CUT.split(" " + text)]

    def learn(self, new: list[str]) -> None:
        a_bytes, b_bytes, a_name, b_name = self.a.bytes, self.b.bytes, self.a_name, self.b_name
        spaced = [" " + u for u in new]
        for unit, raw, a, b in zip(new, spaced, self.a.encode(spaced), self.b.encode(spaced), strict=True):
            raw = raw.encode()
            whole = b"".join([a_bytes[x] for x in a]) == raw and b"".join([b_bytes[x] for x in b]) == raw
            links, groups = merge(a, b, self.a_size, self.b_size) if whole else ([], [])
            said, p, q = [], 0, 0
            for i, j in groups:
                if i - p == 1 == j - q:
                    said.append(f"{a_name[a[p]]}|{b_name[b[q]]}")
                else:
                    said.append(",".join([a_name[x] for x in a[p:i]]) + "|" + ",".join([b_name[x] for x in b[q:j]]))
                p, q = i, j
            self.number[unit] = len(self.text)
            self.text.append(";".join(said))
            self.counts.extend((len(a), len(b), len(groups), len(links), whole))
            self.links.extend(links)
            self.first.append(len(self.links))

    def rows(self, texts: list[str | None]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct id pairs and how often each is linked."""
        if len(self.text) > KEPT_UNITS or len(self.links) > KEPT_LINKS:
            self.clear()
        cut = [self.units(t) if t else [] for t in texts]
        number = self.number
        new = dict.fromkeys(u for units in cut for u in units if u not in number)
        if new:
            self.learn(list(new))
        counts, first = np.frombuffer(self.counts, np.int64).reshape(-1, 5), np.frombuffer(self.first, np.int64)
        links, said, out = np.frombuffer(self.links, np.int64), self.text, []
        for units in cut:
            at = [number[u] for u in units]
            held = counts[at]
            if not at or not held[:, 4].all():
                out.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)))
                continue
            n = held[:, 3]
            place = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pairs, times = np.unique(links[place], return_counts=True)
            digest = hashlib.sha256(";".join([said[x] for x in at]).encode()).hexdigest()
            out.append((*held[:, :4].sum(0).tolist(), digest, pairs, times.astype(np.int32)))
        return out


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 32 | b) and times."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (a_path, b_path) not in _workers:
            _workers[a_path, b_path] = Aligner(load(a_path), load(b_path))
        aligner = _workers[a_path, b_path]
        for batch in batches:
            at = 0
            for texts in chunks([t if isinstance(t, str) else None for t in batch["text"]]):
                out = pd.DataFrame(aligner.rows(texts), columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                out.insert(0, "doc_id", batch["doc_id"].iloc[at : at + len(texts)].to_numpy())
                at += len(texts)
                yield out

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if kind in ("tinyint", "smallint", "int", "bigint"):  # pandas has no null integers of its own
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = rows.mapInPandas(run, f"doc_id {'string' if kind in ('tinyint', 'smallint', 'int', 'bigint') else kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best_a, best_b): links of an id pair over the corpus; whether no pair of its a, or b, has more."""
    each = rows.select(F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    counts = stage(each.groupBy("pair").agg(F.sum(F.col("times").cast("long")).alias("count")))
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND((1 << 32) - 1)
    sides = counts.withColumns({"a": a, "b": b})
    for side in ("a", "b"):
        most = counts.select(({"a": a, "b": b})[side].alias(side), "count").groupBy(side).agg(F.max("count").alias(f"most_{side}"))
        sides = sides.join(most, side)
    return sides.select("pair", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def frequent_bound(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` pairs are counted as often; 0 if all pairs are no more than that."""
    rows = counts.groupBy(F.length(F.bin("count")).alias("digits")).count().collect()  # 64 rows at most
    total, bound = 0, (1 << 63) - 1
    for r in sorted(rows, key=lambda r: -r["digits"]):
        total += r["count"]
        if total > most:
            return bound
        bound = 1 << (r["digits"] - 1)
    return 0


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256.

    Tokens of the file at a_path and of the one at b_path (.json of the tokenizers library with byte-level tokens, or
    .model of sentencepiece), of a space and the text. Groups are cut where both sides' tokens end. A link is a pair of
    tokens that share bytes; a pair's count is how many links of the corpus are of its ids. n_best: links whose count
    is the highest of their id of b, ties included (n_best_a: of a); count_sum: the counts of all links.

    Texts that are null or empty, or whose tokens' bytes are not those of the text, have zeros and the digest ''. Very
    long texts are read whole, cut into units. Rows that repeat count each; an empty table gives an empty result; other
    columns, whatever their names, are ignored. Pairs counted often go to the documents by broadcast, at most
    `broadcast_rows` of them; all others are joined by shuffle, so that no pair of many documents is a task's share.
    """
    rows = stage(linked(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = stage(pair_counts(rows))
    bound = frequent_bound(counts, broadcast_rows)
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    often = F.broadcast(counts.where(F.col("count") >= bound))
    sums = [
        F.sum(F.col("count") * F.col("times")).alias("count_sum"),
        F.sum(F.when(F.col("best_b"), F.col("times").cast("long")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("best_a"), F.col("times").cast("long")).otherwise(0)).alias("n_best_a"),
    ]
    found = each.join(often, "pair").groupBy("row").agg(*sums)
    if bound:
        rare = each.join(often.select("pair"), "pair", "left_anti").join(counts.where(F.col("count") < bound), "pair")
        found = found.union(rare.groupBy("row").agg(*sums)).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("count_sum", "n_best", "n_best_a")])
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("n_best_a", zero).alias("n_best_a"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
