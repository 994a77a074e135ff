"""Token counts by a map-side two-tier lookup: no word is ever shuffled.

Texts fall apart at white space where the tokenizer drops it, or in front of single spaces where its pre-tokenizer begins
a pre-token there, so a document's tokens are the sum over its words; texts of any other tokenizer go to the library
whole. The
first tier is a compact hash table, broadcast: the most frequent words of a bounded sample of documents with their
numbers of tokens. The second is a cache in each worker of the words that the
library has encoded there. Documents in which white space and the tokenizer might disagree go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a worker's cache before it is emptied.
CACHE_WORDS = 400_000
#: Characters of the longest word that is kept.
CACHE_CHARS = 64
SAMPLE_DOCS = 512
TABLE_WORDS = 20_000
#: A special string may lie in the text, or a control character that only Python takes for white space.
WHOLE = re.compile("<\\||[\x1c-\x1f]")

AHEAD = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")

_workers: dict[str, tuple] = {}


def load(path: str):
    """The library's tokenizer for a .json file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cut_of(tokenizer) -> str:
    """Where texts may be cut for a tokenizer: "space" if its normaliser makes white space one space and its
    pre-tokenizer drops it, "ahead" if it is byte-level by the usual pattern, which begins a pre-token with a space that
    stands between visible characters, else "no"."""
    said = json.loads(tokenizer.to_str())
    steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    normalisers, first = steps(said["normalizer"], "normalizers"), (steps(said["pre_tokenizer"], "pretokenizers") or [{}])[0]
    squeezed = any(n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normalisers)
    known = all(n["type"] in ("NFC", "Lowercase", "Replace") for n in normalisers) and sum(n["type"] == "Replace" for n in normalisers) == squeezed
    pattern = (first.get("pattern") or {}).get("Regex", "")
    if known and squeezed and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and " " not in pattern and "\\s" not in pattern.replace("[^\\s", ""):
        return "space"
    if not normalisers and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space"):
        return "ahead"
    return "no"


def words_of(text: str, cut: str) -> list[str]:
    return text.split() if cut == "space" else AHEAD.split(text) if cut == "ahead" else [text]


def lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def frequent_words(docs: DataFrame, tokenizer, cut: str) -> dict[str, int]:
    """The broadcast table: at most TABLE_WORDS words of SAMPLE_DOCS documents, with their numbers of tokens.

    The documents are of the least hashes of their ids; those over 64 KiB are left out. The table only saves time; its
    choice cannot change a count.
    """
    keyed = docs.select("text", F.xxhash64("doc_id").alias("h"))
    most = keyed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]  # without the texts
    counts: Counter[str] = Counter()
    for row in keyed.where((F.col("h") <= most) & (F.octet_length("text") <= 65_536)).limit(SAMPLE_DOCS).toLocalIterator():
        counts.update(w for w in words_of(row.text or "", cut) if len(w) <= CACHE_CHARS)
    words = [w for w, _ in counts.most_common(TABLE_WORDS)]
    return dict(zip(words, lengths(tokenizer, words), strict=True))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library for the file at `path` (which every executor has), without begin, end or added
    special tokens. Null texts are empty, very long ones are counted whole; other columns are ignored; rows that repeat are
    counted each; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokenizer = load(path)
    cut = cut_of(tokenizer)
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, tokenizer, cut) if cut != "no" else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = (load(path), {})
        tokenizer, cache = _workers[path]
        first = table.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_tokens = [0] * len(texts)
            for i, text in enumerate(texts):
                if cut == "no" or WHOLE.search(text):
                    n_tokens[i] = lengths(tokenizer, [text])[0]
                    continue
                total, missed = 0, []
                for word in words_of(text, cut):
                    n = first.get(word)
                    if n is None and (n := cache.get(word)) is None:
                        missed.append(word)
                    else:
                        total += n
                if missed:
                    counts = Counter(missed)
                    new = dict(zip(counts, lengths(tokenizer, list(counts)), strict=True))
                    total += sum(new[w] * n for w, n in counts.items())
                    if len(cache) + len(new) > CACHE_WORDS:
                        cache.clear()
                    cache.update((w, n) for w, n in new.items() if len(w) <= CACHE_CHARS)
                n_tokens[i] = total
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
