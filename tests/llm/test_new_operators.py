"""Tokenizer alignment, Merkle manifests and suffix-array deduplication against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelspark.llm import alignment, bytespans, merkle
from parcelspark.llm.suffixarray import suffix_array
from tests.llm.test_operators import corpus, docs, words  # noqa: F401


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11 alignment


@pytest.fixture(scope="module")
def sides():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def aligned(texts, paths):
    """The links and groups of whole texts, by byte ranges, without units."""
    a_side, b_side = alignment.ByteLevel(paths[0]), alignment.Pieces(paths[1])
    out = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        a, b = (a_side.slow([" " + t])[0], b_side.encode([" " + t])[0]) if t else ([], [])
        if not t or b"".join(a_side.bytes[x] for x in a) != raw or b"".join(b_side.bytes[x] for x in b) != raw:
            out.append(([], [], [], ""))
            continue
        ends = []
        for ids, side in ((a, a_side), (b, b_side)):
            at, places = 0, []
            for x in ids:
                places.append((at, at := at + len(side.bytes[x])))
            ends.append(places)
        links = [(a[i], b[j]) for i, (p, q) in enumerate(ends[0]) for j, (r, s) in enumerate(ends[1]) if p < s and r < q]
        both = sorted({q for _, q in ends[0]} & {s for _, s in ends[1]})
        said, low = [], 0
        for high in both:
            said.append("|".join(",".join(str(x) for x, (p, _) in zip(ids, e, strict=True) if low <= p < high) for ids, e in zip((a, b), ends, strict=True)))
            low = high
        out.append((a, b, links, ";".join(said)))
    return out


def test_alignment(spark, sides, corpus):
    texts = [t[:600] if t else t for t in corpus[:30]] + [
        "", None, " ", "it's  two\n\nlines ", "naïve café Ünïcode été", "日本語 テキスト", "👩‍👩‍👧 x", "<s> <|endoftext|> <unk> ▁ a▁b", "x y   z", "tab\t \tend ", "a" * 400, "\x00nul", "same same", "same same",
    ]
    ids = [*range(len(texts) - 1), None]
    clash = docs(spark, texts, ids=ids).withColumn("row", F.lit("r")).withColumn("pairs", F.lit(1)).withColumn("n_a", F.lit("x"))
    want = aligned(texts, sides)
    counts = Counter(x for _, _, links, _ in want for x in links)
    best = {i: max(n for (a, b), n in counts.items() if (a, b)[i_] == i) for i_ in (1,) for i in {b for _, b in counts}}
    expected = sorted(
        ((ids[k] is None, ids[k] or 0), len(a), len(b), said.count(";") + bool(said), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(said) if said else "")
        for k, (a, b, links, said) in enumerate(want)
    )
    for limit in (1_000_000, 40, 0):  # all pairs by broadcast, the commonest only, none
        got = alignment.align(clash, *sides, broadcast_rows=limit).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == expected
    assert alignment.align(docs(spark, []), *sides).count() == 0


def test_units_of_a_worker_that_starts_anew(sides, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_UNITS", 3)
    aligner = alignment.Aligner(*map(alignment.load, sides))
    texts = ["one two three four", "two five", None, "one two three four"]
    rows = [aligner.rows([t])[0] for t in texts]
    assert rows[0][:5] == rows[3][:5] and rows[2][:5] == (0, 0, 0, 0, "") and (rows[0][5] == rows[3][5]).all()


def test_merge_of_tokens():
    size = [1, 2, 3, 4]
    assert alignment.merge([1, 1, 2], [2, 3], size, size) == ([1 << 32 | 2, 1 << 32 | 2, 1 << 32 | 3, 2 << 32 | 3], [(3, 2)])
    assert alignment.merge([], [], size, size) == ([], [])


# 12 Merkle manifests


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). The manifest by recursion over lists."""
    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        out = []
        for low in tree[:-1]:
            out.append((i % 2, low[i ^ 1] if i ^ 1 < len(low) else None))
            i //= 2
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in g]) for x, g in groups.items()}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            way = path(trees[x], i) + path(top, n)
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for right, s in way:
                node = sha(node) if s is None else sha(s, node) if right else sha(node, s)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha(*[s for _, s in way if s is not None]), node, node == top[-1][0]))
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["s", "", None, "é"]), rng.choice(["en", "en", "fr", None, "日", "z"]), rng.choice([None, 5, -1, 2**62]), rng.choice([None, "", "a:b", "é" * 40])) for i in range(150)]
    rows += [(7, "s", "en", 1, "again"), (7, "s", "en", 1, "again"), (None, "s", "en", 3, "x"), (None, "s", None, 3, "x"), (1000, "s", "alone", 3, "x"), (1001, "s", "two", 3, "x" * 300_000), (1002, "s", "two", 2**63 - 1, "y")]
    df = spark.createDataFrame(rows, FIELDS).withColumn("leaf", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("at", F.lit(2)).repartition(5)
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, levels=levels).collect()
    order = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(brute_manifest(rows), key=order)
    assert any(not r.verified for r in got)


@pytest.mark.parametrize("rows", [[], [(0, "s", "en", 1, "t")], [(0, "s", None, 1, "t"), (7, "s", None, 2, None)], [(i, "s", f"l{i}", 1, "t") for i in range(5)]])
def test_small_manifests(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, FIELDS), F.crc32(F.col("doc_id").cast("string")) % 7 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(brute_manifest(rows))


def test_a_block_without_all_children_is_an_error(spark):
    rdd = spark.sparkContext.parallelize([((0, 3, 0), (0, "a", None)), ((0, 3, 0), (2, "c", None))])
    with pytest.raises(Exception, match="heard from 2 of 3"):
        merkle.heard(rdd, 1, 0, 8).collect()


# 13 suffix arrays


def test_suffix_arrays():
    import numpy as np

    rng = random.Random(5)
    for n in range(3000):
        k, size = rng.choice([1, 2, 3, 9]), rng.randrange(30)
        s = [rng.randrange(k) for _ in range(size)]
        s = (s[: rng.randrange(1, 5)] * size)[:size] if n % 3 == 0 else s
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    long = np.random.default_rng(1).integers(0, 50, 20_000)
    long[10_000:] = long[:10_000]
    got, text = suffix_array(long), long.astype(np.uint8).tobytes()
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows, width):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            at = float("inf") if i is None else i
            first[w] = min(first.get(w, at), at)
    out = []
    for i, b in data:
        at, gone = float("inf") if i is None else i, [False] * len(b)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < at:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("width", "hot", "home", "symbols"), [(50, 2000, 1 << 20, 1 << 17), (50, 1, 3000, 200), (33, 2000, 3000, 64), (79, 3, 3000, 1 << 17)])
def test_later_repeats_go(spark, monkeypatch, width, hot, home, symbols):
    monkeypatch.setattr(bytespans, "SYMBOLS", symbols)
    monkeypatch.setattr(bytespans, "STARTS", 4096)
    rng = random.Random(width)
    shared = [words(rng, n, 40) for n in (12, 30, 200)] + ["x" * 90, "ab" * 60, "é日" * 30]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randrange(1, 40), 300) for _ in range(3)]
        texts.append(parts[0] + rng.choice(["", *shared]) + parts[1] + rng.choice(["", " ", *shared]) + parts[2])
    texts += [texts[0], texts[0] + "!", "?" + texts[1], texts[2][:49], texts[2][:50], None, "", "a" * 500, "a" * 49, words(rng, 20_000, 5000), shared[2] * 3, "日" * 100]
    ids = [*range(len(texts))]
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (5, texts[3]), (5, texts[3]), (None, texts[4]), (None, texts[4]), (-3, texts[6])]
    clash = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]).withColumn("row", F.lit(1)).withColumn("home", F.lit("h")).withColumn("kept", F.lit(0)).repartition(4)
    got = bytespans.remove_later_repeats(clash, window=width, with_text=True, home_bytes=home, bucket_bytes=home, hot_homes=hot).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=order) == sorted(brute_repeats(rows, width), key=order)


def test_repeats_of_nothing(spark):
    assert bytespans.remove_later_repeats(docs(spark, [])).count() == 0
    assert [tuple(r)[1:4] for r in bytespans.remove_later_repeats(docs(spark, [None, ""])).collect()] == [(0, 0, 0)] * 2
    with pytest.raises(TypeError):
        bytespans.remove_later_repeats(docs(spark, ["a"]).withColumn("doc_id", F.lit("a")))
    with pytest.raises(ValueError):
        bytespans.remove_later_repeats(docs(spark, ["a"]), window=10)
