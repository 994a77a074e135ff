"""The corpus pipeline against brute force, and the operators on empty tables, very long texts and clashing columns."""

import random

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelspark.llm import decontam, exact, mixing, neardup, quality, sharding, substring, tokens
from tests.llm.test_operators import docs, edited, shingles, words

CLASH = ("row", "passes", "spans", "h", "part", "rank", "slot_", "__id", "__mark", "__ref", "__source", "__size", "ref", "bucket", "component_id", "taken", "score_", "home")


def clashing(df):
    return df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])


def write(spark, path, d, labels, bench):
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def leaders(texts, percent):
    """Of each group of near copies the first; texts without words are alone."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(15)
    base = [words(rng, rng.choice([6, 40, 120, 300]), 10**5) for _ in range(40)]
    item = words(rng, 14, 10**5)
    texts = base + [edited(rng, t, 0.01) for t in base[:15]] + base[:5] + [words(rng, 30, 10**5) + " " + item.upper() + " " + words(rng, 9, 10**5) for _ in range(4)] + [None, "", " \n", "one two"]
    sources = [f"s{i % 3}" if i % 7 else None for i in range(len(texts))]
    d = clashing(docs(spark, texts, sources))
    write(spark, tmp_path, d, [(i, 1, 0) for i in range(len(texts))], [(1, item), (2, None)])
    kept = [i for i in leaders(texts, 80) if item not in (texts[i] or "").lower()]
    stages, now = {}, d
    for name, step in corpus_pipeline.STAGES:
        now = step(spark, now, str(tmp_path))
        if name != "sharding":
            assert now.columns == d.columns
        now.write.parquet(str(tmp_path / name.replace(" ", "_")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        stages[name] = now.collect()
    assert sorted(r.doc_id for r in stages["quality classifier"]) == list(range(len(texts)))
    assert sorted(r.doc_id for r in stages["near dedup"]) == leaders(texts, 80)
    assert sorted(r.doc_id for r in stages["decontamination"]) == kept
    size = {i: len((texts[i] or "").split()) for i in kept}
    whole, got = Counter(), Counter()
    of_doc = Counter()
    for i in kept:
        whole[sources[i]] += size[i]
    for r in stages["mixing"]:
        own = texts[r.doc_id].split()
        assert all(w in own for w in r.text.split()) and r.n_chars == len(r.text) and r["__id"] == "x__id"
        of_doc[r.doc_id] += len(r.text.split())
        got[sources[r.doc_id]] += len(r.text.split())
    assert all(of_doc[i] <= 3 * size[i] for i in kept)
    target = {r.source: r.target for r in mixing.mix(docs(spark, [texts[i] for i in kept], [sources[i] for i in kept], kept)).collect()}
    assert abs(sum(target.values()) - sum(whole.values())) < 1e-6 and all(abs(got[s] - t) <= 0.02 * t + 4 for s, t in target.items())
    shards = defaultdict(list)
    for r in stages["sharding"]:
        shards[r.shard].append(r.slot)
    assert max(map(len, shards.values())) - min(len(shards.get(s, [])) for s in range(40)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and len(stages["sharding"]) == len(stages["mixing"])


def test_pipeline_of_nothing_and_of_ties(spark, tmp_path):
    write(spark, tmp_path / "a", docs(spark, []), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    d = docs(spark, ["same text here"] * 6 + [None] * 3, ids=[1, 1, 1, 2, None, None, None, 3, 3])
    write(spark, tmp_path / "b", d, [(1, 1, 0), (2, 1, 0)], [])
    out = corpus_pipeline.run(spark, str(tmp_path / "b")).collect()
    assert {r.doc_id for r in out} == {1} and sum(len(r.text.split()) for r in out) == 3


def test_the_classifier_rejects_in_the_pipeline(spark, tmp_path):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["stone", "river", "and", "the", "walks"]) for _ in range(rng.randrange(30, 90))) for _ in range(120)]
    bad = [" ".join(rng.choice(["###", "$$x", "%%%", "0x0"]) for _ in range(60)) for _ in range(120)]
    write(spark, tmp_path, docs(spark, good + bad), [(i, int(i < 120), 0) for i in range(240)], [])
    got = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len(got & set(range(120))) > 115 and len(got - set(range(120))) < 5


LONG = 450_000  # words: over the 2 MiB that are handled at once


@pytest.fixture(scope="module")
def long_docs(spark):
    text = " ".join(f"v{(i * i) % 7919}" for i in range(LONG))
    return clashing(docs(spark, [text, text.replace(" v1 ", "  v1\n"), "short text", None], ["a", "b", "a", None])), text


def test_very_long_texts(spark, long_docs):
    d, text = long_docs
    n = len(text.split())
    assert {r.doc_id: r.size for r in mixing.mix(d).collect()} == {0: n, 1: n, 2: 2, 3: 0}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d).collect()}
    assert near[0] == near[1] == (len(shingles(text)), 0) and near[2] == (1, 2)
    same = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_duplicates(d).collect()}
    assert same == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1)}
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(d).collect()}
    assert gone[0] == gone[1] == (n, n) and gone[2] == (2, 0)
    bench = spark.createDataFrame([(1, " ".join(text.split()[300_000:300_012]))], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit > 0) for r in decontam.contamination(d, bench).collect()}
    assert hits == {0: (n, True), 1: (n, True), 2: (2, False), 3: (0, False)}
    out = sharding.shard_rows(d, 3)
    assert set(CLASH) <= set(out.columns) and out.count() == 4 and out.where("row = 'xrow'").count() == 4


def test_token_counts_of_clashing_columns(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    d = clashing(docs(spark, ["word " * 30_000, "a", None, "a"], ids=[1, 2, None, 2])).withColumn("n_tokens", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 2048) for r in tokens.token_counts(d, path).collect())
    assert got == [(0, 0, False), (1, 150_000, True), (2, 1, False), (2, 1, False)]


def test_decontaminate_keeps_clashing_columns(spark):
    d = clashing(docs(spark, ["a b c d e f g h i j k", "x y", None, "x y"], ids=[1, 2, None, 2]))
    bench = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    for remove, want in (("documents", [None, "x y", "x y"]), ("spans", [None, "a", "x y", "x y"])):
        out = decontam.decontaminate(d, bench, remove)
        rows = out.collect()
        assert out.columns == d.columns and sorted((r.text for r in rows), key=lambda t: (t is not None, t or "")) == want and all(r["__mark"] == "x__mark" for r in rows)


def test_both_ways_of_decontamination_agree(spark, monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, 60, 30) for _ in range(60)] + ["one", "w1 w2", None]
    items = [(i, words(rng, n, 30)) for i, n in enumerate([1, 2, 3, 7, 10, 25])] + [(9, texts[0][:60]), (10, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in decontam.contamination(docs(spark, texts), bench).collect())
    first = rows()
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 3)
    assert rows() == first and any(n for _, n, _ in first)


def test_quality_of_nothing(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs(spark, []), labels).count() == 0


def test_long_lists_are_linked_by_leaders(spark):
    """2,000 near copies are one component, found without comparing all of them; another family stays apart."""
    rng = random.Random(11)
    base = words(rng, 300, 10**6).split()

    def copy():
        own = list(base)
        for at in rng.sample(range(300), 2):
            own[at] = f"c{rng.randrange(10**9)}"
        return " ".join(own)

    half = " ".join(base[:150])
    texts = [copy() for _ in range(2000)] + [half + " " + words(rng, 150, 10**6) for _ in range(100)]
    d = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d).collect()}
    assert set(got[i] for i in range(2000)) == {0} and all(got[i] == i for i in range(2000, 2100))
    members = spark.range(2000).select(F.lit(1).alias("v"), F.col("id").alias("rep"), F.lit(300).cast("long").alias("n"))
    one = members.select("rep", F.lit(0).cast("long").alias("component"))
    assert neardup.open_blocks(members, one).count() == 0
    several = members.select("rep", F.when(F.col("rep") < 1990, 0).otherwise(F.col("rep")).cast("long").alias("component"))
    assert neardup.open_blocks(members, several).count() < 3 * 2000 + 200


