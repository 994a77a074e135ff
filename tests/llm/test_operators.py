"""The corpus operators on small tables, against brute force: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parcelspark.llm import bytehash as bh
from parcelspark.llm import chat, decontam, exact, lm, mixing, neardup, quality, sharding, substring, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    sources, ids = sources or ["s"] * len(texts), ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    base = [words(rng, rng.choice([3, 40, 80, 200, 700])) for _ in range(60)]
    near = [edited(rng, base[i % 60], 0.005 * (i % 5)) for i in range(60)]
    group = words(rng, 120)
    passage = words(rng, 60)
    texts = base + near + [edited(rng, group, 0.01) for _ in range(40)] + [words(rng, 50) + " " + passage + " " + words(rng, 30) for _ in range(20)]
    return texts + [group] * 30 + [None, "", " \t\n", "one", "one", "A b C", "a B c", "x" * 5000, "z " * 100, "Ünï ÇÖde Ünï"]


# 1 mixing


def test_mix(spark, corpus):
    sources = [("hot" if i % 3 == 0 else f"s{i % 5}") if i % 11 else None for i in range(len(corpus))]
    rows = mixing.mix(docs(spark, corpus, sources)).collect()
    size = {i: len((t or "").encode().split()) for i, t in enumerate(corpus)}
    assert all(r.size == size[r.doc_id] and r.taken <= 3 * r.size for r in rows) and len(rows) == len(corpus)
    got, target, total = Counter(), {}, Counter()
    for r in rows:
        got[r.source] += r.taken
        target[r.source], total[r.source] = r.target, total[r.source] + r.size
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        left = sum(total.values()) - sum(want.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]
        if not over:
            break
        want |= {s: 3 * total[s] for s in over}
        free -= set(over)
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] and abs(got[s] - want[s]) <= 0.01 * want[s] + 2
    again = mixing.mix(docs(spark, corpus, sources).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixed_documents_have_the_words_taken(spark, corpus):
    d = docs(spark, corpus, [f"s{i % 4}" for i in range(len(corpus))])
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    have = Counter()
    for r in out.collect():
        have[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(have)


def test_sainte_lague_gives_the_highest_quotients(spark):
    rng = random.Random(3)
    votes = [("g", i, float(rng.choice([1, 3, 3, 50, 700, 12])), 41) for i in range(15)] + [("h", 1, 5.0, 7), ("z", 1, 0.0, 0)]
    df = spark.createDataFrame(votes, "g string, i int, v double, n long")
    got = {(r.g, r.i): r.seats for r in mixing.sainte_lague(df, ["g"], "v", "n", ["i"], "seats").collect()}
    quotients = sorted(((v / (2 * k - 1), v, i) for g, i, v, _ in votes if g == "g" for k in range(1, 42)), reverse=True)
    cut = quotients[40][0]
    for g, i, v, n in votes[:15]:
        low = sum(v / (2 * k - 1) > cut for k in range(1, 42))
        assert low <= got[g, i] <= sum(v / (2 * k - 1) >= cut for k in range(1, 42))
    assert sum(s for (g, _), s in got.items() if g == "g") == 41 and got["h", 1] == 7 and got["z", 1] == 0


def test_a_source_without_words_keeps_its_place(spark):
    text = " ".join(["word"] * 3000)
    d = docs(spark, [text, None, " ", text, text], ["a", "b", "b", "c", None])
    got = {r.source: (r.size, r.target, r.taken) for r in mixing.mix(d).collect()}
    # Weights 1, 2, 3, 1 of a, b, c and null; b, of no size, is stopped at once: 9000 words by 1 : 3 : 1.
    assert got["b"] == (0, 0.0, 0)
    for s, target in (("a", 1800), ("c", 5400), (None, 1800)):
        assert abs(got[s][1] - target) < 1e-6 and abs(got[s][2] - target) <= 2 + 0.01 * target


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    rows = mixing.mix(docs(spark, [None, ""])).collect()
    assert [(r.size, r.taken, r.source_size) for r in rows] == [(0, 0, 0)] * 2


# 2 near duplicates


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def clusters(ids, sets):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize(("short", "block"), [(64, 1024), (3, 8)])
def test_near_duplicates(spark, corpus, monkeypatch, short, block):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    order = list(range(len(corpus)))
    random.Random(1).shuffle(order)
    texts = [corpus[i] for i in order]
    sets = [shingles(t) for t in texts]
    want = clusters(list(range(len(texts))), sets)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts).withColumn("component_id", F.lit("x"))).collect()}
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)


def test_near_duplicates_edge_cases(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    rows = neardup.near_duplicates(docs(spark, ["a b", "A b", None, None], ids=[5, None, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 5, False), (3, 3, True), (5, 5, True)]
    d = docs(spark, ["a b c d e f", "a b c d e f", "other"])
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(d).collect()) == [0, 2]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(21)
    a, b, c, d = (words(rng, 300, 10**6) for _ in range(4))
    a2, b2, c2 = (edited(rng, x, 0.005) + " end" for x in (a, b, c))
    assert all(85 * len(shingles(x) | shingles(y)) <= 100 * len(shingles(x) & shingles(y)) for x, y in ((a, a2), (b, b2), (c, c2)))
    # Id 1 has two texts, each with a near copy elsewhere; c and its near copy and d have no ids.
    rows = [(1, a), (1, b), (5, a2), (6, b2), (None, c), (None, c2), (None, c), (None, d), (7, d), (8, "x y"), (8, "x y"), (None, ""), (None, None)]
    df = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(df).where("n_shingles > 0").collect() if r.doc_id}
    assert {i: x for (i, _), x in got.items()} == {1: 1, 5: 1, 6: 1, 7: 7, 8: 8}
    kept = sorted((r.doc_id or 0, r.text or "") for r in neardup.drop_near_duplicates(df).collect())
    left = [x for x in kept if x[0] == 0 and x[1]]
    assert len(left) == 1 and left[0][1] in (c, c2)
    assert [x for x in kept if x not in left] == sorted([(1, a), (1, b), (7, d), (8, "x y"), (0, ""), (0, "")])


def test_the_pipeline_drops_near_copies_from_four_fifths_on(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    texts, want = [], set()
    for i in range(40):  # 104 words have 100 shingles; with m words added at the end a pair is at 100 / (100 + m)
        base = words(rng, 104, 10**6)
        want.add(len(texts))
        texts.append(base)
        m = (18, 20, 22, 25, 26)[i % 5]
        if m > 25:
            want.add(len(texts))
        texts.append(base + " " + words(rng, m, 10**6))
    sets = [shingles(t) for t in texts]
    assert {i for i in range(len(texts)) if not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))} == want
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    # Labels of one kind let all documents pass the first stage; the benchmark has none of their passages.
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    taken = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert taken == want


def test_shared_follows_percent_and_k():
    from math import comb

    for percent, k in ((85, 32), (80, 32), (60, 32), (50, 32), (50, 64)):
        n, p = neardup.least_shared(percent, k), percent / 100
        below = [sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(m)) for m in (n, n + 1)]
        assert below[0] <= 1e-8 < below[1]
    with pytest.raises(ValueError, match="larger k"):
        neardup.least_shared(20, 32)


# 3 language model


def test_lm_base_score_and_gain(spark, corpus):
    rng = random.Random(2)
    texts = corpus + [words(rng, 60, 150) for _ in range(200)]
    got = {r.doc_id: r for r in lm.lm_scores(docs(spark, texts)).collect()}
    import math

    toks = [(t or "").encode().lower().split() for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for i, ws in enumerate(toks) if not held[i] for w in ws)
    ends = sum(not h for h in held)
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, ws in enumerate(toks):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
        assert abs(r.base_score - base) <= 1e-9 * abs(base) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def brute_model(model):
    """p(context, word) from the seated pairs alone: counts over all buckets, no vectors, no hot pairs."""
    from collections import defaultdict

    c, pairs = {}, model.pairs.collect()
    sums = [{n: defaultdict(float) for n in ("t", "gt", "gc", "T", "K", "C", "root")} for _ in model.worlds]
    for row in pairs:
        s = lm.unpack(bytes(row.state))
        b = lm.Bucket(model.words, s["ctx"], s["w"], s["c"])
        for i, z in enumerate(sums):
            t, gt = s[f"t{lm.BURN_IN + i}"], s[f"gt{lm.BURN_IN + i}"]
            for x, w, n, e, own, tables in zip(b.ctx.tolist(), b.w.tolist(), b.c.tolist(), b.ending.tolist(), b.own.tolist(), t.tolist(), strict=True):
                c[x, w] = n
                assert 1 <= tables <= n
                z["gc"][e, w] += tables if own else n
                z["C"][e] += tables if own else n
                if own:
                    z["t"][x, w] = tables
                    z["T"][x] += tables
            for x, w, tables in zip(b.gctx.tolist(), b.gw.tolist(), gt.tolist(), strict=True):
                e = x - model.words.contexts
                assert 1 <= tables <= z["gc"][e, w]
                z["gt"][e, w] = tables
                z["K"][e] += tables
                z["root"][w] += tables
    total = Counter()
    for (x, _), n in c.items():
        total[x] += n

    def p(ctx, w):
        e = int(model.words.ending_of(__import__("numpy").array([ctx]))[0])
        out = []
        for z, world in zip(sums, model.worlds, strict=True):
            d0, d1, d2 = world.d
            all_root, kinds = sum(z["root"].values()), len(z["root"])
            q = (z["root"][w] - d0 if z["root"].get(w) else 1 + d0 * kinds) / (1 + all_root)
            q = (z["gc"].get((e, w), 0) - d1 * z["gt"].get((e, w), 0) + (1 + d1 * z["K"].get(e, 0)) * q) / (1 + z["C"].get(e, 0))
            if ctx < model.words.contexts:
                q = (c.get((ctx, w), 0) - d2 * z["t"].get((ctx, w), 0) + (1 + d2 * z["T"].get(ctx, 0)) * q) / (1 + total[ctx])
            out.append(q)
        return sum(out) / len(out)

    return p, {w for _, w in c}, {x for x, _ in c}


@pytest.mark.parametrize(("contexts", "bucket", "top"), [(1 << 17, 1 << 20, 1 << 18), (60, 2000, 25)])
def test_lm_scores_are_the_models(spark, corpus, monkeypatch, contexts, bucket, top):
    import math

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(lm, "TOP_PAIRS", top)
    monkeypatch.setattr(lm, "HOME_DOCS", 50)
    texts = corpus + ["w1 w2 " * 12_000, "w1 never w2 seen"]
    clash = docs(spark, texts).withColumn("score", F.lit("x")).withColumn("ref", F.lit(1)).withColumn("home", F.lit(2))
    got = {r.doc_id: r for r in lm.lm_scores(clash, contexts=contexts).collect()}
    model = lm.train(docs(spark, texts).where(lm.learnt(F.col("doc_id"))), contexts=contexts)
    assert len(model.worlds) == lm.SAMPLES and (model.pairs.count() > 1) == (bucket == 2000)
    p, known, ctxs = brute_model(model)
    for x in sorted(ctxs)[:: max(1, len(ctxs) // 12)]:  # known words and the kind that was never learnt have all of it
        assert abs(sum(p(x, w) for w in known) + p(x, -1) - 1) < 1e-9
    for i, t in enumerate(texts):
        w = bh.Words(*bh.texts(pa.array([t], pa.string())), lower=True)
        ids = model.words.ids(w.hashes()).tolist()
        ctx = [0, *[int(k) if k < lm.RARE else int(e) + model.words.contexts for k, e in zip(ids, w.endings(), strict=True)]]
        want = Counter(zip(ctx, [*ids, 0], strict=True))
        assert abs(sum(n * math.log10(p(x, k)) for (x, k), n in want.items()) - got[i].score) < 1e-6 * abs(got[i].score)
    assert np.isfinite([r.score for r in got.values()]).all()


@pytest.mark.parametrize(("c", "new", "d"), [(1, 0.5, 0.4), (7, 0.8, 0.4), (100, 3.0, 0.7), (lm.EXACT, 0.3, 0.9), (1500, 0.1, 0.7), (1500, 200.0, 0.8), (3000, 40.0, 0.3), (10_000, 2.0, 0.5)])
def test_a_sweep_keeps_the_law_of_tables(c, new, d):
    """Tables of c customers at one dish have the weights S(c, t) new^t, S: generalised Stirling numbers, from the first
    sweep on, as all customers are seated anew."""
    import numpy as np

    row = np.zeros(1)
    with np.errstate(divide="ignore"):
        for n in range(2, c + 1):
            row = np.logaddexp(np.append(-np.inf, row), np.append(row + np.log(n - 1 - d * np.arange(1, len(row) + 1)), -np.inf))[:1200]
    law = row + np.arange(1, len(row) + 1) * np.log(new)
    law = np.exp(law - law.max())
    law /= law.sum()
    n = 20_000
    t = lm.seated(np.full(n, c), np.full(n, new), d, np.random.default_rng(4))
    assert t.min() >= 1 and t.max() <= c
    seen = np.bincount(t, minlength=len(law) + 1)[1 : len(law) + 1] / n
    noise = np.sqrt(2 / np.pi * law * (1 - law) / n).sum()
    assert abs(seen - law).sum() < 1.5 * noise + 0.02
    assert abs((seen * np.arange(1, len(law) + 1)).sum() / (law * np.arange(1, len(law) + 1)).sum() - 1) < 0.01


def test_seating_depends_on_nothing_but_its_draw():
    import numpy as np

    c, new = np.array([0, 1, 2, 5000, 3, 2, 900]), np.array([1.0, 1.0, 1e9, 1e-9, 1e-12, 1e9, 1e9])
    t = lm.seated(c, new, 0.5, np.random.default_rng(1))
    assert t.tolist()[:6] == [0, 1, 2, 1, 1, 2] and t[6] > 890


def test_contexts_are_cut_exactly(spark):
    texts = [" ".join(f"w{i}" for i in range(300)), "often often"]
    for most in (0, 1, 120, 400):
        words = lm.frequent(lm.vocabulary(docs(spark, texts)), 2, most)
        assert words.contexts == 1 + min(most, 301) and (most == 0 or words.count[1] == 2)


def test_lm_knows_word_order(spark):
    rng = random.Random(6)
    sentence = [" ".join(f"w{(a + i) % 50}" for i in range(60)) for a in range(300)]
    shuffled = [" ".join(rng.sample(t.split(), 60)) for t in sentence]
    texts = [x for pair in zip(sentence, shuffled, strict=True) for x in pair]
    rows = [r for r in lm.lm_scores(docs(spark, texts[::2] + texts[1::2][:30])).collect() if r.held_out]
    ordered = [r.score / r.n_tokens for r in rows if r.doc_id < 300]
    other = [r.score / r.n_tokens for r in rows if r.doc_id >= 300]
    assert min(ordered) > max(other) + 0.5


def test_lm_edges(spark):
    rows = lm.lm_scores(docs(spark, [None, "", "a", "a"], ids=[None, 1, 1, 1])).collect()
    assert len(rows) == 4 and all(r.score < 0 for r in rows) and sum(r.doc_id is None for r in rows) == 1
    none = lm.lm_scores(docs(spark, ["a b"], ids=[next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)])).first()
    assert (none.held_out, none.n_tokens, none.n_known, none.train_tokens) == (True, 3, 0, 0)
    assert lm.lm_scores(docs(spark, [])).count() == 0


# 4 chat


def test_render_round_trips():
    rng = random.Random(5)
    parts = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "|", "<\\|", "<|x|>", "user", "%0A", "é", " "]
    for _ in range(500):
        turns = [("".join(rng.choices(parts, k=rng.randrange(3))), "".join(rng.choices(parts, k=rng.randrange(8)))) for _ in range(rng.randrange(1, 4))]
        rendered = chat.render(turns)
        assert [x[:2] for x in chat.parse(rendered)] == turns
        assert rendered.count("<|im_end|>") == len(turns) == rendered.count("<|im_start|>")
    assert chat.render([("user", "plain <| text")]) == "<|im_start|>user\nplain <| text<|im_end|>\n"
    assert chat.parse("no turns") is None


def test_format_conversations(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (1, 1, None, "c"), (None, 0, "assistant", "d"), (2, None, "user", "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\n\nc\nassistant\nb<|im_end|>\n") and got[1].n_turns == 3
    assert got[1].loss_chars == 11 and got[1].loss_sha256 == sha("b<|im_end|>")
    assert got[None].loss_sha256 == sha("d") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# 5 token counts


@pytest.mark.parametrize(("name", "cut"), [("word_bpe_49k.json", "space"), ("byte_bpe_50k.json", "ahead")])
def test_token_counts_are_the_librarys_for_each_file(spark, name, cut):
    path = pytest.importorskip("public_tokenizers").path(name)
    tokenizer = tokens.load(path)
    assert tokens.cut_of(tokenizer) == cut
    texts = [None, "", " ", "a  b\n\tc ", "it's  'll 12 345!  ", "x\u00a0y \u00a0 z", "é é  ç\r\n", "<|endoftext|> a <|endoftext|>", "a" * 300 + " b", "日本 語 x", "tab\there \x1c odd", "don 't", "a " * 50_000]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, texts), path).collect()}
    assert [got[i] for i in range(len(texts))] == tokens.lengths(tokenizer, [t or "" for t in texts])


def test_unknown_tokenizers_are_never_cut():
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.BPE())
    assert tokens.cut_of(own) == "no"
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    assert tokens.cut_of(own) == "no"


def test_token_counts(spark, corpus):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    odd = ["a<|endoftext|>b", "<|ENDOFTEXT|>", "it's 123 né́e  x\x1cy", "́ a", "İstanbul ﬁ ½", "don't"]
    texts = corpus + odd
    got = {r.doc_id: r for r in tokens.token_counts(docs(spark, texts), path, limit=50).collect()}
    lib = tokens.load(path)
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)
    assert tokens.token_counts(docs(spark, []), path).count() == 0


# 6 repeats


@pytest.mark.parametrize("window", [35, 24])
def test_remove_repeats(spark, corpus, window):
    rng = random.Random(8)
    run = "r " * 90
    texts = corpus + [run, words(rng, 50) + " " + run, "q q " * 40, words(rng, 20, 2) * 6, words(rng, 300, 3), words(rng, 300, 3)]
    ws = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, texts), window=window, with_text=True).collect()}
    for d, w in enumerate(ws):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[d].kept_text == kept.decode()


def test_remove_repeats_of_repeated_rows(spark):
    text = words(random.Random(1), 50)
    rows = substring.remove_repeats(docs(spark, [text, text, None], ids=[1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 50), (1, 50)]
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_words_hashes():
    import pyarrow as pa

    col = pa.array(["Ab cd", None, "", "  cd\tAB ", "x"])
    buf, off = bh.texts(col.slice(1))
    w = bh.Words(buf, off, lower=True)
    h = w.hashes()
    assert w.first.tolist() == [0, 0, 0, 2, 3]
    v = bh.Words(*bh.texts(col), lower=True).hashes()
    assert v[1] == h[0] and v[0] == h[1] and len({*v.tolist()}) == 3


# 7 sharding


def test_shards_are_exact_and_uniform(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("slot"))
    out = sharding.shard_rows(d, 7)
    rows = out.collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [857] * 6 + [858] and len({r.doc_id for r in rows}) == 6000
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(857 + (s < 6000 % 7)))
    # A block of neighbouring ids is spread as by chance: chi-squared of 7 x 6 cells stays near 30.
    cells = Counter((r.doc_id // 1000, r.shard) for r in rows)
    chi = sum((cells[b, s] - 1000 / 7) ** 2 / (1000 / 7) for b in range(6) for s in range(7))
    assert chi < 66
    again = sharding.shard_rows(d.repartition(5), 7).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in again)


@pytest.mark.parametrize("most", [1024, 16])
def test_copies_of_rows_lie_anywhere(spark, monkeypatch, most):
    monkeypatch.setattr(sharding, "ROWS_PER_PARTITION", most)
    one = spark.range(4000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("copy").alias("text"), F.col("id").alias("extra"))
    thrice = spark.range(2400).select((F.col("id") % 800).alias("doc_id"), F.lit("t").alias("text"), F.col("id").alias("extra"))
    rows = sharding.shard_rows(one.union(thrice), 40).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [160] * 40 and len({r.extra + 10_000 * (r.doc_id < 0) for r in rows}) == 6400
    assert len({(r.shard, r.slot) for r in rows}) == 6400
    copies = Counter(r.shard for r in rows if r.doc_id < 0)
    chi = sum((copies[s] - 100) ** 2 / (100 * (1 - 4000 / 6400)) for s in range(40))  # of 160 places each, 39 degrees of freedom
    assert 10 < chi < 90
    at = {(r.shard, r.slot): r.doc_id for r in rows}
    together = sum(at.get((s, i + 1), -2) == d for (s, i), d in at.items() if d >= 0)
    assert together <= 12  # neighbours in a shard that are copies: 2400 * 2 / 6400 by chance
    shards = {}
    for r in rows:
        if r.doc_id >= 0:
            shards.setdefault(r.doc_id, []).append(r.shard)
    assert sum(len(set(x)) == 1 for x in shards.values()) <= 6 and sum(len(set(x)) == 3 for x in shards.values()) > 680


def test_hypergeometric_draws(spark):
    n, good, drawn = 40, 12, 15
    got = Counter(r[0] for r in spark.range(20000).select(sharding.hypergeometric(F.lit(n), F.lit(good), F.lit(drawn), (F.col("id") + 0.5) / 20000)).collect())
    from math import comb

    for k in range(13):
        p = comb(good, k) * comb(n - good, drawn - k) / comb(n, drawn)
        assert abs(got[k] / 20000 - p) < 1e-3
    edges = spark.range(1).select(*[sharding.hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.999999)) for a, b, c in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 3, 5), (9, 4, 0))]).first()
    assert tuple(edges) == (0, 3, 0, 3, 0)


def test_sharding_edges(spark):
    assert sharding.shard_rows(docs(spark, []), 4).count() == 0
    rows = sharding.shard_rows(docs(spark, ["a", "a", None], ids=[1, 1, None]), 2).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [1, 2]


# 8 benchmark


def test_contamination(spark, corpus):
    import re

    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(10, " ".join(corpus[0].split()[:14])), (2, "w1 w2 w3 nowhere"), (3, "one"), (4, None), (5, "--"), (None, corpus[3]), (7, corpus[170][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    d = docs(spark, corpus)
    got = {r.doc_id: r for r in decontam.contamination(d, bench).collect()}
    hit_ids = set()
    for d_id, t in enumerate(corpus):
        w = low(t)
        hit, ids = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    ids |= windows[tuple(w[k : k + n])]
        r = got[d_id]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), sum(hit), sorted(str(i) for i in ids if i is not None))
        if any(hit):
            hit_ids.add(d_id)
    assert hit_ids
    kept = decontam.decontaminate(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(len(corpus))) - hit_ids
    spans = {r.doc_id: r.text for r in decontam.decontaminate(d, bench, remove="spans").collect()}
    assert all(spans[i] == t for i, t in enumerate(corpus) if i not in hit_ids) and spans[0] != corpus[0]


def test_contamination_segments_and_edges(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT", 16)
    text = words(random.Random(6), 100)
    w = text.split()
    bench = spark.createDataFrame([(1, " ".join(w[k : k + 10])) for k in (0, 9, 40, 90)], "item_id long, text string")
    rows = decontam.contamination(docs(spark, [text, text, None], ids=[1, 1, None]), bench).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in rows) == [(0, 0), (1, 39), (1, 39)]
    assert decontam.contamination(docs(spark, [text]), bench.limit(0)).first().n_hit == 0
    assert decontam.contamination(docs(spark, []), bench).count() == 0


# 9 quality


def test_quality(spark):
    rng = random.Random(12)
    good = [" ".join(rng.choice(["stone", "river", "and", "the", "walks"]) for _ in range(rng.randrange(20, 300))) for _ in range(150)]
    bad = [t[: len(t) // 2] + " ".join(rng.choice(["###", "$$x", "%%%"]) for _ in range(40)) for t in good[:80]]
    texts = good + bad + [None, "", "x" * 70_000]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(230)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs(spark, texts).withColumn("score", F.lit("clash")), labels)
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i in range(230) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(len(texts)))
    assert sum((got[i].predicted == 1) == (i < 150) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(texts)
    again = {r.doc_id: r.score for r in quality.quality_scores(docs(spark, texts).repartition(3), labels).collect()}
    assert all(again[i] == got[i].score for i in got)
    flat = quality.quality_scores(docs(spark, ["a"]), labels.limit(0)).first()
    assert flat.score == 0.5


def test_a_long_text_does_not_end_the_sample(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    order = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i")).collect()]
    long, twice = order[0], order[1]
    rows = [(i, f"text {i}") for i in ids if i != long] + [(twice, f"text {twice} longer")] * 3 + [(long, "x" * (13 << 20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    texts, ys = quality.training_sample(d, labels, "quality", (4, 2), 2000)
    assert [t.decode() for t in texts] == [f"text {i}" for i in order[1:]] and ys.tolist() == [i % 2 for i in order[1:]]
    with pytest.raises(ValueError, match="label 1"):
        only = labels.withColumn("quality", (F.col("doc_id") == long).cast("int"))
        quality.training_sample(d, only, "quality", (4, 2), 2000)


def test_chunks_cover_the_whole_document():
    import numpy as np

    net = quality.exact(quality.Net(1))
    rng = np.random.default_rng(0)
    parts = [rng.integers(1, 255, n).astype(np.uint8) for n in (0, 1, 5, quality.CHUNK, quality.CHUNK + 1, 1000)]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = quality.scores(net, np.concatenate(parts), off)
    for p, s in zip(parts, got, strict=True):
        assert quality.scores(net, p, np.array([0, len(p)]))[0] == s
        n = max(1, -(-len(p) // quality.CHUNK)) * quality.CHUNK
        padded = np.concatenate([p, np.zeros(n + quality.WIDTH - 1 - len(p), np.uint8)])
        x = net.p["e"][padded]
        conv = np.stack([np.concatenate(x[i : i + quality.WIDTH]) for i in range(n)]) @ net.p["w"] + net.p["b"]
        tops = np.maximum(conv, 0).reshape(-1, quality.CHUNK, quality.FILTERS).max(axis=1)
        z = np.concatenate([tops.max(axis=0), tops.mean(axis=0)]) @ net.p["v"] + net.p["c"]
        assert abs(1 / (1 + np.exp(-z[0])) - s) < 1e-5


# 10 exact duplicates


def test_exact_duplicates(spark, corpus):
    texts = corpus + ["a  b", "a\tb ", "a b", " a b", corpus[5].replace(" ", "\n")]
    norm = [" ".join(["" if not p else p for p in __import__("re").split(r"[\x20\x09-\x0D]+", t or "")]) for t in texts]
    first, size = {}, Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    got = {r.doc_id: r for r in exact.exact_duplicates(docs(spark, texts).withColumn("keep_id", F.lit("x"))).collect()}
    for i, t in enumerate(norm):
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("most", [10_000, 0])
def test_exact_duplicates_with_colliding_identifiers(spark, monkeypatch, most):
    """Should identifiers collide, texts are still told apart by their characters."""
    monkeypatch.setattr(exact.F, "xxhash64", lambda *cols: F.lit(1).cast("long") if cols and not isinstance(cols[-1], type(F.lit(7))) or len(cols) == 1 else F.crc32(F.col("doc_id").cast("string")))
    monkeypatch.setattr(exact, "MOST_COLLIDING", most)
    got = {r.doc_id: r.keep_id for r in exact.exact_duplicates(docs(spark, ["a b", "c d", "a  b", "e"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def test_chunks_of_scripts_without_spaces(spark):
    rng = random.Random(3)
    chinese = "".join(chr(rng.choice([0x7684, 0x4E00, 0x662F, *range(0x4E00, 0x4F00)])) for _ in range(20_000))
    korean = " ".join("".join(chr(rng.randrange(0xAC00, 0xAD00)) for _ in range(3)) for _ in range(5_000))
    rows = [(t, t[:100] + "x" + t[100:]) for t in (chinese, korean)]
    for r in spark.createDataFrame(rows, "a string, b string").select(exact.chunks(F.col("a")).alias("a"), exact.chunks(F.col("b")).alias("b")).collect():
        assert "".join(r.a) in (chinese, korean) and len(set(r.a) - set(r.b)) <= 2 and len(r.a) > 20


def test_exact_duplicates_edges(spark):
    assert exact.exact_duplicates(docs(spark, [])).count() == 0
    rows = exact.exact_duplicates(docs(spark, ["a", "a", None, ""], ids=[None, 4, None, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 4, 2, False), (4, 4, 2, True)]
