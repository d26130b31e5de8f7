"""The text operators against brute force, libraries and edge cases, on small fixtures."""

import hashlib
import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import bpe, chat, common, langid, lm, neardup_embed, ngram_join, packing, queries, tokencount, topk, toxicity
from tradeloom.llm.queries import vocabulary

WORD, PIECE = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["", None, " ", "Hello, it's <|endoftext|> wörld 123", "a\n b  c\t<s> é　ﬁ </s>", "\0a", "  x  ", "▁a▁▁b", "İΣ s's ERTZßSCH", "x" * 5000, "了解 日本語 text", "a b c " * 3000]
DOC = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(None, "no id", None), (3, "again", "de")]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit(1)).withColumn("ids", F.lit(2))


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    got = bpe.digests(bpe.decode(bpe.encode(odd, "doc_id", "text", WORD), "doc_id", WORD), "doc_id").collect()
    want = []
    for r in odd.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    assert bpe.encode(odd.limit(0), "doc_id", "text", WORD).count() == 0


def test_token_counts(spark, odd):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECE)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(odd, "doc_id", "text", PIECE).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect())


def test_packing(spark, odd):
    rows = packing.pack(odd, "doc_id", "text", WORD, 64).toPandas()
    sizes = rows.groupby("sequence_id").length.sum()
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert sizes.max() <= 64 and len(sizes) <= -(-rows.length.sum() // 64) + 1
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert packing.pack(odd.limit(0), "doc_id", "text", WORD, 64).count() == 0


def test_packing_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 60)
    sizes = np.random.default_rng(0).integers(1, 65, 400)
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "pid bigint, length bigint")
    rows = packing.best_fit(parts, 64).join(parts, "pid").toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(rows.pid) == list(range(400))
    assert rows.groupby("sequence_id").length.sum().max() <= 64 and rows.sequence_id.nunique() <= 1.1 * sizes.sum() / 64
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()


def test_language(spark, odd):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the house and the tree of the king", "en"), ("der Baum und das Haus der Frau", "de"), ("la maison et les arbres de la ville", "fr")] * 20)]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.fit(docs, "text", "lang")
    got = {r.doc_id: r for r in langid.predict(docs.withColumn("score", F.lit(0)), "doc_id", "text", model, carry=True).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 and got[i].row.score == 0 for i, _, x in rows)
    und = langid.predict(odd, "doc_id", "text", model).where("lang_pred = 'und'").collect()
    assert {r.doc_id for r in und} == {0, 1, 2} and all(r.score == 0 for r in und)
    empty = langid.fit(docs.limit(0), "text", "lang")
    assert langid.predict(docs, "doc_id", "text", empty).select("lang_pred").distinct().first()[0] == "und"
    far = langid.codewords(12)
    assert min((a != b).sum() for a, b in itertools.combinations(far, 2)) >= 8


def brute_segments(x):
    """All maximal segments by their definition: repeatedly the best, then left and right of it."""
    if not len(x) or max(x) <= 0:
        return []
    best = max(((sum(x[i:j]), -(j - i), -i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)))
    i, j = -best[2], best[3]
    return brute_segments(x[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(x[j:])]


def hits(x):
    total = [0.0, *itertools.accumulate(x)]
    return [(k, total[k], total[k + 1]) for k in range(len(x)) if x[k] > 0]


def test_segments():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = (np.where(rng.random(14) < 0.5, rng.integers(1, 40, 14), -rng.integers(1, 40, 14)) / 8 + rng.random(14) / 100).tolist()
        got = sorted((i, j) for _, i, j in toxicity.segments(hits(x)))
        assert got == [(i, j) for i, j, _ in brute_segments(x)]


def test_segments_take_linear_time():
    falling = [v for _ in range(64_000) for v in (1.0, -1.5)]  # every token starts lower than those before
    rising = [v for k in range(64_000) for v in (1.0 + k % 7, -0.5 - k % 7)]
    for x in (falling, rising):
        given = hits(x)
        began = time.process_time()
        assert toxicity.segments(given)
        assert time.process_time() - began < 1


def test_toxicity(spark, odd):
    rows = [(f"word{i % 7} plain text {'you idiot' if i % 4 == 0 else 'and more'} to read", int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), "text", "toxic")
    docs = spark.createDataFrame([(1, "what an Idiot, really", "en"), (2, "plain text", "en"), (3, None, None)], DOC)
    got = {r.doc_id: r for r in toxicity.score(docs, "doc_id", "text", model).collect()}
    assert got[1].score > 0.3 > got[2].score and got[1].passages[0].first == 2 and got[3].score == got[2].score
    assert toxicity.score(odd, "doc_id", "text", toxicity.fit(spark.createDataFrame([], "text string, toxic int"), "text", "toxic")).count() == odd.count()


def test_viterbi():
    rng = np.random.default_rng(2)
    model = chat.Model(np.log(rng.dirichlet(np.ones(6))), np.log(rng.dirichlet(np.ones(6), 6)), np.log(rng.dirichlet(np.ones(4), 6)))
    seen = [[], [1], [0, 3, 2, 1], [2, 2, 0]]
    for o, path in zip(seen, chat.viterbi(seen, model), strict=True):
        score = lambda p, o=o: model.start[p[0]] + model.emit[p[0], o[0]] + sum(model.step[a, b] + model.emit[b, x] for a, b, x in zip(p, p[1:], o[1:], strict=False))
        assert tuple(path) == (max(itertools.product(range(6), repeat=len(o)), key=score) if o else ())


def test_chat(spark):
    rows = [(c, t, r, f"{r} says {c} {t}\nand more") for c in range(30) for t, r in enumerate(["system", "user", "assistant", "user"])] + [(None, 0, None, None), (1, 1, "user", "user says 1 1\nand more")]
    raw = chat.transcripts(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), "conv_id", "turn", "role", "text")
    got = chat.parse(raw, ["conv_id"], "transcript", chat.fit(raw, "transcript", "truth")).collect()
    assert len(got) == 30 and all(r.roles == ["system", "user", "assistant", "user"] for r in got)
    empty = spark.createDataFrame([(1, None), (2, "\n\n")], "conv_id int, transcript string")
    assert [r.rendered for r in chat.parse(empty, ["conv_id"], "transcript", chat.fit(raw, "transcript", "truth")).collect()] == ["", ""]


def closed(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rng = np.random.default_rng(10)
    links = [(int(h), int(k)) for h in (0, 50, 999) for k in rng.integers(0, 1000, 40)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7)]
    got = common.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b", "test-links").collect()
    ids = {i for a, b in links for i in (a, b) if a != b}
    assert {r.id: r.component_id for r in got} == closed(ids, [x for x in links if x[0] != x[1]])


@pytest.mark.parametrize(("words", "num", "split"), [(3, 90, 2000), (5, 80, 2000), (5, 80, 3)])
def test_ngram_join(spark, monkeypatch, words, num, split):
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 400, 120)]
    texts = [" ".join(base)] * 3 + ["", None, "one two", "ONE  two", "\n"]
    for _ in range(40):
        x = list(base)
        for k in rng.integers(0, 120, rng.integers(1, 5)):
            x[k] = f"v{rng.integers(0, 9999)}"
        texts.append(" ".join(x))
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 400, 60)) for _ in range(20)]
    texts += [" ".join(base[a:z]) for a, z in rng.integers(0, 40, (30, 2)) + (0, 80)]  # sizes over several bands
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) > 0]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")], DOC).withColumn("n", F.lit(1))
    got = ngram_join.join_components(docs, "doc_id", "text", words, num, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == closed(sets, links) | {None: None}
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got if r.doc_id is not None)


@pytest.mark.parametrize("most", [0, 1, 40, 150, 10_000])
def test_labelled_takes_the_lowest_hashes(spark, tmp_path, most):
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    labels = labels.union(labels).union(spark.createDataFrame([(7, 1), (8, None), (None, 1)], "doc_id bigint, toxic int"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = queries.labelled(spark, str(tmp_path), docs, most).collect()
    rows = labels.where("toxic is not null").where(~common.held_out("doc_id", 4)).distinct().select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r.h, r.doc_id or -1, r.toxic))[:most]
    assert sorted(map(tuple, got)) == sorted((str(r.doc_id), r.toxic) for r in rows if r.doc_id is not None)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(neardup_embed, "CELL", 20)
    monkeypatch.setattr(neardup_embed, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 8))
    v = np.concatenate([x + 0.08 * rng.normal(size=x.shape) * rng.random((30, 1)) for _ in range(6)] + [x[:3]] * 2)
    label = [int(i % 2) for i in range(len(v))]
    rows = [(i, [float(c) for c in r], k) for i, (r, k) in enumerate(zip(v, label, strict=True))]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1), (904, rows[0][1], None)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(len(v), dtype=bool)
    want = closed([r[0] for r in rows], list(zip(*map(list, np.nonzero(hit)), strict=True)))
    got = neardup_embed.range_join(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int"), "vec_id", "embedding", "label").collect()
    assert {r.vec_id: r.component_id for r in got} == {int(k): int(x) for k, x in want.items()}
    assert {r.vec_id: r.n_links for r in got} == {i: int(hit[i].sum()) for i in range(len(v))} | dict.fromkeys(range(900, 905), 0)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(250, 6)), np.repeat(rng.normal(size=(1, 6)), 50, axis=0)])
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)] + [(1000, None), (1100, [None] * 6), (1200, [float("inf")] * 6)]
    q = np.floor(1024 * v).astype(int)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    for i in (0, 100, 200):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(len(v)) if j != i)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == best
    assert len(got) == 30


def test_top_k_of_repeated_rows_and_empty_vectors(spark):
    rows = [(0, [1.0]), (0, [1.0]), (0, [-1.0]), (1, [2.0]), (2, [1.0]), (3, []), (100, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, scale=1).collect())
    assert got == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, -1), (0, 2, 1, -2), (0, 2, 2, 1), (0, 2, 2, 1), (100, 1, 3, 0)]
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_language_model(spark, odd):
    rng = np.random.default_rng(6)
    syllables = ["ba", "ko", "ti", "re", "nu"]
    rows = [(i, " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40)), "xy"[i % 2]) for i in range(60)] + [(None, None, None), (61, "", "x")]
    docs = spark.createDataFrame(rows, DOC)
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = lm.score(docs, "doc_id", "text", "lang", train).collect()
    words = {i: (t or "").split() + [""] for i, t, _ in rows}
    c = Counter(w for i, ws in words.items() if i is not None and i % 3 for w in ws)
    n = sum(c.values())
    for r in got:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score(odd, "doc_id", "text", "lang", F.lit(True)).count() == odd.count()


def test_code_probabilities_sum_to_one():
    rng = np.random.default_rng(7)
    size, slots = 40, 1 << 10
    code = lm.huffman(rng.random(size) + 0.01, rng.integers(0, 3, size), 4)
    symbols = rng.integers(0, size, 500)
    at = np.arange(500)
    task = lm.Learner.new(4, slots)
    for _ in range(3):
        task.read(lm.events(code, symbols, lm.word_contexts(symbols, np.zeros(size, np.int64) - 1, at == 0), at * 0, at, slots))
    mixer = lm.Mixer(code, lm._odds(task.counts.reshape(4, slots, 2)), task.weights, np.tile(1 / (1 + np.exp(-np.linspace(-12, 12, lm.STEPS))), lm.CELLS))
    # every symbol as the third of a text, given the same two before it
    text, place = np.repeat(np.arange(size), 3), np.tile(np.arange(3), size)
    words = np.stack([np.full(size, 5), np.full(size, 9), np.arange(size)], axis=1).ravel()
    run = lambda keep: mixer.log10(lm.events(code, words[keep], [c[keep] for c in lm.word_contexts(words, np.zeros(size, np.int64) - 1, place == 0)], text[keep], place[keep], slots), size)
    last = run(place >= 0) - run(place < 2) + code.rest
    assert math.isclose((10.0**last).sum(), 1, rel_tol=1e-4)
    whole = lm.huffman(rng.random(size), rng.integers(0, 3, size))
    assert math.isclose((0.5 ** np.diff(whole.first)).sum(), 1) and not whole.rest.any()


def test_language_model_beats_the_base_and_edges(spark, odd):
    rng = np.random.default_rng(9)
    word = {x: [f"{x}{k}" for k in range(60)] for x in "pq"}
    rows = [(i, " ".join(rng.choice(word["pq"[i % 2]], 50)), "pq"[i % 2]) for i in range(200)]
    got = lm.score(spark.createDataFrame(rows, DOC), "doc_id", "text", "lang", F.col("doc_id") % 5 != 2).where("doc_id % 5 = 2").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 100  # a text's words are of one of two languages
    assert lm.score(odd.limit(0), "doc_id", "text", "lang", F.lit(True)).count() == 0
    none = lm.score(odd, "doc_id", "text", "lang", F.lit(False)).collect()
    assert len(none) == odd.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in none)


def test_language_model_reads_across_words(spark):
    rng = np.random.default_rng(8)
    left, right = ["alpha", "gamma", "delta", "omega"], ["one", "two", "six", "ten"]
    text = lambda: " ".join(f"{left[k]} {right[k]}" for k in rng.integers(0, 4, 40))
    rows = [(i, text(), "x") for i in range(150)] + [(200, "alpha one", "x"), (201, "alpha two", "x")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, DOC), "doc_id", "text", "lang", F.col("doc_id") < 150).collect()}
    assert got[200].score > got[201].score + 0.5  # the words are as frequent; only the one before tells them apart
    assert math.isclose(got[200].bits_per_byte, -got[200].score * math.log2(10) / len("alpha one  "))
