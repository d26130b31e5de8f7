"""Phrases by bitmaps against plain counting: in memory over many small shards, and the whole operator on edge rows."""

import gc
import random
import re
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tradeloom.llm import collocations


def counted(rows):
    """Occurrences of (lang, phrase) for one to four words, and words by language."""
    seen, n = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    seen[lang or "und", " ".join(w[i : i + k])] += 1
    return seen, n


def plain(rows, least):
    seen, n = counted(rows)
    longer = Counter()
    for (lang, phrase), f in seen.items():
        w = phrase.split(" ")
        if f >= least and len(w) > 2:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    key = lang, " ".join(w[i : i + k])
                    longer[key] = max(longer[key], f)
    found = {}
    for (lang, phrase), a in seen.items():
        w = phrase.split(" ")
        if len(w) < 2 or a < least or 100 * longer[lang, phrase] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = seen[lang, " ".join(w[:k])], seen[lang, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    out = []
    for lang, x in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(x)[:2000], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(rng, n, known="the of and Harbour village é north ship x1 x2"):
    return "".join(rng.choice(known.split()) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\x0b"]) for _ in range(n))


def test_many_shards(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 64)
    monkeypatch.setattr(collocations, "HELD", 100)
    monkeypatch.setattr(collocations, "BATCH", 5)
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr", "und"]), prose(rng, rng.randint(0, 60))) for _ in range(60)] + [("en", "one long piece without any mark " * 40), ("en", "a b " * 60), ("fr", None), ("fr", ".")]
    batches = [pa.RecordBatch.from_pydict({"lang": [x for x, _ in rows[i : i + 7]], "text": [t for _, t in rows[i : i + 7]]}) for i in range(0, len(rows), 7)]
    shards = list(collocations._shards(iter(batches)))
    assert len(shards) > 30 and len({x["shard"][0].as_py() for x in shards}) == len(shards)
    got, by_hash = Counter(), Counter()
    for x in shards:
        x = pa.Table.from_batches([x])
        for t, c in ((x, "word"), (collocations._phrases(x, np.full(1024, -1)), "phrase")):
            for r in t.to_pylist():
                got[r["lang"], r[c]] += r["n"]
        for r in collocations._pairs(x).to_pylist():
            by_hash[r["h"]] += r["n"]
    seen = counted(rows)[0]
    assert +got == +seen
    # pairs by their hashes, which no two share here
    assert sorted(x for x in by_hash.values() if x) == sorted(n for (_, phrase), n in seen.items() if phrase.count(" ") == 1)


def test_collocations(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["en", "en", "fr", None]), prose(rng, 80)) for _ in range(150)]
    rows += [("en", "new york city is large. " * 5)] * 9 + [("en", "a b " * 40), (None, None), ("de", ""), ("de", "zu selten"), ("en", "Über " * 50_000), ("en", "x" * 60_000)]
    df = spark.createDataFrame([(*r, 1, "w", 3) for r in rows], "lang string, text string, n int, word string, phrase int").repartition(5)
    got = collocations.collocations(df, "lang", "text", least=30)
    assert sorted(map(tuple, got.collect())) == plain(rows, 30) != []


def test_hashes_find_their_bits(spark):
    words = pa.array(["a", "b", "é", "c", "d"])
    h = {lang: collocations.word_hashes(lang, words) for lang in ("en", "fr")}
    pairs = {("en", 0, 1), ("fr", 0, 1), ("en", 2, 3)}
    of = lambda lang, i, j: collocations.pair_hashes(h[lang][i : i + 1], h[lang][j : j + 1])
    table = collocations.bits_of(spark.createDataFrame([(int(of(*p).view("i8")[0]),) for p in pairs], "h bigint")).value
    assert {(lang, i, j) for lang in h for i in range(5) for j in range(5) if collocations.known(table, of(lang, i, j))[0]} == pairs


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string"), "lang", "text").collect() == []


def test_shards_are_let_go(monkeypatch):
    kept = weakref.WeakSet()

    class Seen(collocations.ShardIndex):
        def __init__(self, rows):
            super().__init__(rows)
            kept.add(self)

    monkeypatch.setattr(collocations, "ShardIndex", Seen)
    monkeypatch.setattr(collocations, "BATCH", 20)
    words, stream = collocations.layout(pa.array([prose(random.Random(7), 400)]))
    shard = pa.Table.from_batches([collocations.bitmaps("en", 0, words, stream)])
    gc.disable()  # what is left in cycles would stay, shard after shard
    try:
        whole = collocations._phrases(shard, np.full(1024, -1))
        assert not kept
        parts = [x.num_rows for x in collocations.phrases_of(shard, np.full(1024, -1))]
    finally:
        gc.enable()
    assert sum(parts) == whole.num_rows and max(parts) < whole.num_rows / 4
