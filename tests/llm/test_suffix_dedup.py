"""Removal of repeated strings against a plain table of all windows, in memory and through Spark."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from tradeloom.llm import suffix_dedup

N = suffix_dedup.LENGTH


def plain(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + N] for t in raw for i in range(len(t) - N + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - N + 1):
            if seen[t[i : i + N]] > 1:
                gone[i] += 1
                gone[i + N] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(t), int(gone.sum()), spans, sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def words(rng, n, letters="abcdefgh é"):
    return "".join(rng.choices(letters, k=n))


def texts(rng):
    hot, line, long = words(rng, 430), "the same line of the letter again and again. ", words(rng, 900)
    out = [words(rng, rng.randint(300, 900)) + hot + words(rng, rng.randint(0, 300)) for _ in range(60)]
    out += [long, long, long[:500] + "X" + long[501:], long[250:], "a" * 450, "b" * 399, "b" * 400, line * 40, line * 12, line * 9, "ab" * 500]
    out += [None, "", " ", words(rng, 399), words(rng, 401), hot[:399], hot[:400], hot + hot, "é" * 300, words(rng, 40_000) + long[:420]]
    return out


@pytest.mark.parametrize("limits", [(1024, 512), (6, 8)])
def test_remove_repeats(spark, monkeypatch, limits):
    monkeypatch.setattr(suffix_dedup, "GROUP", limits[0])
    monkeypatch.setattr(suffix_dedup, "BLOCK", limits[1])
    rows = texts(random.Random(3))
    ids = [None if i == 5 else i // 2 for i in range(len(rows))]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids, rows, strict=True)], "doc_id bigint, text string, t string, start int, piece int")
    got = suffix_dedup.remove_repeats(df, "doc_id", "text", keep=True).collect()
    want = plain(rows)
    assert sorted([tuple(r[:5]) for r in got], key=repr) == sorted([(i, *w) for i, w in zip(ids, want, strict=True)], key=repr)
    for r in got:
        assert sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.removed) == r.n_spans and sum(s.stop - s.start for s in r.removed) == r.n_removed
    assert sum(w[1] > 0 for w in want) > 60


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").collect() == []


def test_cover_orders_suffixes():
    rng = np.random.default_rng(1)
    raw = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 100, 600), 3)]).astype(np.uint8)
    padded = np.concatenate([raw, np.zeros(2 * N, np.uint8)])
    heads = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,)).astype(np.uint64)
    places = np.arange(len(raw) - N + 1)
    group = suffix_dedup._names(heads[places])
    order = suffix_dedup.CoverRanks(heads, len(raw) + N).order(places, group)
    cut = [raw[i : i + N].tobytes() for i in places[order]]
    assert cut == sorted(cut)


def test_repeated_windows():
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.integers(97, 105, 5000), np.tile(rng.integers(97, 100, 700), 2), np.full(900, 97)]).astype(np.uint8)
    windows = np.arange(len(raw) - N + 1)
    seen = Counter(raw[i : i + N].tobytes() for i in windows)
    want = [i for i in windows.tolist() if seen[raw[i : i + N].tobytes()] > 1]
    assert suffix_dedup.repeated(raw, windows).tolist() == want


def test_passages_by_bytes_not_by_words(spark):
    """A passage of over 50 words that two documents share goes from 400 bytes on, as the contract says, and stays below."""
    words = [f"{k:02d}word" for k in range(80)]
    short, long = " ".join(words[:57]), " ".join(words[:57]) + "x"
    assert len(short.split()) > 50 and (len(short), len(long)) == (398, 399)
    rows = [(1, f"<{short}>"), (2, f"[{short}]"), (3, "(" + long[::-1] + "y)"), (4, "{" + long[::-1] + "y}")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {1: 0, 2: 0, 3: 400, 4: 400}
