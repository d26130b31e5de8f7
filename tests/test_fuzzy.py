"""One-to-one matching by likeness against a brute-force version, on edge rows and empty tables."""

import hashlib
import random

import pytest

from tradeloom.operators import fuzzy

SCHEMA = "id bigint, k string, name string, note string"


def grams(text):
    padded = f" {text.lower()} "
    return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}


def brute(left, right, least):
    """Greedy over all pairs of texts of a key, by score and digest."""
    sides = []
    for rows in (left, right):
        texts = {}
        for i, k, name, _ in rows:
            if None not in (i, k, name):
                texts.setdefault((k, name), []).append(i)
        sides.append({key: sorted(ids) for key, ids in texts.items()})
    pairs = []
    for (k, a), ids in sides[0].items():
        for (k2, b), other in sides[1].items():
            if k == k2:
                both = len(grams(a) & grams(b))
                score = both * 1_000_000 // (len(grams(a)) + len(grams(b)) - both)
                if score >= least * 1_000_000:
                    pairs.append((score, hashlib.md5(f"{ids[0]}:{other[0]}".encode()).hexdigest(), ids, other))
    out = []
    left_of, right_of = {id(v): list(v) for v in sides[0].values()}, {id(v): list(v) for v in sides[1].values()}
    for score, _, ids, other in sorted(pairs, key=lambda p: p[:2], reverse=True):
        a, b = left_of[id(ids)], right_of[id(other)]
        while a and b:
            out.append((a.pop(0), b.pop(0), score))
    out += [(i, None, None) for rest in left_of.values() for i in rest]
    return out + [(i, None, None) for i, k, name, _ in left if None in (i, k, name)]


def rows_of(seed, n, start):
    r = random.Random(seed)
    words = ["hex bolt", "hex bolts", "Hex Bolt M8", "steel washer", "steel washers", "ring", "", "x", "đai ốc", "copper wire " * 40]
    rows = [(start + i, r.choice(["A", "A", "A", "B"]), r.choice(words) + r.choice(["", "", " a", " b2"]), None) for i in range(n)]
    hot = [(start + n + i, "A", "hex bolt", "n") for i in range(n // 2)]  # a third of all rows share one text
    return [*rows, *hot, (None, "A", "ring", None), (start + 5000, None, "ring", None), (start + 5001, "A", None, None), rows[0], rows[0]]


@pytest.mark.parametrize("split", [2000, 2])
def test_matched_equals_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(fuzzy, "SPLIT", split)
    monkeypatch.setattr(fuzzy, "BLOCK", 7)
    left, right = rows_of(1, 60, 0), rows_of(2, 45, 10_000)
    a = spark.createDataFrame(left, SCHEMA)
    b = spark.createDataFrame(right, SCHEMA).withColumnRenamed("id", "other")
    got = sorted(map(tuple, fuzzy.matched(a, b, "id", "other", "k", "name").collect()), key=repr)
    assert got == sorted(brute(left, right, 0.5), key=repr)
    assert len(got) == len(left) and any(x[1] is None for x in got)


def test_stable(spark):
    """No pair that was left out is better than what both its ends have."""
    left, right = rows_of(3, 50, 0), rows_of(4, 50, 10_000)
    got = fuzzy.matched(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).withColumnRenamed("id", "other"), "id", "other", "k", "name").collect()
    mine, theirs = {}, {}
    for i, o, s in got:
        mine[i] = min(s or 0, mine.get(i, 10**9))
        theirs[o] = min(s or 0, theirs.get(o, 10**9))
    for i, k, a, _ in left:
        for o, k2, b, _ in right:
            if None not in (i, k, a, o, b) and k == k2:
                both = len(grams(a) & grams(b))
                score = both * 1_000_000 // (len(grams(a)) + len(grams(b)) - both)
                assert score < 500_000 or score <= mine[i] or score <= theirs.get(o, 0)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "A", "ring", None)], SCHEMA)
    other = lambda df: df.withColumnRenamed("id", "other")
    assert fuzzy.matched(none, other(none), "id", "other", "k", "name").collect() == []
    assert fuzzy.matched(none, other(some), "id", "other", "k", "name").collect() == []
    assert [tuple(r) for r in fuzzy.matched(some, other(none), "id", "other", "k", "name").collect()] == [(1, None, None)]
