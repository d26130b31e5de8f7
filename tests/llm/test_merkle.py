"""The Merkle manifest against a plain tree, on edge rows, few and many levels, and empty tables."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tradeloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, node string, key string"


def h(text):
    return sha256(text.encode()).hexdigest()


def up(nodes):
    """Levels of a tree, the last of one node."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([h("".join(rows[-1][i : i + 16])) for i in range(0, len(rows[-1]), 16)])
    return rows


def path(rows, i):
    """(left, right) siblings from a leaf to the root."""
    out = []
    for row in rows[:-1]:
        run = row[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def plain(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[g] = up([leaf(r, r[4]) for r in groups[g]])
    top = up([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = "".join(c.lower() if c in merkle.UPPER else c for c in r[4]) if bad and r[4] is not None else r[4]
            folded = leaf(r, text)
            for a, b in steps:
                folded = h(a + folded + b)
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(df, "doc_id", "source", fields, fields | {"text": merkle.lower_ascii(F.col("text"))}, tampered, **more)


ROWS = [(i, "hot" if i % 3 else f"src{i % 40}", "en", i, f"Text É number {i}") for i in range(700)]
EDGES = [(None, None, None, None, None), (None, "hot", "en", 1, "no id"), (7001, None, "fr", 2, ""), (7002, "é", None, None, "A" * 100_000), (5, "hot", "en", 5, "Text of the same id"), (6, "src6", "en", 6, "Text É number 6"), (6, "src6", "en", 6, "Text É number 6"), (2**60 + 1, "Src", "en", 0, "large")]


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(spark, levels):
    rows = ROWS + EDGES
    got = sorted(map(tuple, made(spark, rows, levels=levels).collect()), key=repr)
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_one_row_and_none(spark):
    one = made(spark, [(3, "s", "en", 1, "alone")]).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == h("") and one[0].verified
    assert made(spark, []).collect() == []


def test_proofs_fold_to_the_root(spark):
    for r in made(spark, ROWS, proofs=True, levels=1).collect():
        node = r.leaf
        for left, right in zip(r.lefts, r.rights, strict=True):
            node = h(left + node + right)
        assert node == r.root and h("".join(a + b for a, b in zip(r.lefts, r.rights, strict=True))) == r.proof_sha256
