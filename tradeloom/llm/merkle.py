"""Merkle manifest of a table: a digest for every row, a tree over each group of rows, one root, and a proof for each row.

Rows of a group (a source, say) are leaves in the order of their id; every FANOUT consecutive nodes become their parent's digest
until one node, the subroot, is left.  Subroots in the order of their group likewise give the root.

The tree is built by superblocks: nodes are bucketed by index // FANOUT**k, ``applyInPandas`` collapses k levels of a bucket, and the
buckets' roots are the nodes of the next round, so that n rows take log(n) / (k log FANOUT) rounds and no task holds more than
FANOUT**k nodes.  Proofs come back down the same buckets: each gets the upper part of its proof once and puts the lower part of every
member in front of it.  Indices come from a range sort with the counts of each range, so a group of any size is dealt over many tasks.

Defined results: null fields are ``-``; null ids come first and are tampered with never; rows of equal id are ordered by digest, and
equal rows are leaves of their own; a null group is a group; an empty table gives no rows; other columns have no part.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, prepare, written

#: Nodes of a run.
FANOUT = 16
#: Levels that a bucket collapses: FANOUT**LEVELS nodes of 64 bytes are a task's share.
LEVELS = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def row_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row: each field as UTF-8 byte count, colon and value, or - if null."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with idx, its place in its key by the order, and n, the key's rows.  A hot key is many ranges."""
    parts = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    parts = written(parts, name).withColumn("_part", F.shiftright("_at", 33))
    sizes = parts.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(key, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    return parts.join(sizes, [key, "_part"]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n")


def depth(n: int, most: int) -> int:
    """Levels until one of n nodes is left, at most so many."""
    d = 0
    while n > 1 and d < most:
        n, d = -(-n // FANOUT), d + 1
    return d


def rows_up(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones on."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([digest("".join(rows[-1][i : i + FANOUT])) for i in range(0, len(rows[-1]), FANOUT)])
    return rows


def siblings(rows: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each level but the last and each of its nodes: its run's nodes on the left and on the right, joined."""
    out = []
    for row in rows[:-1]:
        runs = [row[i - i % FANOUT : i - i % FANOUT + FANOUT] for i in range(len(row))]
        out.append([("".join(run[: i % FANOUT]), "".join(run[i % FANOUT + 1 :])) for i, run in enumerate(runs)])
    return out


def climb(nodes: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """Buckets of each round from (key, idx, n, node, id, changed): (key, bucket, n, top, node, id, changed), arrays by index.

    The last round has one bucket of each key; its ``top`` is the key's root.
    """
    span = FANOUT**levels

    def collapse(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        members, n = part["node"].tolist(), int(part["n"].iloc[0])
        top = rows_up(members, depth(n, levels))[-1][0]
        return pd.DataFrame({"key": [key[0]], "bucket": [key[1]], "n": [n], "top": [top], "node": [members], "id": [part["id"].tolist()], "changed": [part["changed"].tolist()]})

    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        dealt = nodes.withColumn("bucket", F.floor(F.col("idx") / span)).groupBy("key", "bucket")
        done = dealt.applyInPandas(collapse, "key string, bucket bigint, n bigint, top string, node array<string>, id array<string>, changed array<string>")
        rounds.append(written(done, name))
        if most <= span:
            return rounds
        most = -(-most // span)
        none = F.lit(None).cast("string")
        nodes = rounds[-1].select("key", F.col("bucket").alias("idx"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("node"), none.alias("id"), none.alias("changed"))


def _unpacked(b: pa.RecordBatch, levels: int):
    """Each bucket of a batch with the levels of its nodes and their siblings."""
    for x in b.to_pylist():
        rows = rows_up(x["node"], depth(x["n"], levels))
        yield x, siblings(rows)


def descend(rounds: list[DataFrame], tops: DataFrame, last: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, levels: int = LEVELS) -> DataFrame:
    """Carry upper proofs (key, lefts, rights, subroot, root) from the last round's buckets down; ``last`` makes rows of the first round's."""
    span = FANOUT**levels

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x, sides in _unpacked(b, levels):
            for i in range(len(x["node"])):
                at = [side[i // FANOUT**d] for d, side in enumerate(sides)]
                out.append({"key": x["key"], "bucket": x["bucket"] * span + i, "lefts": [y for y, _ in at] + x["lefts"], "rights": [y for _, y in at] + x["rights"], "subroot": x["subroot"], "root": x["root"]})
        return pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())]))

    upper = tops.withColumn("bucket", F.lit(0).cast("bigint"))
    for blocks in reversed(rounds[1:]):
        upper = blocks.join(upper, ["key", "bucket"]).mapInArrow(by_batch(spread), "key string, bucket bigint, lefts array<string>, rights array<string>, subroot string, root string")
    return rounds[0].join(upper, ["key", "bucket"]).mapInArrow(by_batch(last), schema)


def proven(b: pa.RecordBatch, levels: int, whole: bool) -> pa.RecordBatch:
    """Every leaf of the buckets with its proof's digest and the root that its changed self gives with the original siblings."""
    out = []
    for x, sides in _unpacked(b, levels):
        upper = "".join(y + z for y, z in zip(x["lefts"], x["rights"], strict=True))
        tails = [upper]  # of the bucket's root, then of each level's nodes downwards
        for side in reversed(sides):
            tails = [left + right + tails[i // FANOUT] for i, (left, right) in enumerate(side)]
        over = list(zip(x["lefts"], x["rights"], strict=True))
        for i, (leaf, changed) in enumerate(zip(x["node"], x["changed"], strict=True)):
            path = [side[i // FANOUT**d] for d, side in enumerate(sides)] + over
            folded = changed or leaf
            for left, right in path:
                folded = digest(left + folded + right)
            row = {"id": x["id"][i], "leaf": leaf, "subroot": x["subroot"], "root": x["root"], "proof_sha256": digest(tails[i]), "folded_root": folded}
            out.append(row | {"lefts": [y for y, _ in path], "rights": [z for _, z in path]} if whole else row)
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    fields = [(c, pa.string()) for c in names] + [(c, pa.list_(pa.string())) for c in ("lefts", "rights") if whole]
    return pa.RecordBatch.from_pylist(out, pa.schema(fields))


def manifest(df: DataFrame, id_col: str, group_col: str, fields: dict[str, Column], changed: dict[str, Column], where: Column, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    fields: what a row's digest holds; changed: what it would hold after tampering, for rows where ``where`` is true.  With ``proofs``
    also lefts and rights: the siblings' digests on either side, joined, for each level from the leaf to the root.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    # a group's name in an order with null first
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    tampered = F.when(where, row_digest(changed))
    leaves = df.select(group.alias("key"), F.col(id_col).alias("id"), row_digest(fields).alias("node"), tampered.alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = written(leaves, "merkle-leaves")
    nodes = ranked(leaves, "key", ["id", "node", "row"], "merkle-order").select("key", "idx", "n", "node", F.col("id").cast("string").alias("id"), "changed")
    rounds = climb(nodes, "merkle", levels)
    subroots = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("top").alias("node"), F.lit(None).cast("string").alias("changed"))
    upper = climb(ranked(subroots, "key", ["id"], "merkle-groups"), "merkle-top", levels)
    none = F.array().cast("array<string>")
    tops = upper[-1].select("key", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    names = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    sides = ", lefts array<string>, rights array<string>"
    above = descend(upper, tops, lambda b: proven(b, levels, True), names + sides, levels)
    tops = written(above.select(F.col("id").alias("key"), "lefts", "rights", F.col("leaf").alias("subroot"), "root"), "merkle-subroots")
    out = descend(rounds, tops, lambda b: proven(b, levels, proofs), names + sides * proofs, levels)
    more = ["lefts", "rights"] if proofs else []
    return out.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *more)


def lower_ascii(text: Column) -> Column:
    """A-Z of a text in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())
