"""Near duplicates among embeddings: an exact metric range join on pivots.

Unit vectors with a cosine of at least c lie within r = sqrt(2 - 2c) of each other.  Equal vectors of a label are one node.
Pivots drawn from all nodes cut every label into Voronoi cells.  A node is at home in its nearest pivot's
cell and a guest in each cell whose border is within r of it: by the triangle inequality any partner at home there lies across
that border.  So a home node meets all its partners in its own cell, and cells join independently.  Cells that are
larger than a block are joined block by block.  A join yields each home node's number of links and a
spanning forest of the links, never the pairs.  A cell of s vectors in blocks of b ships each vector s / b times, as exact counts of links
need all products within it.

Rows whose label or vector is null, or whose vector is zero or holds null or non-finite components, link with nothing; so
do rows without id.  Vectors of different lengths are not compared.  Every repeated row counts as a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, prepare, written

#: Nodes for a pivot, and the most pivots (8 MB of 64 dimensions), so that they can be broadcast.
CELL, MOST_PIVOTS = 2048, 16_384
#: Nodes of a block in a cell's join.
BLOCK = 1024
#: Rounding errors must not lose a guest: errors of squared distances, some 1e-15, over twice the least distance of pivots.
SLACK, CLOSE = 1e-9, 1e-5


def _nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, v): rows that may link, v the unit vector as bytes of doubles."""

    def run(batches):
        for b in batches:
            out = []
            for i, v, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if not v.is_valid or label is None or i is None or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()
                out.append((i, label, len(x), (x / np.sqrt(x @ x) + 0.0).tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["id", "label", "dim", "v"])

    return df.select(F.col(id_col).cast("bigint"), vector_col, F.col(label_col).cast("string")).mapInArrow(run, "id bigint, label string, dim int, v binary")


def _dealt(nodes: DataFrame, radius: float) -> DataFrame:
    """(label, dim, cell, home, node, m, v): every node in its home cell and, as a guest, in the cells near it."""
    count = nodes.count()
    share = min(1 / CELL, MOST_PIVOTS / max(1, count))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "dim", "v")
    pivots: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in drawn.limit(2 * MOST_PIVOTS).collect():
        pivots.setdefault((r.label, r.dim), []).append(np.frombuffer(bytes(r.v)))
    shared = nodes.sparkSession.sparkContext.broadcast({k: np.stack(p) for k, p in pivots.items()})

    def run(batches):
        for b in batches:
            labels, dims = b.column("label").to_pylist(), b.column("dim").to_pylist()
            rows, cells, home = [], [], []
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                by.setdefault(key, []).append(i)
            for key, at in by.items():
                p = shared.value.get(key)
                if p is None:
                    rows += at
                    cells += [0] * len(at)
                    home += [True] * len(at)
                    continue
                x = np.stack([np.frombuffer(b.column("v")[i].as_buffer()) for i in at])
                d2 = ((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T).clip(0)
                near = d2.argmin(axis=1)
                apart = np.sqrt((2 - 2 * (p[near] @ p.T)).clip(0))
                border = (d2 - d2.min(axis=1, keepdims=True)) / np.maximum(2 * apart, CLOSE)
                guest = (border <= radius + SLACK) | (apart < CLOSE)  # between pivots that nearly coincide there is no border to trust
                guest[np.arange(len(at)), near] = True
                i, c = np.nonzero(guest)
                rows += [at[k] for k in i]
                cells += c.tolist()
                home += (c == near[i]).tolist()
            take = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column(n) for n in ("label", "dim", "node", "m", "v")] + [pa.array(cells, pa.int32()), pa.array(home, pa.bool_())], names=["label", "dim", "node", "m", "v", "cell", "home"])

    return nodes.select("label", "dim", "node", "m", "v").mapInArrow(run, "label string, dim int, node bigint, m bigint, v binary, cell int, home boolean")


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest index in the component of each of size indices, given links a, b."""
    low = np.arange(size)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def range_join(df: DataFrame, id_col: str, vector_col: str, label_col: str, cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of df; component_id is the smallest id reachable by links."""
    prepare(df.sparkSession)
    rows = written(_nodes(df, id_col, vector_col, label_col), "vectors").withColumn("h", F.xxhash64("v")).withColumn("g", F.sha1("v"))
    nodes = written(rows.groupBy("label", "dim", "g").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("node", F.xxhash64("label", "g")), "vector-nodes")
    dealt = written(_dealt(nodes, float(np.sqrt(max(0.0, 2 - 2 * cosine)))), "cells")
    key = ["label", "dim", "cell"]
    blocks = dealt.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.where("home").select(*key, F.col("block").alias("i"), every.alias("j"), F.lit(True).alias("left"), "node", "m", "v")
    right = dealt.select(*key, every.alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), "node", "m", "v")

    def run(t: pa.Table) -> pa.Table:
        side = t.column("left").to_numpy()
        node, m = t.column("node").to_numpy(), t.column("m").to_numpy()
        x = np.stack([np.frombuffer(v.as_buffer()) for c in t.column("v").chunks for v in c])
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        hit = (x[a] @ x[b].T >= cosine) & (node[a][:, None] != node[b][None])
        links = hit @ m[b] if len(b) else np.zeros(len(a), np.int64)
        ids, code = np.unique(node, return_inverse=True)
        i, j = np.nonzero(hit)
        low = _forest(code[a][i], code[b][j], len(ids))
        linked = np.flatnonzero(low != np.arange(len(ids)))
        none = np.full(len(linked), 0, np.int64)
        return pa.table({"node": np.concatenate([node[a], ids[linked]]), "links": np.concatenate([links, none]).astype(np.int64), "root": pa.array(np.concatenate([node[a], ids[low[linked]]]))})

    met = written(left.union(right).groupBy(*key, "i", "j").applyInArrow(run, "node bigint, links bigint, root bigint"), "met")
    name = nodes.select("node", "id", "m")
    ends = met.where("node <> root").select("node", "root").distinct().join(name.select("node", F.col("id").alias("u")), "node").join(name.select(F.col("node").alias("root"), F.col("id").alias("v")), "root")
    comp = components(ends, "u", "v", "vector-links")
    degree = met.groupBy("node").agg(F.sum("links").alias("links"))
    state = name.join(degree, "node", "left").join(comp, "id", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    live = rows.select("id", F.xxhash64("label", "g").alias("node")).join(state, "node").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(id_col).cast("bigint").alias("id")).join(live, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
