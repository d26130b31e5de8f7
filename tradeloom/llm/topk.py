"""Exact top-k by inner product with MaxScore.

Every dimension of an integer vector is a query term whose posting list is a shard's column.  A term's score bound is the
largest product it can add in the shard.  The terms with the smallest bounds whose sum stays below the k-th best score so
far are non-essential: a vector that no essential term favours can't enter the result.  The essential postings of a
shard are traversed for all its vectors; the other terms are probed, largest bound first, only for vectors whose partial
score plus the bounds still open reaches the threshold.  Ties reach it too, so smaller ids win them exactly.
Shards and blocks of queries are dealt to groups of fixed size; each group yields k rows a query, which are merged.

Vectors that are null or hold null or non-finite components, and rows without id, take no part.  Vectors of different
lengths are not compared; empty ones score 0.  Rows of the query's own id are no candidates.  Repeated rows are candidates each, and
a query each: the ranks of a repeated query row occur as often as the row does.  Work grows with vectors times queries, which an
exact search of a share of all rows can't avoid; bounds only cut its constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 4096, 1024


def quantized(vectors: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null where a component is null or not finite."""
    v = F.col(vectors)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def search(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard, given as terms x vectors; ties to smaller ids."""
    bound = np.maximum(query * postings.max(axis=1), query * postings.min(axis=1))
    bound = np.maximum(bound, 0)
    order = np.argsort(-bound, kind="stable")
    # the threshold from the first vectors' exact scores
    first = query @ postings[:, : max(k + 1, 256)]
    first = first[ids[: len(first)] != own]
    least = np.partition(first, -k)[-k] if len(first) >= k else -np.inf
    open_ = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bounds of the terms from each place on
    essential = int(np.searchsorted(-open_, -least, side="right")) if least > 0 else len(order)
    essential = min(len(order), max(1, essential))
    terms = order[:essential]
    live = np.flatnonzero(ids != own)
    partial = (query[terms] @ postings[terms])[live]
    at = essential
    while True:
        if len(partial) >= k:
            # what the partial scores and the lowest the open terms can add already secure
            rest = order[at:]
            lowest = np.minimum(query[rest] * postings[rest].max(axis=1), query[rest] * postings[rest].min(axis=1)).sum()
            least = max(least, np.partition(partial, -k)[-k] + lowest)
            keep = partial + open_[at] >= least
            live, partial = live[keep], partial[keep]
        if at == len(order):
            break
        more = order[at : at + 4]
        partial = partial + query[more] @ postings[np.ix_(more, live)]
        at += len(more)
    best = np.lexsort((ids[live], -partial))[:k]
    return ids[live][best], partial[best]


def top_k(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of every row that is a query."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), quantized(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("id is not null and v is not null").withColumn("dim", F.size("v"))
    n, m = rows.agg(F.count("*"), F.count_if(F.col("q"))).first()
    once = rows.where("q").groupBy("dim", "id", "v").agg(F.count("*").alias("times")).withColumn("query", F.xxhash64("id", "v"))
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    spread = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    none = F.lit(0).cast("bigint")
    docs = rows.select("dim", spread(shards).alias("shard"), every(blocks).alias("block"), "id", "v", F.lit(False).alias("q"), none.alias("query"), none.alias("times"))
    asks = once.select("dim", every(shards).alias("shard"), spread(blocks).alias("block"), "id", "v", F.lit(True), "query", "times")

    def run(t: pa.Table) -> pa.Table:
        q = t.column("q").to_numpy()
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), t.column("dim")[0].as_py())
        if 2 * np.log2(max(2, np.abs(v).max(initial=0))) + np.log2(max(1, v.shape[1])) < 53:
            v = v.astype(np.float64)  # whole numbers below 2^53: exact
        postings, own = np.ascontiguousarray(v[~q].T), ids[~q]
        query, times = t.column("query").to_numpy(), t.column("times").to_numpy()
        out = [(np.zeros(0),) * 5]
        for i in np.flatnonzero(q) if len(own) else []:
            found, score = search(postings, own, v[i], ids[i], k)
            out.append((*(np.full(len(found), x[i]) for x in (ids, query, times)), found, score))
        cat = [np.concatenate(c[1:] or c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("query_id", "query", "times", "vec_id", "score"), cat, strict=True)) | {"salt": cat[3] % 64})

    found = docs.union(asks).groupBy("dim", "shard", "block").applyInArrow(run, "query_id bigint, query bigint, times bigint, vec_id bigint, score bigint, salt bigint")
    for keys in (["query_id", "query", "salt"], ["query_id", "query"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("query_id", "rank", "vec_id", "score")
