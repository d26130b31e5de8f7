"""Jaccard self-join of documents on word n-grams, as a grouped prefix join.

A document is the set of its distinct shingles (64-bit hashes).  Documents with equal sets are one node.  Shingles are
ordered by their document frequency, read from a table of fixed size that counts all documents, so that rare
ones come first; two sets that reach the threshold share a shingle among their first few (their prefixes).
Nodes with the same prefix and size are one group, and groups, not documents, enter the inverted index.
Group pairs pass a size and a position filter, are expanded to their members and verified on whole sets.

Components are asked for, not pairs, so a posting list is first linked to one hub per size band, which costs a pair per
entry; only pairs of entries that these links leave in different components are then compared, in neighbouring size bands and
in parts of a long list.  A group of
near copies thus costs its size, not its square, and no link between different components is lost.

Texts are lower-cased A-Z and split on ASCII white space.  A text of fewer words than a shingle is one shingle;
a null or empty one has none and links with nothing.  A null id keeps its row and links with nothing.
Repeated ids count as one document whose rows keep their own sets; all get the component of that id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import byte_order, components, distinct_words, drop_written, prepare, tidy, written

#: Entries of a posting list that meet in one task; longer lists are cut into parts.
SPLIT = 2000
#: Slots of the frequency table: a fixed size, so that it can be broadcast (4 MB).
SLOTS = 1 << 20
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    h = (h ^ (h >> np.uint64(29))) * _C[1]
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from xxhash import xxh3_64_intdigest

    texts = pc.ascii_lower(texts)
    vocab, at, offsets = distinct_words(texts)
    code = np.fromiter((xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))
    blank = np.fromiter((w == "" for w in vocab), bool, len(vocab))[at] if len(at) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(~blank)])[offsets]
    h = code[at[~blank]] if len(at) else np.zeros(0, np.uint64)
    gram = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        gram = _mix(gram * _C[0] + h[k : len(h) - words + 1 + k] + np.uint64(k + 1)) if len(gram) else gram
    out = []
    for a, z in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(gram[a : z - words + 1]))
        elif z > a:
            one = np.array([z - a], np.uint64)
            for x in h[a:z]:
                one = _mix(one * _C[2] + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def frequencies(df: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Documents per slot of shingles, over all documents.  The driver gets SLOTS numbers in a few hundred chunks."""
    chunk = SLOTS // 256

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            texts = byte_order(b.column(0))
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], words)
                n += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS) if sets else 0
        parts = [n[k : k + chunk].astype("<i4").tobytes() for k in range(0, SLOTS, chunk)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array(parts, pa.binary())], names=["chunk", "n"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:  # a row of each task
        total = np.zeros(chunk, np.int64)
        for x in rows.column("n"):
            total += np.frombuffer(x.as_buffer(), "<i4")
        total = np.minimum(total, 2**31 - 1).astype("<i4").tobytes()
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([total], pa.binary())})

    tasks = df.select(text_col).coalesce(max(64, df.sparkSession.sparkContext.defaultParallelism)).mapInArrow(count, "chunk bigint, n binary")
    rows = tasks.groupBy("chunk").applyInArrow(add, "chunk bigint, n binary").collect()
    out = np.zeros(SLOTS, np.int32)
    for r in rows:
        out[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(bytes(r.n), "<i4")
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """(id, n, fp1, fp2, prefix): set size, fingerprint of the set, and its prefix, rarest shingle first."""
    shared = df.sparkSession.sparkContext.broadcast(frequencies(df, text_col, words))  # SLOTS x 4 bytes

    def run(batches):
        freq = shared.value
        for b in batches:
            texts, ids = byte_order(b.column(1)), b.column(0).cast(pa.int64())
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], words)
                size = np.array([len(s) for s in sets], np.int64)
                need = size - -(-size * num // den) + (size > 0)
                fp1 = np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                fp2 = np.array([_mix(s ^ _C[2]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                first = [s[np.lexsort((s, freq[_slot(s)]))[:k]].view(np.int64) for s, k in zip(sets, need.tolist(), strict=True)]
                flat = pa.array(np.concatenate(first)) if first else pa.array([], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(need)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(size), pa.array(fp1), pa.array(fp2), lists], names=["id", "n", "fp1", "fp2", "prefix"])

    return df.select(id_col, text_col).mapInArrow(run, "id bigint, n bigint, fp1 bigint, fp2 bigint, prefix array<bigint>")


def _sets(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the given nodes (id, fp1, node); a node is told from another row of its id by its fingerprint."""

    def run(batches):
        for b in batches:
            texts, want = byte_order(b.column(0)), b.column(1).to_numpy()
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], words)
                fp1 = np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                rows = pa.RecordBatch.from_arrays([b.column(2)[i:j], pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
                yield rows.filter(pa.array(fp1 == want[i:j]))

    some = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(nodes.select("id", "fp1", "node"), "id")
    return some.select("text", "fp1", "node").mapInArrow(run, "node bigint, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _near(pairs: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (x, y) of groups whose prefixes share enough: what follows the prefix that ends first is all they can add."""
    side = lambda k: groups.select(F.col("gid").alias(k), F.col("n").alias(f"{k}_n"), F.col("prefix").alias(f"{k}_prefix"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    more = F.greatest(F.col("x_n") - F.size("x_prefix"), F.col("y_n") - F.size("y_prefix"))
    most = F.size(F.array_intersect("x_prefix", "y_prefix")) + more
    return both.where(most * (num + den) >= (F.col("x_n") + F.col("y_n")) * num).select("x", "y")


def join_components(df: DataFrame, id_col: str, text_col: str, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id): components of the links den * |A and B| >= num * |A or B|, one row per row of df."""
    prepare(df.sparkSession)
    tidy(df.sparkSession)
    sig = signatures(df, id_col, text_col, words, num, den)
    # equal sets are one node, named by a hash of its fingerprint so that any id may have several rows
    sig = written(sig.select("id", "n", "fp1", F.xxhash64("n", "fp1", "fp2").alias("node"), F.xxhash64("n", "prefix").alias("gid"), "prefix"), "signatures")
    linked = sig.where("n > 0 and id is not null")
    nodes = written(linked.groupBy("node").agg(F.min("id").alias("id"), F.first("fp1").alias("fp1"), F.first("gid").alias("gid")), "nodes")
    groups = written(linked.groupBy("gid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("node").alias("head")), "groups")
    # entries of shingles that a single group holds have no partner
    index = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = index.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    index = written(index.join(shared, "token"), "index")
    crowd = nodes.join(nodes.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select("gid"), "gid", "left_semi")
    crowd = crowd.join(groups.select("gid", "head"), "gid").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))

    # one hub per posting list and size band, and one per group
    # sizes that may link are in one band or neighbouring ones; the small sum keeps exact powers from falling short by rounding
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    banded = index.select("token", "gid", "n", "pos", band.alias("band"))
    # the hub is the entry with the fewest rarer shingles before this one: of near copies that with the fewest changes
    hub = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "n", "gid")).alias("hub"))
    fits = (F.col("hub.n") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("hub.n") * num)
    room = F.least(F.col("n") - F.col("pos"), F.col("hub.n") - F.col("hub.pos"))
    fits = fits & (room * (num + den) >= (F.col("n") + F.col("hub.n")) * num) & (F.col("gid") != F.col("hub.gid"))
    near = [banded.join(hub.withColumn("band", F.col("band") + k), ["token", "band"]).where(fits) for k in (0, 1)]
    star = near[0].union(near[1]).select(F.col("gid").alias("x"), F.col("hub.gid").alias("y")).distinct()
    star = _near(star, groups, num, den)
    member = nodes.select(F.col("gid").alias("x"), F.col("node").alias("a"))
    star = star.join(member, "x").join(groups.select(F.col("gid").alias("y"), F.col("head").alias("b")), "y").select("a", "b")
    star = written(star.union(crowd).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = written(_sets(df, id_col, text_col, nodes.join(ends, "node", "left_semi"), words), "sets")
        out = written(_verified(pairs, sets, num, den), name)
        drop_written(df.sparkSession, sets)
        return out

    tidy(df.sparkSession)
    links = verify(star, "links")
    tidy(df.sparkSession)

    # what these links leave apart: pairs of entries of one list, or members of one group, in different components
    comp = components(links, "a", "b", "nodes-linked")
    comp = written(nodes.select("node", "gid").join(comp.withColumnRenamed("id", "node"), "node", "left").select("node", "gid", F.coalesce("component_id", "node").alias("comp")), "apart")
    whole = comp.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    entry = index.join(whole, "gid")
    mixed = entry.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count("*").alias("m")).where("l < h")
    entry = entry.join(mixed.select("token", F.ceil(F.col("m") / SPLIT).cast("int").alias("parts")), "token").withColumn("band", band)
    # the smaller set goes to its own size band and the next, and to its part of the list; the larger one to its band and all parts
    x = entry.withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    y = entry.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = ["token", "band", "part"]
    x = x.select(*at, *[F.col(c).alias(f"x_{c}") for c in ("gid", "n", "pos", "low", "high")])
    y = y.select(*at, *[F.col(c).alias(f"y_{c}") for c in ("gid", "n", "pos", "low", "high")])
    apart = ~((F.col("x_low") == F.col("x_high")) & (F.col("y_low") == F.col("y_high")) & (F.col("x_low") == F.col("y_low")))
    room = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    enough = room * (num + den) >= (F.col("x_n") + F.col("y_n")) * num
    size = (F.col("x_n") * den >= F.col("y_n") * num) & (F.struct("x_n", "x_gid") < F.struct("y_n", "y_gid"))
    pairs = x.join(y, at).where(size & enough & apart).select(F.col("x_gid").alias("x"), F.col("y_gid").alias("y")).distinct()
    inner = whole.where("low < high").select(F.col("gid").alias("x"), F.col("gid").alias("y"))
    pairs = _near(pairs, groups, num, den).union(inner)
    a = comp.select(F.col("gid").alias("x"), F.col("node").alias("a"), F.col("comp").alias("x_comp"))
    b = comp.select(F.col("gid").alias("y"), F.col("node").alias("b"), F.col("comp").alias("y_comp"))
    rest = pairs.join(a, "x").join(b, "y").where("x_comp <> y_comp").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    more = verify(written(rest.join(star, ["a", "b"], "left_anti"), "rest"), "more")

    tidy(df.sparkSession)
    # components of ids: the links of nodes, each row's id to its node's first id, and rows that share an id
    first = nodes.select("node", F.col("id").alias("first"))
    ends = links.union(more).join(first.withColumnRenamed("node", "a").withColumnRenamed("first", "u"), "a").join(first.withColumnRenamed("node", "b").withColumnRenamed("first", "v"), "b").select("u", "v")
    copies = linked.select("node", "id").join(first, "node").where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    final = components(ends.union(copies), "u", "v", "ids-linked")
    return sig.select("id", "n").join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
