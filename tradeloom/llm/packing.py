"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens.  Pieces longer than half a sequence open one each.  The
others are placed by size classes, from (capacity/4, capacity/2] downwards.  A round range-sorts pieces and gaps
together by falling size and sweeps each range: a piece takes the smallest free gap of its range that holds it, its best
fit, and leaves the rest of the gap free.  What the ranges leave over, pieces first and then gaps, is matched between
ranges by rank from two counts a range.  Then gaps are updated and the next round begins.  When a round places little of a
class, empty sequences are opened for the rest; shorter classes fill what these leave free.  Before a
round a large gap is split into slots that hold one piece of the class each, so that ranges hold gaps of about their
pieces' sizes.  As soon as all pieces left and all gaps fit into one range, a last sweep places them and opens
sequences where none fits.

A null text counts as empty: one piece with the end token alone.  Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices, word_table
from .common import byte_order, prepare, tidy, written

END_ID = 0
#: Rows of a range in a sweep.
RANGE_ROWS = 40_000
#: A class goes on in rounds without opening sequences while a round places this share of what is left.
WORTH = 0.3


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the pieces of each whole text, its end token included."""
    prepare(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = byte_order(b.column(1))
            doc = b.column(0).cast(pa.int64())
            for i, j in slices(texts):
                ids, offsets = word_table(path).encode(texts[i:j])
                size = np.diff(offsets) + 1
                n = -(-size // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                raw = memoryview(np.insert(ids, offsets[1:], END_ID).astype("<u4")).cast("B")
                first = 4 * (np.cumsum(size) - size)[row] + 4 * start
                crc = [zlib.crc32(raw[a:z]) for a, z in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc[i:j].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _sweep(capacity: int, opens: bool):
    """Match a range, sorted by falling size; with ``opens``, a piece that finds no gap opens a sequence named after it.

    Rows are (part, kind, rank, key, slot, sub, size, mate): pieces (kind 1) with the gap they took or their rank among
    those left, and gaps left (kind 0) that any piece of a later range fits, ranked from the smallest.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        free: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        sizes, out, left = 0, [], 0  # sizes: bit s is set where a gap of size s is free
        size = capacity

        for b in batches:
            for size, kind, key, slot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    free[size].append((key, slot, 0))
                    sizes |= 1 << size
                    continue
                fit = sizes >> size
                if fit:
                    gap = size + (fit & -fit).bit_length() - 1
                    mate, slot, sub = free[gap].pop()
                    if not free[gap]:
                        sizes ^= 1 << gap
                elif opens:
                    gap, mate, slot, sub = capacity, key, 0, 0
                else:
                    out.append((part, 1, left, key, 0, 0, size, None))
                    left += 1
                    continue
                out.append((part, 1, None, key, slot, sub, size, mate))
                if gap > size:
                    free[gap - size].append((mate, slot, sub + 1))
                    sizes |= 1 << gap - size
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        if not opens:  # the pieces of later ranges are at most as long as the last row here
            rest = ((key, slot, sub, gap) for gap in range(size, capacity + 1) for key, slot, sub in free[gap])
            out += [(part, 0, rank, key, slot, sub, gap, None) for rank, (key, slot, sub, gap) in enumerate(rest)]
        if out:
            yield _rows(out)

    return run


_SWEPT = pa.schema([(x, pa.int64()) for x in ("part", "kind", "rank", "key", "slot", "sub", "size", "mate")])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SWEPT)


def _between_ranges(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """From (part, pieces left, gaps left): runs (run, part of pieces, first rank, part of gaps, first rank, count)."""
    stack: list[list[int]] = []
    runs = []
    for part, pieces_left, gaps_left in sorted(counts):
        done = 0
        while done < pieces_left and stack:
            top = stack[-1]
            n = min(pieces_left - done, top[2])
            runs.append((len(runs), part, done, top[0], top[1], n))
            done, top[1], top[2] = done + n, top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if gaps_left:
            stack.append([part, 0, gaps_left])
    return runs


def _round(docs: DataFrame, gaps: DataFrame, capacity: int, low: int, high: int, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """One round: (pid, length, seq, slot, sub) of the placed pieces, and (pid, length) of the others.

    With at most RANGE_ROWS rows there is one range, which opens sequences and places all pieces.
    """
    spark, last = docs.sparkSession, rows <= RANGE_ROWS
    slots = F.lit(1) if last else F.greatest(F.lit(1), F.floor(F.col("gap") / high)).cast("int")
    free = gaps.where(F.col("gap") > low).withColumn("slots", slots)
    free = free.select(F.floor(F.col("gap") / F.col("slots")).alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("key"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    both = free.union(docs.select(F.col("length").alias("size"), F.lit(1), F.col("pid"), F.lit(0)))
    order = [F.desc("size"), "kind", "key", "slot"]
    both = both.coalesce(1) if last else both.repartitionByRange(1 + 2 * rows // RANGE_ROWS, *order)
    swept = written(both.sortWithinPartitions(*order).mapInArrow(_sweep(capacity, last), ", ".join(f"{n} bigint" for n in _SWEPT.names)), "swept")
    near = swept.where("kind = 1 and mate is not null").select(F.col("key").alias("pid"), F.col("size").alias("length"), F.col("mate").alias("seq"), "slot", "sub")
    if last:
        return near, None
    loose = swept.where("rank is not null")
    counts = loose.groupBy("part").agg(F.count_if(F.col("kind") == 1), F.count_if(F.col("kind") == 0)).collect()  # two counts a range
    runs = spark.createDataFrame(_between_ranges([tuple(r) for r in counts]), "run long, doc_part long, doc_rank long, gap_part long, gap_rank long, n long")
    runs = F.broadcast(runs)  # at most two rows a range
    doc = loose.where("kind = 1").join(runs, (F.col("part") == F.col("doc_part")) & (F.col("rank") >= F.col("doc_rank")) & (F.col("rank") < F.col("doc_rank") + F.col("n")), "left")
    doc = doc.select("run", (F.col("rank") - F.col("doc_rank")).alias("at"), F.col("key").alias("pid"), F.col("size").alias("length"))
    gap = loose.where("kind = 0").join(runs, (F.col("part") == F.col("gap_part")) & (F.col("rank") >= F.col("gap_rank")) & (F.col("rank") < F.col("gap_rank") + F.col("n")))
    gap = gap.select("run", (F.col("rank") - F.col("gap_rank")).alias("at"), F.col("key").alias("seq"), "slot", "sub")
    met = doc.where("run is not null").join(gap, ["run", "at"]).select("pid", "length", "seq", "slot", "sub")
    return near.union(met), doc.where("run is null").select("pid", "length")


def best_fit(parts: DataFrame, capacity: int) -> DataFrame:
    """(pid, sequence_id, offset) for pieces (pid, length) with unique pid >= 0 and 1 <= length <= capacity."""
    spark = parts.sparkSession
    parts = parts.select("pid", "length")
    half = capacity // 2
    alone = parts.where(F.col("length") > half)
    placed = [alone.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = alone.where(F.col("length") < capacity).select(F.col("pid").alias("seq"), (capacity - F.col("length")).alias("gap"))
    classes, high = [], half
    while high > max(1, capacity // 32):
        classes.append((high // 2, high))
        high //= 2
    if high:
        classes.append((0, high))
    level = F.coalesce(*[F.when(F.col("length").between(lo + 1, hi), F.lit(i)) for i, (lo, hi) in enumerate(classes)], F.when(F.col("length") < capacity, F.lit(-1)))
    counts = {r[0]: (r[1], r[2]) for r in parts.groupBy(level).agg(F.count("*"), F.sum("length")).collect()}
    n_gaps, opened = counts.pop(-1, (0, 0))[0], 0
    counts.pop(None, None)
    for i, (low, high) in enumerate(classes):
        count, tokens = counts.get(i, (0, 0))
        rest = sum(counts.get(j, (0, 0))[0] for j in range(i, len(classes)))
        if rest + n_gaps <= RANGE_ROWS:
            count, low = rest, 0  # all classes that are left
        tidy(spark)
        docs, first, eased = parts.where(F.col("length").between(low + 1, high)), True, False
        while count:
            if count + n_gaps > RANGE_ROWS and (not first or not n_gaps):
                # at first as many as the tokens need; then as many as surely have room, which ends the class
                new = -(-count // (capacity // high)) if eased else -(-tokens // capacity)
                fresh = spark.range(-opened - new, -opened).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened, n_gaps, eased = gaps.union(fresh), opened + new, n_gaps + new, True
            put, left = _round(docs, gaps, capacity, low, high, count + n_gaps)
            before = Window.partitionBy("seq").orderBy("slot", "sub").rowsBetween(Window.unboundedPreceding, -1)
            gap = F.coalesce("gap", F.lit(capacity))
            put = put.join(gaps, "seq", "left").select("pid", "seq", "length", (capacity - gap + F.coalesce(F.sum("length").over(before), F.lit(0))).alias("offset"))
            if low == 0 and left is None:
                placed.append(put.select("pid", F.col("seq").alias("sequence_id"), "offset"))
                break
            put = written(put, "placed")
            placed.append(put.select("pid", F.col("seq").alias("sequence_id"), "offset"))
            used = put.groupBy("seq").agg(F.sum("length").alias("used"))
            gaps = written(gaps.join(used, "seq", "full").select("seq", (gap - F.coalesce(F.col("used"), F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
            if left is None:
                n_gaps = gaps.count()
                break
            docs, was = written(left, "left"), count
            count, tokens = docs.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            first = was - count > WORTH * was
        if low == 0:
            break
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p)
    return out


def pack(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int = 2048) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where every piece of every text stands."""
    cut = written(pieces(df, id_col, text_col, path, capacity).select(F.monotonically_increasing_id().alias("pid"), "*"), "pieces")
    return cut.join(best_fit(cut, capacity), "pid").drop("pid")
