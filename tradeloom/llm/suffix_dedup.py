"""Removal of long byte strings that occur twice anywhere, by suffix arrays built block by block.

A window is a string of LENGTH bytes at one place of one text.  Windows that stand at two places are found exactly, and every byte
of one goes.  No suffix array over all texts is built: equal windows have the same least gram (of GRAM bytes, by a hash), so texts are
cut into pieces, runs of windows of one least gram, and only pieces of the same gram can hold equal windows.

- Pieces are counted by a 128-bit digest.  What stands at several places whole is repeated, and one piece of it is kept.
- Different pieces of one gram are sorted together.  Blocks of such groups get a suffix array each: buckets of suffixes are sorted one
  at a time by their first bytes, and long ties are resolved by ranks of a difference cover sample, computed before, so that a
  comparison never reads far into the text and memory is bounded.  Neighbours are compared byte by byte in the end.
- A gram with more than GROUP different pieces is hot: its pieces are cut finer, by where the gram stands in a window (ranges of
  widths WIDTHS, at last every window) and by the bytes that all windows of a range share, so that a passage in a third of all texts is
  dealt over many groups, each counted and sorted like the others.

Defined results: a null or empty text has no bytes and no spans; texts below LENGTH stay; equal rows and rows of one id are places
like others; ids are not read, so null ones are fine; the table may be empty; other columns have no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, drop_written, has_bit, prepare, tidy, written

#: Bytes of a window, and of the grams of which each window has a least one.
LENGTH, GRAM = 400, 32
#: Different pieces of a gram that are sorted together, at most, and pieces of a block, about.
GROUP, BLOCK = 1024, 512
#: Ranges of the gram's place in a window for hot grams, step by step.  At a width of 1 the pieces are windows.
WIDTHS = (24, 1)
#: Suffixes of a bucket, about.
BUCKET = 1 << 16
#: A difference cover: any two residues, shifted by one of 0..PERIOD-1, both fall on COVER.
PERIOD, COVER = 7, (1, 2, 4)
#: Bytes that plain keys compare before cover ranks are asked.
SHORT = 64

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PIECE = "t1 bigint, t2 bigint, m bigint, s1 bigint, s2 bigint, c bigint, start int, n int, self boolean"
_SPAN = "t1 bigint, t2 bigint, start int, stop int"
#: Bits of the filter that says which texts may be wanted (2 MB, whatever the number of texts).
FILTER = 1 << 24


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two longs."""
    half = lambda i: F.conv(F.substring(F.md5(text.cast("binary")), i, 16), 16, -10).cast("bigint")
    return [half(1).alias("t1"), half(17).alias("t2")]


def wanted(keys: DataFrame) -> Broadcast:
    """A bit for every t1 of the keys.  Of texts without their bit none is wanted, so they needn't be shuffled; the others are joined."""
    return bit_table(keys.select(F.pmod("t1", F.lit(FILTER)).alias("slot")), FILTER)


def _may_hold(table: np.ndarray, t1: pa.Array) -> np.ndarray:
    return has_bit(table, t1.to_numpy() % FILTER)


_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PIECE = "t1 bigint, t2 bigint, m bigint, s1 bigint, s2 bigint, c bigint, start int, n int, self boolean"
_SPAN = "t1 bigint, t2 bigint, start int, stop int"
#: Bits of the filter that says which texts may be wanted (2 MB, whatever the number of texts).
FILTER = 1 << 24


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two longs."""
    half = lambda i: F.conv(F.substring(F.md5(text.cast("binary")), i, 16), 16, -10).cast("bigint")
    return [half(1).alias("t1"), half(17).alias("t2")]


def wanted(keys: DataFrame) -> Broadcast:
    """A bit for every t1 of the keys.  Of texts without their bit none is wanted, so they needn't be shuffled; the others are joined."""
    slot = f"pmod(t1, {FILTER})"
    bits = keys.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, CAST({slot} % 64 AS INT)) AS bit")
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER // 64, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table)


def _may_hold(table: np.ndarray, t1: pa.Array) -> np.ndarray:
    slot = t1.to_numpy() % FILTER
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place."""
    x = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).copy()
    n = len(raw) - GRAM + 1
    h = x[:n] * _C[0]
    for k in range(1, GRAM // 8):
        h ^= h >> np.uint64(29)
        h = (h + x[8 * k : 8 * k + n]) * _C[k % 4]
    return h ^ (h >> np.uint64(32))


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, by minima from both ends of fixed blocks."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    padded[: len(h)] = h
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _digest(data: memoryview | bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(data), "<i8").tolist())


def cut(raw: np.ndarray) -> list[tuple[int, int, int, int, int, bool]]:
    """Pieces of a text: least gram, digest, first window, windows, whether the gram stands in it more than once."""
    width, out = LENGTH - GRAM + 1, []
    h = gram_hashes(raw)
    least = sliding_minimum(h, width)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    view = raw.data
    for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(least)], strict=True):
        value = least[a]
        for s in range(a, z, width):
            e = min(z, s + width)
            self = np.count_nonzero(h[s : e + width - 1] == value) > 1
            out.append((int(value.view(np.int64)), *_digest(view[s : e - 1 + LENGTH]), s, e - s, self))
    return out


def _cut_batches(batches):
    names = ["t1", "t2", "m", "s1", "s2", "c", "start", "n", "self"]
    for b in batches:
        rows: list[list] = [[] for _ in names]

        def flush():
            kinds = [*[pa.int64()] * 6, pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=names)

        for t1, t2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            for m, s1, s2, start, n, self in cut(np.frombuffer(text.as_buffer(), np.uint8)):
                for x, v in zip(rows, (t1, t2, m, s1, s2, 1, start, n, self), strict=True):
                    x.append(v)
            if len(rows[0]) > 20_000:
                yield flush()
                rows = [[] for _ in names]
        yield flush()


def finer(piece: np.ndarray, m: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a piece by the gram's place: key of range and shared bytes, digest, first window, windows.  At a width of 1 its windows."""
    if width == 1:
        sums = [_digest(piece.data[a : a + LENGTH]) for a in range(len(piece) - LENGTH + 1)]
        return [(s[0], *s, a, 1) for a, s in enumerate(sums)]
    span = LENGTH - GRAM + 1
    at = np.flatnonzero(gram_hashes(piece).view(np.int64) == m)
    windows = np.arange(len(piece) - LENGTH + 1)
    gram = at[np.searchsorted(at, windows)]
    place = (gram - windows) // width
    begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (gram[1:] != gram[:-1])]))
    view, out = piece.data, []
    for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(windows)], strict=True):
        j, k = int(gram[a]), int(place[a])
        low, high = k * width, min((k + 1) * width, span) - 1
        shared = view[j - low : j - high + LENGTH]
        key = _digest(bytes(shared) + b"%d,%d" % (k, m))[0]
        out.append((key, *_digest(view[a : z - 1 + LENGTH]), a, z - a))
    return out


def _finer_batches(width: int):
    def run(batches):
        for b in batches:
            out = []
            for x in b.to_pylist():
                for key, s1, s2, a, n in finer(np.frombuffer(x["piece"], np.uint8), x["m"], width):
                    out.append({"t1": x["t1"], "t2": x["t2"], "m": key, "s1": s1, "s2": s2, "c": x["c"], "start": x["start"] + a, "n": n, "self": False})
            if out:
                names = {**dict.fromkeys(["t1", "t2", "m", "s1", "s2", "c"], pa.int64()), "start": pa.int32(), "n": pa.int32(), "self": pa.bool_()}
                yield pa.RecordBatch.from_pylist(out, pa.schema(list(names.items())))

    return run


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks of values, equal ones alike."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    return ranks


class CoverRanks:
    """Ranks of the suffixes at places of the cover, by their first LENGTH bytes and more: names of 8 bytes, doubled."""

    def __init__(self, heads: np.ndarray, size: int) -> None:
        self.slot = np.full(PERIOD, -1)
        self.slot[list(COVER)] = np.arange(len(COVER))
        count = size // PERIOD + 1
        places = (np.arange(count)[:, None] * PERIOD + np.array(COVER)).ravel()
        self.ranks, step, known = _names(heads[np.minimum(places, len(heads) - 1)]), 1, 8
        while known < LENGTH + PERIOD:
            ahead = np.zeros_like(self.ranks)
            ahead[: -step * len(COVER)] = self.ranks[step * len(COVER) :] + 1
            self.ranks = _names(self.ranks * (len(self.ranks) + 2) + ahead)
            known += step * PERIOD
            step *= 2
        self.shift = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])

    def of(self, places: np.ndarray) -> np.ndarray:
        return self.ranks[places // PERIOD * len(COVER) + self.slot[places % PERIOD]]

    def order(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes within groups of at least PERIOD equal first bytes: how many of each residue come before, by ranks at the shift that both share."""
        before, kind, wide = np.zeros(len(places), np.int64), places % PERIOD, len(self.ranks) + 1
        members = [np.flatnonzero(kind == k) for k in range(PERIOD)]
        for b in range(PERIOD):
            for shift in set(self.shift[:, b].tolist()):
                theirs = np.sort(group[members[b]] * wide + self.of(places[members[b]] + shift))
                for a in np.flatnonzero(self.shift[:, b] == shift):
                    mine = members[a]
                    if len(mine) and len(theirs):
                        key = group[mine] * wide
                        before[mine] += np.searchsorted(theirs, key + self.of(places[mine] + shift)) - np.searchsorted(theirs, key)
        return np.lexsort((before, group))


def _ties(places: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by group and key; those left whose group and key another shares, with new groups."""
    order = np.lexsort((key, group))
    places, group, key = places[order], group[order], key[order]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]) if len(places) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    kept = np.bincount(group, minlength=1)[group] > 1 if len(places) else fresh
    return places[kept], group[kept]


def repeated(raw: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Those of the windows (places in raw) whose bytes stand at another of the windows, by suffix arrays of one bucket after the other."""
    padded = np.zeros(len(raw) + 2 * LENGTH, np.uint8)
    padded[: len(raw)] = raw
    heads = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,)).astype(np.uint64)
    cover = CoverRanks(heads, len(raw) + LENGTH)
    first = heads[windows]
    some = np.sort(first[:: max(1, len(first) // 4096)])
    limits = np.unique(some[:: max(1, len(some) * BUCKET // max(1, len(first)))])
    bucket = np.searchsorted(limits, first, side="right")
    found = []
    for k in range(len(limits) + 1):
        places = windows[bucket == k]
        group = np.zeros(len(places), np.int64)
        for d in range(0, SHORT, 8):
            places, group = _ties(places, group, heads[places + d])
        if not len(places):
            continue
        order = cover.order(places, group)
        places, group = places[order], group[order]
        near = np.flatnonzero(group[1:] == group[:-1])
        for d in [*range(SHORT, LENGTH - 7, 8), LENGTH - 8]:
            near = near[heads[places[near] + d] == heads[places[near + 1] + d]]
        found += [places[near], places[near + 1]]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _sort_block(rows: pa.Table) -> pa.Table:
    """Spans of the repeated windows of a block's pieces that stand at one place."""
    pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("piece")]
    sizes = np.array([len(x) for x in pieces])
    begin = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    windows = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hits = repeated(np.concatenate(pieces), windows)
    of = np.searchsorted(begin, hits, side="right") - 1
    alone = rows.column("c").to_numpy()[of] == 1
    hits, of = hits[alone], of[alone]
    fresh = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(of) != 0)]) if len(hits) else np.zeros(0, bool)
    ends = np.concatenate([fresh[1:], [True]]) if len(hits) else fresh
    base = rows.column("start").to_numpy()[of] - begin[of]
    kinds = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    texts = {k: rows.column(k).to_numpy()[of[fresh]] for k in ("t1", "t2")}
    return pa.table({**texts, "start": (hits + base)[fresh].astype(np.int32), "stop": ((hits + base)[ends] + LENGTH).astype(np.int32)}, schema=kinds)


def _with_bytes(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """pieces (t1, t2, m, c, d, start, n) with their bytes; texts (t1, t2, text): each text of which one is wanted goes over the network once."""
    maybe = wanted(pieces)
    lists = pieces.groupBy("t1", "t2").agg(F.collect_list(F.struct("m", "c", "d", "start", "n")).alias("list"))

    def some(batches):
        for b in batches:
            yield b.filter(pa.array(_may_hold(maybe.value, b.column("t1"))))

    def slices(batches):
        for b in batches:
            kept = b.column("list")
            of = pc.list_parent_indices(kept).to_numpy()
            flat = pa.RecordBatch.from_struct_array(kept.flatten())
            raw = [memoryview(x.as_buffer()) for x in b.column("text")]
            starts, n = flat.column("start").to_numpy(), flat.column("n").to_numpy()
            data = [raw[i][s : s + k - 1 + LENGTH].tobytes() for i, s, k in zip(of.tolist(), starts.tolist(), n.tolist(), strict=True)]
            keys = [b.column(k).take(pa.array(of)) for k in ("t1", "t2")]
            yield pa.RecordBatch.from_arrays([*keys, *[flat.column(c) for c in ("m", "c", "d", "start")], pa.array(data, pa.binary())], names=["t1", "t2", "m", "c", "d", "start", "piece"])

    once = texts.mapInArrow(some, "t1 bigint, t2 bigint, text binary").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    return once.join(lists, ["t1", "t2"]).mapInArrow(slices, "t1 bigint, t2 bigint, m bigint, c bigint, d bigint, start int, piece binary")


def repeated_spans(df: DataFrame, text_col: str) -> DataFrame:
    """(t1, t2, spans): for each text with windows that stand elsewhere too, by its key, the places of those windows (unsorted, overlapping)."""
    spark = df.sparkSession
    texts = df.where(F.octet_length(text_col) >= LENGTH).select(*text_key(F.col(text_col)), F.col(text_col).cast("binary").alias("text"))
    pieces, spans = written(texts.mapInArrow(_cut_batches, _PIECE), "pieces"), None
    for width in (*WIDTHS, None):
        # what stands at several places whole, and one piece of each kind (any: they are equal); a kind's gram follows from its bytes
        one = [F.first(x).alias(x) for x in ("m", "t1", "t2", "start", "n")]
        kinds = written(pieces.groupBy("s1", "s2").agg(F.sum("c").alias("c"), F.bool_or("self").alias("self"), *one), "kinds")
        groups = kinds.groupBy("m").agg(F.count("*").alias("d"), F.max("self").alias("any")).where("d > 1 or any").select("m", "d")
        groups = written(groups, "grams")
        tidy(spark)
        twice = pieces.join(kinds.where("c > 1").select("s1", "s2"), ["s1", "s2"])
        found = [twice.select("t1", "t2", "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("stop")).distinct()]
        if width is None:
            # single windows: all of a kind are equal, and nothing is left to sort
            spans = spans.union(found[0])
            break
        spans = found[0] if spans is None else spans.union(found[0])
        spans = written(spans, "spans")
        tidy(spark)
        known = written(_with_bytes(kinds.join(groups, "m"), texts), "sorted")
        tidy(spark)
        cool = known.where(F.col("d") <= GROUP)
        blocks = F.pmod(F.xxhash64("m"), F.lit(cool.count() // BLOCK + 1))
        sorted_ = cool.withColumn("block", blocks).groupBy("block").applyInArrow(_sort_block, _SPAN)
        spans = spans.union(written(sorted_, "spans"))
        hot = known.where(F.col("d") > GROUP)
        if not groups.where(F.col("d") > GROUP).limit(1).count():
            break
        drop_written(spark, pieces, kinds, groups)
        pieces = written(hot.mapInArrow(_finer_batches(width), _PIECE), "pieces")
        tidy(spark)
    return spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``keep`` also kept (binary) and removed: (start, stop) of each run."""
    prepare(df.sparkSession)
    spans = written(repeated_spans(df, text_col), "repeats")
    tidy(df.sparkSession)
    maybe = wanted(spans)
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    docs = df.select(F.col(id_col).alias("id"), raw.alias("text")).select("id", "text", *text_key(F.col("text")))
    kind = dict(df.dtypes)[id_col]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][: 6 if keep else 4]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    result = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary, removed array<struct<start:bigint,stop:bigint>>" * keep

    def without(raw: memoryview, spans: list[dict]) -> tuple:
        kept, gone, at = [], [], 0
        for s, e in sorted((y["start"], y["stop"]) for y in spans):
            if gone and s <= gone[-1][1]:
                gone[-1][1] = max(e, gone[-1][1])
            else:
                gone.append([s, e])
        for s, e in gone:
            kept.append(raw[at:s])
            at = e
        kept.append(raw[at:])
        sha = hashlib.sha256()
        for part in kept:
            sha.update(part)
        row = (len(raw), sum(e - s for s, e in gone), len(gone), sha.hexdigest())
        return (*row, b"".join(kept), [{"start": s, "stop": e} for s, e in gone]) if keep else row

    def columns(rows: list[tuple | None]) -> list[pa.Array]:
        return [pa.array([r and r[k] for r in rows], kind) for k, kind in zip(range(len(names)), kinds, strict=False)]

    def easy(batches):
        # texts of which nothing goes are done here; the others take their text to the join
        for b in batches:
            hard = _may_hold(maybe.value, b.column("t1"))
            rows = [None if h else without(memoryview(x.as_buffer()), []) for h, x in zip(hard.tolist(), b.column("text"), strict=True)]
            text = pc.if_else(pa.array(hard), b.column("text"), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t1"), b.column("t2"), text, *columns(rows)], names=["id", "t1", "t2", "text", *names])

    def rest(batches):
        for b in batches:
            rows = [without(memoryview(x.as_buffer()), y.as_py() or []) for x, y in zip(b.column("text"), b.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns(rows)], names=["id", *names])

    done = written(docs.mapInArrow(easy, f"id {kind}, t1 bigint, t2 bigint, text binary, {result}"), "texts")
    hard = done.where(F.col("text").isNotNull()).select("id", "text", "t1", "t2").join(spans, ["t1", "t2"], "left").select("id", "text", "spans")
    out = done.where(F.col("text").isNull()).select("id", *names).union(hard.mapInArrow(rest, f"id {kind}, {result}"))
    return out.withColumnRenamed("id", id_col)
