"""Language-model scoring by online logistic context mixing.

A text is its words and one end.  Every frequent word has a binary code: the bits of its class (the language in which it is
common, say), then a Huffman code within the class; rarer and unknown words share one code, the escape, after which their letters
are coded.  Every bit is mixed.  For each bit several predictors look up how often 0 and 1 followed their hashed context, across word borders, in the
training texts: the code's bits so far with the class of the text here, alone and with that of the word before, and with one or
two words before.  The predictors' log-odds are mixed with weights that a gate chooses (the bit's place in the code and how many of the
longer contexts were seen); an adaptive map from the bit's place and the mixed probability refines the result.  All bits
together give the text's log-probability and its bits per byte.

Learning is online: each task reads its training texts in order, predicts a block's bits from what it has read before, moves
weights and map by the errors, then counts the bits, every occurrence.  Counts and the map's counts of all tasks are added up, weights
are averaged by the bits that taught them.  While scoring, weights go on adapting in order within each text, from the
learnt ones at its start, so a text's score depends on no other scored row.

A second mixer of the same kind spells escaped words by their bytes, learnt from the distinct rare words of training.  An escaped
word that training has keeps its discounted frequency beside its spelling.  Words that occur once in training are escaped
too, so the escape's frequency is that of unknown words (Good and Turing).  The probabilities of all continuations sum to one.

Hashed tables have a slot for each of two training tokens up to ``MOST_SLOTS``, the method's memory bound; beyond it
contexts share slots and the weights learn to trust them less.  Word counts grow with the corpus and are joined, never
broadcast: only the at most ``HEAD`` most frequent words are.

A null text counts as empty: one end.  Rows keep their own result, whether or not their ids repeat or are null.  An empty
table has an empty result; without training rows every bit and byte is as likely as another.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import byte_order, distinct_words, prepare, ragged, written

#: Most frequent words at most, broadcast with their codes (some 20 MB).
HEAD = 100_000
#: The last LONG predictors have the longer contexts, which the gate counts.
LONG = 2
#: Fewest and most slots of a predictor's table.
SLOTS, MOST_SLOTS = 1 << 16, 1 << 21
#: Training tokens that a learning task reads, unless the cluster has fewer cores than that takes.
TASK_TOKENS = 2_000_000
#: Most classes of training rows; rarer ones share the last.
MOST_CLASSES = 8
#: A word belongs to a class with this share of its (relative) frequency.
OWN_CLASS = 0.7
#: Symbols of a text after which its weights adapt; bytes of texts that are split at once, if no single text is longer.
BLOCK, BATCH = 256, 1_000_000
#: Symbols that a task codes at once, if no single text is longer; and after which a learning task's weights move and its counts grow.
RUN, READ = 25_000, 5_000
#: What a count has before anything is seen.
LEAST = np.float32(0.2)
#: The adaptive map: contexts, and steps of log-odds from -12 to 12.
CELLS, STEPS = 1024, 33
#: Levels of a count's log-odds as kept for scoring, a unit's share; -128 is a slot that saw nothing.
UNIT = 12.0
_P, _Q = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
GATES = 8 * (LONG + 1)


@dataclass(frozen=True)
class Code:
    """Symbol s has the bits first[s] to first[s + 1].  Four bits in a row share a node, that of the first (hashed); their
    slots stand together, told apart by the bits between."""

    first: np.ndarray
    node: np.ndarray
    mark: np.ndarray  # twice the gate's place, and the bit
    local: np.ndarray  # 1 to 15
    rest: np.ndarray  # log10 of a symbol's share among those of the same bits


def huffman(weight: np.ndarray, group: np.ndarray, most: int = 64) -> Code:
    """A Huffman code of the groups, then one of the symbols within each, cut after ``most`` bits; a lone symbol has no bits."""
    size = len(weight)
    parent, side = np.zeros(max(1, 2 * size - 1), np.int64), np.zeros(max(1, 2 * size - 1), np.int8)
    new = size

    def merge(items: list[tuple[float, int]]) -> tuple[float, int]:
        nonlocal new
        heapq.heapify(items)
        while len(items) > 1:
            (w, a), (v, b) = heapq.heappop(items), heapq.heappop(items)
            parent[[a, b]], side[[a, b]] = new, (0, 1)
            heapq.heappush(items, (w + v, new))
            new += 1
        return items[0]

    by: dict[int, list[tuple[float, int]]] = {}
    for s, (w, g) in enumerate(zip(weight.tolist(), group.tolist(), strict=True)):
        by.setdefault(g, []).append((w, s))
    root = merge([merge(x) for _, x in sorted(by.items())])[1]
    at, own, nodes, bits = np.arange(size), np.arange(size), [], []
    while True:
        own = own[at != root]
        at = at[at != root]
        if not len(at):
            break
        nodes.append((own, parent[at] - size))
        bits.append(side[at])
        at = parent[at]
    if not nodes:
        return Code(np.zeros(size + 1, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int8), np.zeros(0, np.uint32), np.zeros(size))
    symbol, node = (np.concatenate([x[k] for x in nodes]) for k in (0, 1))
    up = np.concatenate([np.full(len(x[0]), -k) for k, x in enumerate(nodes)])
    order = np.lexsort((up, symbol))
    symbol, node, bit = symbol[order], node[order], np.concatenate(bits)[order]
    first = np.searchsorted(symbol, np.arange(size + 1))
    place = np.arange(len(symbol)) - first[symbol]
    # symbols of the same first bits: the node above their next bit, or the symbol itself
    longer = np.diff(first) > most
    same = np.where(longer, node[np.minimum(first[:-1] + most, len(node) - 1)], -1 - np.arange(size))
    _, at = np.unique(same, return_inverse=True)
    rest = np.log10(weight / np.bincount(at, weight)[at])
    short = place < most
    symbol, node, bit, place = symbol[short], node[short], bit[short], place[short]
    first = np.searchsorted(symbol, np.arange(size + 1))
    local = np.ones(len(symbol), np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(place % 4 == k)
        local[at] = 2 * local[at - 1] + bit[at - 1]
    node = _mixed(node[np.arange(len(symbol)) - place % 4].astype(np.uint32) + np.uint32(1))
    return Code(first.astype(np.int32), node, (2 * np.minimum(place, 7) + bit).astype(np.int8), local, rest)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _P
    x ^= x >> np.uint32(15)
    x = x * _Q
    return x ^ (x >> np.uint32(13))


@dataclass
class Events:
    """The bits of a run of symbols, in the order of blocks: bit, text, gate's place, map's context, and slots by predictor."""

    bit: np.ndarray
    text: np.ndarray
    place: np.ndarray
    cell: np.ndarray
    slot: list[np.ndarray]
    blocks: np.ndarray  # where the bits of each block of all texts end


def events(code: Code, symbols: np.ndarray, contexts: list[np.ndarray], text: np.ndarray, at: np.ndarray, slots: int) -> Events:
    """symbols with their contexts' hashes, text number and place in the text."""
    block = at // BLOCK
    if len(block) and block.max():
        order = np.argsort(block, kind="stable")
        symbols, text, block = symbols[order], text[order], block[order]
        contexts = [c[order] for c in contexts]
    first = code.first.take(symbols)
    n = code.first[1:].take(symbols) - first
    ends = np.cumsum(n)
    flat = np.arange(ends[-1] if len(ends) else 0)
    flat += np.repeat(first - (ends - n), n)
    node, mark, local = code.node.take(flat), code.mark.take(flat), code.local.take(flat)
    shift = np.uint32(36 - (slots - 1).bit_length())
    slot = []
    for c in contexts:
        x = np.repeat(c, n)
        x ^= node
        x *= _P
        x >>= shift
        x <<= np.uint32(4)
        x |= local
        slot.append(x.astype(np.int64))
    blocks = ends[np.flatnonzero(np.diff(block, append=-1))] if len(block) else np.zeros(0, np.int64)
    return Events(mark & np.int8(1), np.repeat(text, n), mark >> np.int8(1), (((node << np.uint32(4)) | local) & np.uint32(CELLS - 1)).astype(np.int32), slot, blocks)


def _cells(cell: np.ndarray, x: np.ndarray) -> np.ndarray:
    return cell * np.int32(STEPS) + np.rint((x + np.float32(12)) * np.float32((STEPS - 1) / 24)).astype(np.int32)


@dataclass
class Learner:
    """What one task has read: counts of 0 and 1 by predictor and slot, weights (predictors x gates), the map's counts."""

    counts: np.ndarray
    weights: np.ndarray
    taught: np.ndarray
    cells: np.ndarray
    rate: float = 0.3

    @staticmethod
    def new(predictors: int, slots: int) -> Learner:
        return Learner(np.zeros((predictors, 2 * slots), np.uint32), _weights(predictors), np.zeros(GATES), np.zeros(2 * CELLS * STEPS, np.uint32))

    def read(self, e: Events) -> None:
        """One run: predict its bits, move the weights by the errors, then count."""
        odds, seen = [], np.zeros(len(e.bit), np.int8)
        pairs = self.counts.view(np.uint64)  # of a slot's counts, that of 0 in the lower half
        for k, s in enumerate(e.slot):
            both = pairs[k].take(s)
            if k >= len(e.slot) - LONG:
                seen += both > 0
            n = both.view(np.uint32).astype(np.float32)
            n += LEAST
            o = n[1::2] / n[::2]
            odds.append(np.log(o, out=o))
        gate = e.place * np.int64(LONG + 1) + seen
        x = _dot(self.weights, gate, odds)
        error = e.bit - 1 / (1 + np.exp(-x))
        n = np.bincount(gate, minlength=GATES)
        for k, o in enumerate(odds):
            self.weights[k] += self.rate * np.bincount(gate, error * o, GATES) / np.maximum(n, 50)
        self.taught += n
        np.add.at(self.cells, 2 * _cells(e.cell, x) + e.bit, np.uint32(1))
        one = np.left_shift(np.uint64(1), e.bit.astype(np.uint64) << np.uint64(5))
        for k, s in enumerate(e.slot):
            np.add.at(pairs[k], s, one)


def _weights(predictors: int) -> np.ndarray:
    return np.full((predictors, GATES), 1.6 / predictors, np.float32)


def _dot(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    x = np.zeros(len(gate), np.float32)
    for w, o in zip(weights, odds, strict=True):
        x += w.take(gate) * o
    return np.clip(x, -12, 12, out=x)


@dataclass
class Mixer:
    """The learnt model as it is broadcast: each slot's log-odds in 1/UNIT, weights, and the map's probability of a 1."""

    code: Code
    table: np.ndarray  # predictors x slots
    weights: np.ndarray
    refine: np.ndarray
    rate: float = 0.1

    def log10(self, e: Events, texts: int) -> np.ndarray:
        """log10 of the probability of each text's bits; its weights adapt after every block."""
        odds, seen = [], np.zeros(len(e.bit), np.int8)
        for k, s in enumerate(e.slot):
            v = self.table[k].take(s)
            some = v != -128
            if k >= len(e.slot) - LONG:
                seen += some
            v *= some
            odds.append(v * np.float32(1 / UNIT))
        own = e.text * np.int64(GATES) + e.place * np.int64(LONG + 1) + seen
        weights, total, begin = np.tile(self.weights, texts), np.zeros(texts), 0
        for k, end in enumerate(e.blocks.tolist()):
            at = slice(begin, end)
            o, bit = [x[at] for x in odds], e.bit[at]
            x = _dot(weights, own[at], o)
            p = 1 / (1 + np.exp(-x))
            if k < len(e.blocks) - 1:  # of the texts that go on
                error, n = bit - p, np.bincount(own[at], minlength=texts * GATES)
                for w, v in zip(weights, o, strict=True):
                    w += self.rate * np.bincount(own[at], error * v, texts * GATES) / np.maximum(n, 50)
            p = (p + self.refine.take(_cells(e.cell[at], x))) / 2
            p = np.abs(p - (1 - bit)).clip(np.float32(1e-6), np.float32(1 - 1e-6))
            total += np.bincount(e.text[at], np.log(p), texts)
            begin = end
        return total / np.log(10)


def word_contexts(words: np.ndarray, classes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Each predictor's context at every word: words' numbers, classes of numbers (-1: of none), whether a text begins."""
    n = len(words)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(begins, at, 0)) if n else at
    before = lambda k: np.where(at - k >= start, np.concatenate([np.zeros(min(k, n), np.int64), words[: max(0, n - k)] + 1]), 0)
    one, two = before(1), before(2)
    kind = np.concatenate([[-2], classes])  # by number + 1; 0: the text begins here
    last = np.where(kind[one] >= 0, at, -1)
    last = np.maximum.accumulate(last) if n else last
    recent = np.where(last >= start, kind[one[np.maximum(last, 0)]], -1) + 2
    mix = lambda k, *x: _mixed(sum((np.asarray(v).astype(np.uint32) * np.uint32(c) for v, c in zip(x, (0x27D4EB2F, 0x165667B1, 0xC2B2AE3D), strict=False)), np.uint32(k + 1)))
    return [mix(1, recent), mix(2, recent, kind[one] + 2), mix(3, one), mix(4, one, two)]


def byte_contexts(s: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Each predictor's context at every byte of words: none to four bytes before, with the place; all bytes before."""
    n = len(s)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(begins, at, 0)) if n else at
    place = at - start
    h, out = np.minimum(place, 3).astype(np.uint32), []
    for k in range(5):
        out.append(_mixed(h + np.uint32(11 * k + 7)))
        back = np.concatenate([np.zeros(min(k + 1, n), np.uint32), s[: max(0, n - k - 1)].astype(np.uint32) + np.uint32(1)])
        h = h * np.uint32(0x27D4EB2F) + np.where(place > k, back, 0).astype(np.uint32)
    power = np.concatenate([[np.uint32(1)], np.full(n, _P)]).cumprod(dtype=np.uint32)
    back = np.concatenate([[np.uint32(1)], np.full(n, np.uint32(pow(int(_P), -1, 2**32)))]).cumprod(dtype=np.uint32)
    total = np.concatenate([[np.uint32(0)], np.cumsum((s.astype(np.uint32) + np.uint32(1)) * power[:-1], dtype=np.uint32)])
    out.append(_mixed((total[:-1] - total[start]) * back[start] + np.uint32(99)))
    return out


def spelling(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, an end (0) after each; whose they are; and their places."""
    raw = [w.encode() for w in words.to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    s = np.frombuffer(b"".join(w.replace(b"\0", b"\xff") + b"\0" for w in raw), np.uint8)  # no word has the byte 255
    text = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    return s, text, np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)


def _runs(sizes: np.ndarray, most: int = RUN):
    """Runs [first, end) of rows of about ``most`` in all, one row at least."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-cased words; the number at each position, without what stands for white space at the ends; offsets."""
    words, at, offsets = distinct_words(pc.ascii_lower(texts))
    blank = np.fromiter(map(len, words), np.int64, len(words)) == 0
    if blank.any():
        keep = ~blank[at]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        at = at[keep]
    return words, at, offsets


def count_words(df: DataFrame, text_col: str, kind: Column, kinds: int) -> DataFrame:
    """(word, c0, ..., n): occurrences in training rows by class, and in all rows; the end is the empty word.

    kind: a training row's class from 0 to kinds - 1, null for other rows.
    """
    names = ["word", *(f"c{k}" for k in range(kinds)), "n"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out():
            sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([(c, "sum") for c in names[1:]])
            held.clear()
            return sums.select(["word", *(f"{c}_sum" for c in names[1:])]).rename_columns(names)

        for b in batches:
            texts, of = byte_order(b.column(0)), pc.fill_null(b.column(1), -1).to_numpy(zero_copy_only=False)
            for i, j in slices(texts):
                words, at, offsets = _words(texts[i:j])
                row = np.repeat(of[i:j], np.diff(offsets))
                # all occurrences, then those of each class; the last column is for the ends
                n = np.bincount((row + 1) * len(words) + at, minlength=(kinds + 1) * len(words)).reshape(kinds + 1, -1)
                ends = np.bincount(of[i:j] + 1, minlength=kinds + 1)
                n = np.concatenate([n, ends[:, None]], axis=1)
                held.append(pa.RecordBatch.from_arrays([pa.array([*words, ""], pa.string()), *(pa.array(c) for c in n[1:]), pa.array(n.sum(axis=0))], names=names))
                if sum(h.num_rows for h in held) > 400_000:
                    total = out()
                    held += total.to_batches()
                    if total.num_rows > 200_000:
                        yield from held
                        held.clear()
        if held:
            yield from out().to_batches()

    found = df.select(text_col, kind.cast("int").alias("kind")).mapInArrow(run, "word string, " + ", ".join(f"{c} bigint" for c in names[1:]))
    return found.groupBy("word").agg(*(F.sum(c).alias(c) for c in names[1:])).where("n > 0")


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds as kept for scoring, from counts of 0 and 1 in the last dimension."""
    odds = np.rint(np.log((counts[..., 1] + LEAST) / (counts[..., 0] + LEAST)) * UNIT).clip(-127, 127)
    return np.where(counts.any(axis=-1), odds, -128).astype(np.int8)


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes: a slot that doesn't fit keeps its odds, and a count that is not 0 stays so."""
    down = np.rint(counts * np.minimum(1, 65535 / counts.max(axis=2, keepdims=True).clip(1)))
    return np.where(counts > 0, np.maximum(1, down), 0).astype(np.uint16)


def fit(rows: DataFrame, code: Code, bits_of, predictors: int, slots: int, tasks: int) -> Mixer:
    """Learns in Spark tasks from all rows: bits_of(batch) yields Events; what tasks learnt is added up and averaged."""
    parts, wide = 64, slots // 64

    def read(batches):
        task = Learner.new(predictors, slots)
        for b in batches:
            for e in bits_of(b):
                task.read(e)
        for k in range(parts):
            part = _scaled(task.counts[:, 2 * k * wide : 2 * (k + 1) * wide].reshape(predictors, wide, 2))
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], names=["chunk", "n"])
        learnt = np.concatenate([task.taught, (task.weights * task.taught).ravel(), task.cells.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([learnt.tobytes()], pa.binary())], names=["chunk", "n"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:  # a row of each task
        chunk = key[0].as_py()
        total = sum(np.frombuffer(x.as_buffer(), np.float64 if chunk < 0 else np.uint16).astype(np.float64) for x in rows.column("n"))
        if chunk >= 0:
            total = _odds(total.reshape(predictors, wide, 2))
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "n": pa.array([total.tobytes()], pa.binary())})

    steps = 1 / (1 + np.exp(-np.linspace(-12, 12, STEPS)))
    mixer = Mixer(code, np.full((predictors, slots), -128, np.int8), _weights(predictors), np.tile(steps, CELLS))
    found = rows.coalesce(tasks).mapInArrow(read, "chunk bigint, n binary").groupBy("chunk").applyInArrow(add, "chunk bigint, n binary")
    for chunk, n in found.toLocalIterator():  # predictors x slots bytes in all
        if chunk >= 0:
            mixer.table[:, chunk * wide : (chunk + 1) * wide] = np.frombuffer(bytes(n), np.int8).reshape(predictors, wide)
            continue
        taught, weights, cells = np.split(np.frombuffer(bytes(n)), [GATES, GATES * (predictors + 1)])
        at = np.flatnonzero(taught)
        mixer.weights[:, at] = weights.reshape(predictors, GATES)[:, at] / taught[at]
        cells = cells.reshape(-1, 2)
        mixer.refine = (cells[:, 1] + 40 * mixer.refine) / (cells.sum(axis=1) + 40)
    mixer.refine = mixer.refine.astype(np.float32)
    return mixer


def _slots(n: int) -> int:
    return min(MOST_SLOTS, max(SLOTS, 1 << (2 * n).bit_length()))


def _speller(rare: DataFrame, types: int) -> Broadcast:
    """Spells the words of ``rare``: column word."""

    def histogram(batches):
        n = np.zeros(256, np.int64)
        for b in batches:
            n += np.bincount(spelling(b.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], names=["byte", "n"])

    rare = rare.select("word")
    n = np.zeros(256)
    for byte, count in rare.mapInArrow(histogram, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n")).collect():
        n[byte] = count
    code, slots = huffman(n + 0.5, np.zeros(256, np.int64)), _slots(8 * types)

    def bits_of(b: pa.RecordBatch):
        for i, j in _runs(np.full(b.num_rows, 10), READ):
            s, text, at = spelling(b.column(0)[i:j])
            yield events(code, s.astype(np.int64), byte_contexts(s, at == 0), text, at, slots)

    spark = rare.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-types // (TASK_TOKENS // 8))))
    return spark.sparkContext.broadcast(fit(rare, code, bits_of, 6, slots, tasks))


def _spelt(mixer: Mixer, words: pa.Array) -> np.ndarray:
    out = np.zeros(len(words))
    for i, j in _runs(np.full(len(words), 10)):
        s, text, at = spelling(words[i:j])
        out[i:j] = mixer.log10(events(mixer.code, s.astype(np.int64), byte_contexts(s, at == 0), text, at, mixer.table.shape[1]), j - i)
    return out


@dataclass
class Head:
    """Frequent words by number, 0 the end and 1 the escape, and what the scan needs of them."""

    numbers: dict[str, int]
    classes: np.ndarray
    code: Code
    base: np.ndarray

    def read(self, texts: pa.Array):
        """The texts' words as numbers, an end after each; whose they are; places; and the distinct words and their place each."""
        words, at, offsets = _words(texts)
        number = np.fromiter(map(self.numbers.get, words, repeat(1)), np.int64, len(words))
        size = np.diff(offsets) + 1
        text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros(len(text), np.int64)
        inner = np.ones(len(text), bool)
        inner[np.cumsum(size) - 1] = False
        out[inner] = number[at] if len(at) else 0
        return out, text, place, words, at, text[inner]


def score(df: DataFrame, id_col: str, text_col: str, class_col: str, training: Column) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): log10 probabilities of each whole text.

    base_score adds one to the counts of a plain unigram model.  bits_per_byte is over the bytes of words and one after
    each.  A null class is one of the rarer classes.
    """
    prepare(df.sparkSession)
    spark = df.sparkSession
    train = F.coalesce(training, F.lit(False))
    common = df.where(train & F.col(class_col).isNotNull()).groupBy(F.col(class_col).cast("string")).count().orderBy(F.desc("count"), F.col(class_col).cast("string")).limit(MOST_CLASSES).collect()
    named = {r[0]: k for k, r in enumerate(common)}
    kinds = len(named) + 1
    kind = F.when(train, F.coalesce(*(F.when(F.col(class_col).cast("string") == name, F.lit(k)) for name, k in named.items()), F.lit(kinds - 1)))
    vocab = written(count_words(df, text_col, kind, kinds), "vocabulary")
    vocab = vocab.withColumn("c", sum((F.col(f"c{k}") for k in range(kinds)), F.lit(0)))
    # frequent words by classes of frequency, as many classes as fit the head; words that occur once are never among them
    rank = F.floor(F.log2("c") * 16)
    by = sorted(vocab.groupBy(F.when(F.col("c") > 0, rank).alias("rank")).agg(F.count("*"), F.sum("c"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect(), key=lambda r: -1 if r[0] is None else r[0])
    known = [r for r in by if r[0] is not None]
    total, distinct = sum(r[2] for r in known), sum(r[1] for r in known)
    least, room = 10**6, HEAD
    for r in reversed(known):
        if r[0] < 16 or r[1] > room:
            break
        least, room = r[0], room - r[1]
    often = (F.col("word") == "") | (F.coalesce(rank, F.lit(-1)) >= least)
    top = vocab.where(often & (F.col("c") > 0)).toPandas()
    top = top[top.word != ""].reset_index(drop=True)
    tail = vocab.where(~often)
    tokens, types = (sum(r[k] for r in known if r[0] < least) for k in (2, 1))
    once, twice = (sum(r[k] for r in known) for k in (3, 4))
    ends = vocab.where("word = ''").agg(F.sum("c")).first()[0] or 0
    if known and ends and any(r[0] < least and r[0] == int(np.floor(np.log2(ends) * 16)) for r in known):  # the end is no rare word
        tokens, types = tokens - ends, types - 1
    discount = once / (once + 2 * twice) if once and twice else 0.5
    spare = discount * types / tokens if tokens else 1.0  # escaped words that training lacks
    # classes of words: where their relative frequency lies
    each = top[[f"c{k}" for k in range(kinds)]].to_numpy(float) if len(top) else np.zeros((0, kinds))
    share = each / np.maximum(1, each.sum(axis=0))
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    own = np.where(share.max(axis=1, initial=0) >= OWN_CLASS, share.argmax(axis=1), -1) if len(top) else np.zeros(0, np.int64)
    classes = np.concatenate([[-1, -1], own]).astype(np.int64)
    weight = np.concatenate([[ends + 0.5, tokens + 0.5], top.c.to_numpy(float)])
    code = huffman(weight, np.concatenate([[kinds + 1, kinds + 2], np.where(own < 0, kinds, own)]).astype(np.int64))
    base = np.log10((np.concatenate([[ends, 0], top.c.to_numpy(float)]) + 1) / (total + distinct + 1))
    shared = spark.sparkContext.broadcast(Head({w: k + 2 for k, w in enumerate(top.word)}, classes, code, base))
    slots = _slots(total)

    def bits_of(b: pa.RecordBatch):
        texts, head = byte_order(b.column(0)), shared.value
        for i, j in slices(texts, BATCH):
            words, text, at, *_ = head.read(texts[i:j])
            contexts = word_contexts(words, head.classes, at == 0)
            for a in range(0, len(words), READ):
                run = slice(a, a + READ)
                yield events(head.code, words[run], [c[run] for c in contexts], text[run], at[run], slots)

    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS)))
    light = Code(*[np.zeros(0)] * 5)  # tasks have it in the head
    mixer = spark.sparkContext.broadcast(fit(df.where(train).select(text_col), light, bits_of, 4, slots, tasks))
    speller = _speller(tail.where("c > 0"), types)

    def rate(batches):
        for b in batches:
            words, c = byte_order(b.column(0)), b.column(1).to_numpy().astype(float)
            spelt = 10.0 ** _spelt(speller.value, words).clip(-300)
            p = np.log10(np.maximum(np.maximum(c - discount, 0) / max(1, tokens) + spare * spelt, 1e-300))
            yield pa.RecordBatch.from_arrays([words, b.column(1), pa.array(p)], names=["word", "c", "p"])

    lexicon = tail.where("word <> ''").select("word", "c").mapInArrow(rate, "word string, c bigint, p double")
    parts = ["rid", "id", "word", "n", "known", "base", "whole", "bytes"]

    def look(batches):
        head, model = shared.value, mixer.value
        model.code = head.code
        for b in batches:
            texts = byte_order(b.column(2))
            for i, j in slices(texts, BATCH):
                words, text, at, distinct, where, doc = head.read(texts[i:j])
                contexts, whole, ends_at = word_contexts(words, head.classes, at == 0), np.bincount(text, head.code.rest[words], j - i), np.flatnonzero(words == 0) + 1
                sizes = np.diff(ends_at, prepend=0)
                for a, z in _runs(sizes):
                    run = slice(ends_at[a] - sizes[a], ends_at[z - 1])
                    whole[a:z] += model.log10(events(head.code, words[run], [c[run] for c in contexts], text[run] - np.int32(a), at[run], slots), z - a)
                inside = words != 1
                sums = np.bincount(text[inside], head.base[words[inside]], j - i)
                known = np.bincount(text[inside], (words[inside] > 0) | (ends > 0), j - i).astype(np.int64)
                length = pc.binary_length(pa.array(distinct, pa.string())).to_numpy(zero_copy_only=False)
                size = np.bincount(text, minlength=j - i) + (np.bincount(doc, length[where], j - i) if len(where) else 0)
                rid, ids = b.column(0)[i:j], b.column(1)[i:j].cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rid, ids, pa.nulls(j - i, pa.string()), pa.array(np.bincount(text, minlength=j - i).astype(np.int64)), pa.array(known), pa.array(sums), pa.array(whole), pa.array(size.astype(np.int64))], names=parts)
                rare = (words == 1)[np.flatnonzero(words != 0)] if len(where) else np.zeros(0, bool)
                pair, n = np.unique(doc[rare].astype(np.int64) * max(1, len(distinct)) + where[rare], return_counts=True)
                who = pa.array(pair // max(1, len(distinct)))
                none = [pa.nulls(len(who), t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([rid.take(who), ids.take(who), pa.array(distinct, pa.string()).take(pa.array(pair % max(1, len(distinct)))), pa.array(n.astype(np.int64)), *none], names=parts)

    found = df.select(F.monotonically_increasing_id().alias("rid"), id_col, text_col)
    found = written(found.mapInArrow(look, "rid bigint, id bigint, word string, n bigint, known bigint, base double, whole double, bytes bigint"), "partials")
    seen = found.where("word is not null").select("rid", "word", F.col("n").alias("m")).join(lexicon, "word")
    plain = F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1)))
    seen = seen.select("rid", F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, F.col("m")).otherwise(0).alias("known"), (plain * F.col("m")).alias("base"), (F.col("p") * F.col("m")).alias("whole"), F.lit(0).cast("long").alias("bytes"))
    every = found.where("word is null").drop("word").union(seen).groupBy("rid").agg(F.max("id").alias(id_col), *(F.sum(x).alias(x) for x in parts[3:]))
    bits = F.col("whole") * float(-np.log2(10)) / F.col("bytes")
    return every.select(id_col, F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("whole").alias("score"), bits.alias("bits_per_byte"))
