"""Token counts by rank-synchronous merging.

Pre-tokens (runs of blanks with what follows them) are held as ragged numpy arrays of symbols.  In every
step each sequence's lowest-ranked adjacent pair, the leftmost of equals, is merged in all sequences at
once; sequences without a mergeable pair leave.  The surviving symbols are counted: a symbol of the
vocabulary as one token, any other character as its UTF-8 bytes.  Counts of distinct pre-tokens are kept in a
bounded table of the Python worker, so each is merged once; no row is shuffled.

A null text counts as empty and has no token.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import slices
from .common import byte_order, prepare

#: Pre-tokens that a worker's table holds before it is emptied.
TABLE_WORDS = 400_000
#: Symbols merged at once.
BATCH_SYMBOLS = 200_000
#: Sequences beyond so many symbols are merged one by one.
LONG = 200
SPACE = "▁"
NO_RANK = np.int32(2**31 - 1)


class Merges:
    """Symbols, pair ranks and merged symbols of a sentencepiece BPE vocabulary."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i) for i in plain]
        score = [sp.get_score(i) for i in plain]
        order = {s: r for r, s in enumerate(sorted(set(score), reverse=True))}
        if not sp.encode_as_pieces("a")[0].startswith(SPACE) or any(SPACE in t.lstrip(SPACE) for t in text):
            raise ValueError("texts can only be cut at blanks if a blank is set before them and no piece spans one")
        number = {t: k for k, t in enumerate(text)}
        self.known = len(text)
        for c in sorted({c for t in text for c in t}):  # characters that only occur inside pieces
            number.setdefault(c, len(number))
        self.number = number
        self.chars = np.full(0x110000, -1, np.int32)
        for t, k in number.items():
            if len(t) == 1:
                self.chars[ord(t)] = k
        self.pairs = {}
        for t, s in zip(text, score, strict=True):
            for i in range(1, len(t)):
                a, b = number.get(t[:i]), number.get(t[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = (order[s], number[t])
        # the pairs in an open-addressed table, and the longest probe in it
        bits = len(self.pairs).bit_length() + 2
        self.shift, self.mask, self.probes = np.uint64(64 - bits), (1 << bits) - 1, 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros((1 << bits, 2), np.int32)
        for key, value in self.pairs.items():
            slot, n = (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits), 1
            while self.keys[slot] != -1:
                slot, n = (slot + 1) & self.mask, n + 1
            self.keys[slot], self.values[slot] = key, value
            self.probes = max(self.probes, n)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_RANK where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64) & 0xFFFFFFFF
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.keys[slot]
        for _ in range(self.probes):
            more = np.flatnonzero((found != key) & (found != -1))
            if not len(more):
                break
            slot[more] = (slot[more] + 1) & self.mask
            found[more] = self.keys[slot[more]]
        hit = (found == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.values[slot, 0], NO_RANK), self.values[slot, 1]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token: the ragged sequences in batches of about the same length."""
        out = np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        by_size = np.argsort(size, kind="stable")
        first = 0
        while first < len(words) and size[by_size[first]] <= LONG:
            width = int(size[by_size[first]])
            end = int(np.searchsorted(size[by_size], min(LONG, width + max(1, width // 8)), side="right"))
            end = min(end, first + max(1, BATCH_SYMBOLS // width))
            rows = by_size[first:end]
            out[rows] = self._count([words[i] for i in rows], size[rows])
            first = end
        for i in by_size[first:]:
            out[i] = self._count_long(words[i])
        return out

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters, and what a character counts if it stays alone."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.chars[codes]
        alone = np.where((sym >= 0) & (sym < self.known), 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        return sym, alone

    def _count(self, words: list[str], size: np.ndarray) -> np.ndarray:
        sym, alone = self._symbols(words)
        width = int(size.max())
        place = np.arange(width) < size[:, None]
        grid, weight = np.full(place.shape, -1, np.int32), np.zeros(place.shape, np.int32)
        grid[place], weight[place] = sym, alone
        out, row = np.zeros(len(words), np.int64), np.arange(len(words))
        rank = np.full((len(words), max(width, 2) - 1), NO_RANK, np.int32)
        into = np.zeros_like(rank)
        if width > 1:
            r, m = self.pair(grid[:, :-1].ravel(), grid[:, 1:].ravel())
            rank, into = r.reshape(rank.shape), m.reshape(rank.shape)
        while len(row):
            at = rank.argmin(axis=1)  # of equal ranks the leftmost
            n = np.arange(len(row))
            live = rank[n, at] != NO_RANK
            if not live.all():
                out[row[~live]] = weight[~live].sum(axis=1)
                grid, weight, rank, into, row, at = (x[live] for x in (grid, weight, rank, into, row, at))
                n = np.arange(len(row))
                if not len(row):
                    break
            merged = into[n, at]
            # every sequence loses one symbol: what stands right of the pair moves left
            columns = np.arange(grid.shape[1] - 1)
            left = columns <= at[:, None]
            grid, weight = np.where(left, grid[:, :-1], grid[:, 1:]), np.where(left, weight[:, :-1], weight[:, 1:])
            grid[n, at], weight[n, at] = merged, 1
            if grid.shape[1] == 1:
                out[row] = weight[:, 0]
                break
            left = columns[:-1] < at[:, None]
            rank, into = np.where(left, rank[:, :-1], rank[:, 1:]), np.where(left, into[:, :-1], into[:, 1:])
            for k in (at - 1, at):  # the merged symbol's new neighbours
                ok = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                rank[ok, k[ok]], into[ok, k[ok]] = self.pair(grid[ok, k[ok]], grid[ok, k[ok] + 1])
        return out

    def _count_long(self, word: str) -> int:
        """One very long sequence without a blank: the same merges in the same order from a heap of pairs."""
        sym, alone = (x.tolist() for x in self._symbols([word]))
        after, before, version = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)], [0] * len(sym)
        heap: list[tuple[int, int, int, int, int]] = []

        def add(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (p[0], i, version[i], version[j], p[1]))

        for i in range(len(sym)):
            add(i)
        gone = bytearray(len(sym))
        while heap:
            _, i, v, u, merged = heapq.heappop(heap)
            j = after[i]
            if gone[i] or version[i] != v or j < 0 or version[j] != u:
                continue
            sym[i], alone[i], gone[j] = merged, 1, 1
            version[i] += 1
            version[j] += 1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                add(before[i])
            add(i)
        return sum(a for a, g in zip(alone, gone, strict=True) if not g)


class CountTable:
    """Distinct pre-tokens and their tokens."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.counts: dict[str, int] = {}

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.counts) + len(words) > TABLE_WORDS:
            self.counts = {}
        counts = self.counts
        new = [w for w in words if w not in counts]
        if new:
            counts.update(zip(new, self.merges.count(new).tolist(), strict=True))
        return np.fromiter((counts[w] for w in words), np.int64, len(words))


@lru_cache(maxsize=4)
def count_table(path: str) -> CountTable:
    return CountTable(path)


_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def counted(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of a batch."""
    table = count_table(path)
    n = np.zeros(len(texts), np.int64)
    blank = pc.equal(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), blank).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    if len(plain):
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")  # one blank between words
        coded = lists.flatten().dictionary_encode()
        words = [SPACE + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        tokens = table.lookup(words)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(tokens)])
        o = lists.offsets.to_numpy()
        n[plain] = np.diff(ends[o - o[0]])
    for i in np.flatnonzero(odd):
        text = texts[int(i)].as_py()
        if text:
            words = _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
            distinct = sorted(set(words))
            known = dict(zip(distinct, table.lookup(distinct).tolist(), strict=True))
            n[i] = sum(known[w] for w in words)
    return n


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, n_bytes, n_tokens) of each whole text."""
    prepare(df.sparkSession)

    def run(batches):
        for b in batches:
            texts = byte_order(b.column(1))
            for i, j in slices(texts):
                part = texts[i:j]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j].cast(pa.int64()), pc.binary_length(part).cast(pa.int64()), pa.array(counted(part, path))],
                    names=[id_col, "n_bytes", "n_tokens"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint")
