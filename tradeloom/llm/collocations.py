"""Phrases whose words stand together more often than their parts, from position bitmaps of words.

Texts of a language are cut at punctuation into pieces and these into words, and their words are laid out in shards of SHARD places with
an empty place between pieces.  A shard keeps a compressed bitmap for each word: the 16-bit blocks that hold a bit, and
their masks.  Phrases are extended depth-first within a shard: a phrase's bitmap shifted by one, AND the bitmap of the next word, popcount.
Popcounts are summed over all shards, which carry the first CONTEXT places of their successor so that no phrase is lost at a cut.

Only what can be frequent is extended, level by level: words are summed first, then pairs of frequent words by a 64-bit hash, and phrases are
grown and told apart by their words only where every pair may be frequent.  Shards are laid out anew from the texts for each of these
passes, which is cheaper than to keep them, and know what is frequent by a table of bits: what finds its bit by accident costs counts, not
results, as every phrase's own sum decides.  Only counts are shuffled.

Defined results: a null or empty text has no words; a null language is ``und``; equal rows and repeated ids count like others, and
ids are not read; words are cut at ASCII characters only; an empty table gives no rows; other columns have no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import bit_table, byte_order, has_bit, prepare, ragged, tidy, written

#: Words of the longest phrase.
WORDS = 4
#: Places of a shard: 65,536 blocks of 16.  The last CONTEXT are its successor's.
SHARD, CONTEXT = 1 << 20, WORDS - 1
#: Places that a task holds before it writes the largest language's shard.
HELD = 4 * SHARD
#: Entries of bitmaps that are extended at once.
BATCH = 1 << 16
#: Bits of a table of frequent words or pairs: SPACE for each, within these bounds (8 KB to 32 MB).  A full table prunes less.
FILTER, SPACE = (1 << 16, 1 << 28), 16
#: Parts of a language from which its best phrases are taken before they are ranked together.
PARTS = 256

#: What a byte is: 0 part of a word, 1 space or tab, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def layout(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some texts, and the word at each place, -1 between pieces."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    raw = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[start : start + ends[-1]]]
    kind = _KIND[raw]
    shown = kind == 0
    fresh = shown.copy()
    fresh[1:] &= ~shown[:-1]
    edges = ends[:-1][ends[:-1] < len(raw)]
    fresh[edges] = shown[edges]
    cuts = np.cumsum(kind == 2)
    begin = np.flatnonzero(fresh)
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    piece = cuts[begin] + np.searchsorted(ends, begin, side="right")  # grows with every end of a piece or text
    before = np.cumsum(shown) - shown
    offsets = np.append(before[begin], shown.sum()).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[shown]))).dictionary_encode()
    place = np.arange(len(begin)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    stream = np.full(place[-1] + 2, -1, np.int32)
    stream[place] = coded.indices.to_numpy()
    return coded.dictionary, stream


def bitmaps(lang: str, shard: int, words: pa.Array, stream: np.ndarray) -> pa.RecordBatch:
    """A row for each word of a shard: occurrences before the context, and its bitmap's blocks and masks."""
    place = np.flatnonzero(stream >= 0)
    code = stream[place]
    order = np.argsort(code, kind="stable")
    place, code = place[order], code[order]
    block = place >> 4
    fresh = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))
    masks = np.add.reduceat(1 << (place & 15), fresh).astype("<u2")
    keys, at = block[fresh].astype("<u2"), code[fresh]
    rows = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    offsets = pa.py_buffer((np.append(rows, len(at)) * 2).astype(np.int32))
    n = np.bincount(code[place < SHARD - CONTEXT], minlength=len(words))[at[rows]]
    blob = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(x)])
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(np.full(len(rows), shard)), words.take(pa.array(at[rows])), pa.array(n.astype(np.int64)), blob(keys), blob(masks)], names=["lang", "shard", "word", "n", "keys", "masks"])


class _Lane:
    """Words of one language that no shard holds yet."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.streams: list[np.ndarray] = []
        self.size = self.known = 0

    def add(self, words: pa.Array, stream: np.ndarray) -> None:
        self.words.append(words)
        self.streams.append(np.where(stream < 0, -1, stream + self.known))
        self.known += len(words)
        self.size += len(stream)

    def take(self, whole: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Full shards; with ``whole`` what is left too."""
        if not self.size:
            return
        coded = pa.concat_arrays(self.words).dictionary_encode()
        stream = np.concatenate(self.streams)
        stream = np.where(stream < 0, -1, coded.indices.to_numpy()[np.maximum(stream, 0)]) if self.known else stream
        at = 0
        while len(stream) - at >= SHARD or whole and at < len(stream):
            yield coded.dictionary, stream[at : at + SHARD]
            at += SHARD - CONTEXT
        self.__init__()
        if at < len(stream):
            self.add(coded.dictionary, stream[at:])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lanes: dict[str, _Lane] = {}
    shard = TaskContext.get().partitionId() << 32

    def flush(lang: str, whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal shard
        for words, stream in lanes[lang].take(whole):
            if (stream >= 0).any():
                yield bitmaps(lang, shard, words, stream)
                shard += 1

    for b in batches:
        texts, langs = byte_order(b.column(1)), b.column(0)
        for lang in pc.unique(langs).to_pylist():
            mine = texts.filter(pc.equal(langs, lang))
            lane = lanes.setdefault(lang, _Lane())
            for i, j in slices(mine):
                lane.add(*layout(mine[i:j]))
                if lane.size >= SHARD:
                    yield from flush(lang, False)
        while sum(x.size for x in lanes.values()) > HELD:
            most = max(lanes, key=lambda k: lanes[k].size)
            yield from flush(most, True)
            del lanes[most]
    for lang in list(lanes):
        yield from flush(lang, True)


class ShardIndex:
    """Bitmaps of a shard's words, by word and by block."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        self.words = rows.column("word").combine_chunks()
        sizes = pc.binary_length(rows.column("keys")).to_numpy() // 2
        self.keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("keys")]).astype(np.int64)
        self.masks = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("masks")])
        self.code = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(self.keys, kind="stable")
        self.by_code, self.by_mask = self.code[order], self.masks[order]
        self.start = np.searchsorted(self.keys[order], np.arange(SHARD // 16 + 1))

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, block, mask) of all words, some words at a time, without the context's places."""
        masks = np.where(self.keys == SHARD // 16 - 1, self.masks & ((1 << 16 - CONTEXT) - 1), self.masks)
        bounds = np.searchsorted(self.code, self.code[:: max(1, BATCH)])
        for a, z in zip(bounds, [*bounds[1:], len(masks)], strict=True):
            if z > a:
                yield self.code[a:z], self.keys[a:z], masks[a:z]

    def extend(self, node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps one place on, AND every word's: (node, next word, block, mask) where a bit is left."""
        over = np.flatnonzero((mask >> 15 != 0) & (block + 1 < SHARD // 16))
        node, block = np.concatenate([node, node[over]]), np.concatenate([block, block[over] + 1])
        mask = np.concatenate([(mask << 1) & 0xFFFF, np.ones(len(over), np.uint16)]).astype(np.uint16)
        count = self.start[block + 1] - self.start[block]
        of, at = np.repeat(np.arange(len(node)), count), ragged(self.start[block], count)
        both = mask[of] & self.by_mask[at]
        kept = np.flatnonzero(both)
        of = of[kept]
        return node[of], self.by_code[at[kept]], block[of], both[kept]


def _children(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each entry's number among them, and popcounts by key."""
    keys, number = np.unique(key, return_inverse=True)
    return keys, number, np.bincount(number, weights=np.bitwise_count(mask), minlength=len(keys)).astype(np.int64)


def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(h, n): hashes of a shard's pairs of words, and how often they occur; those of some first words at a time."""
    ix = ShardIndex(rows)
    wide, h = len(ix.words), word_hashes(rows.column("lang")[0].as_py(), ix.words)
    for node, block, mask in ix.roots():
        node, word, _, both = ix.extend(node, block, mask)
        key, _, n = _children(node * wide + word, both)
        yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(h[key // wide], h[key % wide]).view(np.int64)), pa.array(n)], names=["h", "n"])


def _pairs(rows: pa.Table) -> pa.Table:
    return pa.Table.from_batches(pairs_of(rows))


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    seed = xxh3_64_intdigest(lang)
    return np.fromiter((xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a hash finds its bit."""
    return has_bit(table, (hashes >> np.uint64(32)).astype(np.int64) % (len(table) * 64))


def bits_of(hashes: DataFrame) -> Broadcast:
    """A table of bits of the hashes in the only column; its size follows their number within bounds."""
    bits, wanted = FILTER[0], hashes.count() * SPACE
    while bits < min(wanted, FILTER[1]):
        bits *= 2
    (h,) = hashes.columns
    return bit_table(hashes.selectExpr(f"shiftrightunsigned({h}, 32) % {bits} AS slot"), bits)


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of (lang, word)."""
    for b in batches:
        for lang in pc.unique(b.column(0)).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(lang, b.column(1).filter(pc.equal(b.column(0), lang))).view(np.int64))], names=["h"])


def _grown(ix: ShardIndex, lang: str, h: np.ndarray, table: np.ndarray, found: tuple, texts: pa.Array, last: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """found: bitmaps of nodes; texts, last: of each node, its phrase and last word.

    No inner function: one that calls itself would keep its shard until Python looks for cycles.
    """
    wide = len(ix.words)
    node, word, block, mask = ix.extend(*found)
    good = known(table, pair_hashes(h[last[node]], h[word]))
    node, word, block, mask = node[good], word[good], block[good], mask[good]
    if not len(node):
        return
    keys, number, counts = _children(node * wide + word, mask)
    texts, last = pc.binary_join_element_wise(texts.take(pa.array(keys // wide)), ix.words.take(pa.array(keys % wide)), " "), keys % wide
    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(keys)), texts, pa.array(counts)], names=["lang", "phrase", "n"])
    if length < WORDS:
        yield from _grown(ix, lang, h, table, (number, block, mask), texts, last, length + 1)


def phrases_of(rows: pa.Table, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of phrases of two to WORDS words of a shard, all of whose pairs have a bit in the table.

    Those of some first words are given before the next are grown: a shard of a large corpus holds millions.
    """
    ix, lang = ShardIndex(rows), rows.column("lang")[0].as_py()
    h = word_hashes(lang, ix.words)
    for found in ix.roots():
        yield from _grown(ix, lang, h, table, found, ix.words, np.arange(len(ix.words)), 2)


def _phrases(rows: pa.Table, table: np.ndarray) -> pa.Table:
    return pa.Table.from_batches(phrases_of(rows, table), pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]))


def frequent_phrases(df: DataFrame, lang_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f): all phrases of up to WORDS words that occur at least so often; and (lang, n): words of each language."""
    spark, schema = df.sparkSession, "lang string, phrase string, n bigint"
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))

    def shards(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.Table]:
        """Bitmaps of a shard's words that may be frequent."""
        for b in _shards(batches):
            kept = b.filter(pa.array(known(words, word_hashes(b.column("lang")[0].as_py(), b.column("word")))))
            if kept.num_rows:
                yield pa.Table.from_batches([kept])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _shards(batches):
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("word"), b.column("n")], names=["lang", "phrase", "n"])
            # null: all of them
            yield pa.RecordBatch.from_pydict({"lang": [b.column("lang")[0].as_py()], "phrase": pa.array([None], pa.string()), "n": [pc.sum(b.column("n")).as_py()]})

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, word_bits.value):
            yield from pairs_of(shard)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, word_bits.value):
            yield from phrases_of(shard, pair_bits.value)

    def total(step, schema: str, keys: list[str], name: str) -> DataFrame:
        sums = docs.mapInArrow(step, schema).groupBy(*keys).agg(F.sum("n").alias("f"))
        out = written(sums.where((F.col("f") >= least) | F.col(keys[-1]).isNull()), name)
        tidy(spark)
        return out

    words = total(single, schema, ["lang", "phrase"], "words")
    sums, words = words.where("phrase is null").select("lang", F.col("f").alias("n")), words.where("phrase is not null")
    word_bits = bits_of(words.select("lang", "phrase").mapInArrow(_word_hashes, "h bigint"))
    pair_bits = bits_of(total(double, "h bigint, n bigint", ["h"], "pairs").select("h"))
    more = total(longer, schema, ["lang", "phrase"], "longer")
    every = words.union(more)
    return every.withColumn("words", F.size(F.split("phrase", " "))), sums


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(df: DataFrame, lang_col: str, text_col: str, least: int = 30, covered: int = 80, scale: int = 2_000_000, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of at least two words.

    A phrase's score is that of its worst cut in two, floor(scale * a / (l + r)) of their counts.  Phrases that a longer one holds which
    occurs at least ``covered`` percent as often are left out.
    """
    prepare(df.sparkSession)
    every, sums = frequent_phrases(df, lang_col, text_col, least)
    every = written(every, "phrases")
    found = every.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "words")
    cuts = found.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    first, rest = F.array_join(F.slice("w", 1, F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", first.alias("first"), rest.alias("rest"))
    side = lambda part, f: every.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr(f"CAST({scale} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    parts = "flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(w, i, k), ' '))))"
    inside = found.where("words > 2").select("lang", F.col("a").alias("f"), F.explode(F.expr(parts)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * covered))
    rows = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task ranks more than PARTS * most of one
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return rows.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Of the contract's parameters, for DuckDB.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[:cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cut + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, a AS longer, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, k)] || [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, k - 1) IF k > 3]) AS phrase
  FROM c WHERE k > 2
), hidden AS (
  SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY lang, phrase
), ranked AS (
  SELECT best.lang, best.phrase, a, l, r, score, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN hidden h ON h.lang = best.lang AND h.phrase = best.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < 80 * a
)
SELECT ranked.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
