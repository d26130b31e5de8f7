"""Toxicity by maximum-scoring segment search.

A token's score is its log-odds between toxic and other training texts, counted once a text, under a Dirichlet
prior that is the same for both classes and grows with the token's share of all documents: few counts say little, either way.
Every token costs ``COST`` besides.  A linear scan finds every maximal segment of positive score in a text (Ruzzo and Tompa).  Segment scores follow an
extreme-value law: lambda solves E[exp(lambda s)] = 1 over the tokens of the other training texts, K is fitted to their
segments, and a segment of score S in a text of n tokens has E = K n exp(-lambda S) chance rivals.  Segments with E below
``EVALUE`` are the text's toxic passages; their surplus -ln(E), summed, is the text's evidence, or the best segment's -ln(E) if there is
none.  The training texts' rates by evidence turn it into a score from 0 to 1.  For lambda, K and the rates every training text
is scored without its own counts, so they hold for new texts however few the labels.

A null or empty text has no token, no passage and the score of the least evidence.  Rows without a label teach nothing; without
any of a class all texts get one score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import by_batch, byte_order, distinct_words, prepare

#: What any token costs a segment.
COST = 0.75
#: The prior counts as so many texts that hold the token, and so many more for a token that all documents hold.
PRIOR, SPREAD = 4.0, 100.0
#: The model keeps the tokens whose log-odds are most certain, at most so many, so that it can be broadcast (some 10 MB); the
#: others count as tokens that say nothing.
MOST_TOKENS = 100_000
#: A passage's expected number of chance rivals in its text.
EVALUE = 0.05
#: Segments that must reach the score at which K is fitted.
TAIL = 50
#: Evidence is calibrated in classes of one nat, from LEAST on.
LEAST, CLASSES = -12, 64
#: Histogram of token scores and of segment scores.
BINS, TOKEN_BIN, SEGMENT_BIN = 400, 0.05, 0.25

_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¡¿"


@dataclass(frozen=True)
class Model:
    rows: dict[str, int]  # a token's place in odds
    odds: np.ndarray  # per known token, and last of all others: its score; without one other text; without one toxic text
    lam: float
    k: float
    rates: np.ndarray  # score by class of evidence


def token(word: str) -> str:
    """Lower case without outer punctuation."""
    return word.lower().strip(_STRIP)


def segments(hits: list[tuple[int, float, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a text, given the tokens of positive score as (position, sum of scores
    before it, sum up to its end).

    Linear in their number: a candidate points to the nearest one before it that starts lower, so those it passed over are
    not looked at again.
    """
    open_: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum up to the end, pointer
    for at, left, right in hits:
        first = at
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= left:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= right:
                break
            first, left = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append((first, at, left, right, j))
    return [(b - a, i, j) for i, j, a, b, _ in open_]


def _tokens(texts: pa.Array, rows: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The row of every token of the texts, one after the other, and the texts' offsets; blanks are no tokens."""
    words, at, offsets = distinct_words(texts)
    row = np.fromiter((-1 if w == "" else rows.get(token(w), len(rows)) for w in words), np.int64, len(words))[at] if len(at) else np.zeros(0, np.int64)
    kept = row >= 0
    return row[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def _scored(texts: pa.Array, model: Model, table: np.ndarray | None = None):
    """For each text: number of tokens, their scores, and its segments.  table: each text's row of the model's odds."""
    row, offsets = _tokens(texts, model.rows)
    value = model.odds[0 if table is None else np.repeat(table, np.diff(offsets)), row]
    total = np.concatenate([[0.0], np.cumsum(value)])
    hits = np.flatnonzero(value > 0)
    first = np.searchsorted(hits, offsets)
    for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        mine = hits[first[i] : first[i + 1]]
        yield z - a, value[a:z], segments(list(zip((mine - a).tolist(), (total[mine] - total[a]).tolist(), (total[mine + 1] - total[a]).tolist(), strict=True)))


def passages(n: int, found: list[tuple[float, int, int]], model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Evidence of a text of n tokens, and its passages (first, last, score, E)."""
    if not found:
        return float(LEAST), []
    worth = [(np.log(model.k * n) - model.lam * s, s, i, j) for s, i, j in found]
    kept = [(i, j, s, float(np.exp(e))) for e, s, i, j in worth if e < np.log(EVALUE)]
    return (-sum(e for e, *_ in worth if e < np.log(EVALUE)) if kept else -min(worth)[0]), kept


def fit(df: DataFrame, text_col: str, label_col: str, corpus: DataFrame | None = None) -> Model:
    """Learns from every row with text and a label of 0 or 1; ``corpus`` has the texts that the prior follows (else df).

    Token counts are summed per task before they are shuffled; the driver gets the kept tokens, at most
    MOST_TOKENS, and histograms of fixed size.
    """
    prepare(df.sparkSession)
    df = df.select(text_col, F.col(label_col).cast("int").alias("y")).where(F.col(text_col).isNotNull() & F.col("y").isin(0, 1))

    def count(batches):
        total: dict[str, list[int]] = {}

        def out():
            rows = list(total.items())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1][0] for r in rows], pa.int64()), pa.array([r[1][1] for r in rows], pa.int64())], names=["token", "n0", "n1"])

        for b in batches:
            texts, y = byte_order(b.column(0)), b.column(1).to_numpy()
            for i, j in slices(texts):
                words, at, offsets = distinct_words(texts[i:j])
                number: dict[str, int] = {}
                same = np.fromiter((number.setdefault(token(w), len(number)) for w in words), np.int64, len(words))
                pair = np.unique(np.repeat(np.arange(j - i), np.diff(offsets)) * max(1, len(number)) + same[at])
                row, what = y[i:j][pair // max(1, len(number))], pair % max(1, len(number))
                n1 = np.bincount(what[row == 1], minlength=len(number))
                n0 = np.bincount(what[row == 0], minlength=len(number))
                for t, a, z in zip(number, n0.tolist(), n1.tolist(), strict=True):
                    if t:
                        c = total.get(t)
                        if c is None:
                            total[t] = [a, z]
                        else:
                            c[0] += a
                            c[1] += z
                if len(total) > 200_000:
                    yield out()
        if total:
            yield out()

    counts = df.mapInArrow(count, "token string, n0 bigint, n1 bigint").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.persist()
    n0, n1 = (x or 0 for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    share = n1 / max(1, n0 + n1)
    # a token of one text says nothing once its text is left out
    one, other = F.col("n1") + PRIOR * share, F.col("n0") + PRIOR * (1 - share)
    z = F.abs(F.log(one / other) - F.lit(float(np.log(share / (1 - share))))) / F.sqrt(1 / one + 1 / other) if 0 < share < 1 else F.lit(0.0)
    some = counts.where(F.col("n0") + F.col("n1") > 1).withColumn("z", F.floor(z * 100))
    by, least, room = some.groupBy("z").count().collect() if 0 < share < 1 else [], 0, MOST_TOKENS
    for r in sorted(by, key=lambda r: -r[0]):
        room -= r[1]
        if room < 0:
            least = r[0] + 1
            break
    kept = some.where(F.col("z") >= least).select("token", "n0", "n1").toPandas() if by else []  # at most MOST_TOKENS
    counts.unpersist()
    rows = {t: i for i, t in enumerate(kept.token)} if len(kept) else {}
    shared = df.sparkSession.sparkContext.broadcast(rows)

    def spread_over(batches):
        held, texts_ = np.zeros(len(rows) + 1, np.int64), 0
        for b in batches:
            texts = byte_order(b.column(0))
            for i, j in slices(texts):
                row, offsets = _tokens(texts[i:j], shared.value)
                pair = np.unique(np.repeat(np.arange(j - i), np.diff(offsets)) * len(held) + row)
                held += np.bincount(pair % len(held), minlength=len(held))
                texts_ += j - i
        held[-1] = texts_
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["row", "n"])

    every = np.zeros(len(rows) + 1)
    if rows:
        for r, n in (df if corpus is None else corpus).select(text_col).mapInArrow(spread_over, "row bigint, n bigint").groupBy("row").agg(F.sum("n")).toLocalIterator():
            every[r] = n
    prior = PRIOR + SPREAD * every[:-1] / max(1.0, every[-1])

    def odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.append(np.log((one / share + prior) / (zero / (1 - share) + prior)) - COST, -COST)

    if rows:
        zero, one = kept.n0.to_numpy(float), kept.n1.to_numpy(float)
        table = np.stack([odds(zero, one), odds(np.maximum(zero - 1, 0), one), odds(zero, np.maximum(one - 1, 0))])
    else:
        table = np.full((3, 1), -COST)
    start = df.sparkSession.sparkContext.broadcast(Model(rows, table, 1.0, 1.0, np.zeros(CLASSES)))

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, y = byte_order(b.column(0)), b.column(1).to_numpy()
        n, tail = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for i, j in slices(texts):
            for r, (_, value, found) in enumerate(_scored(texts[i:j], start.value, y[i:j] + 1)):
                if y[i + r] == 0:
                    n += np.bincount(np.clip(np.rint(value / TOKEN_BIN).astype(np.int64) + BINS // 2, 0, BINS - 1), minlength=BINS)
                    for s, *_ in found:
                        tail[min(BINS - 1, int(s / SEGMENT_BIN))] += 1
        return pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(tail)], names=["bin", "n", "tail"])

    n, tail = np.zeros(BINS), np.zeros(BINS)
    for r in df.mapInArrow(by_batch(spread), "bin bigint, n bigint, tail bigint").groupBy("bin").agg(F.sum("n"), F.sum("tail")).collect():
        n[r[0]], tail[r[0]] = r[1], r[2]
    value = (np.arange(BINS) - BINS // 2) * TOKEN_BIN
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        lam = (lo + hi) / 2
        lo, hi = (lam, hi) if (n * np.exp(lam * value)).sum() < n.sum() else (lo, lam)
    lam = lo
    # K: as many segments expected beyond the highest score that TAIL of them reach as there are
    above = tail[::-1].cumsum()[::-1]
    at = int(np.flatnonzero(above >= min(TAIL, above[0]))[-1]) if above[0] else 0
    k = float(np.clip(above[at] / max(1.0, n.sum()) * np.exp(lam * at * SEGMENT_BIN), 1e-7, 10.0)) if above[0] else 1.0
    plain = df.sparkSession.sparkContext.broadcast(Model(rows, table, lam, k, np.zeros(CLASSES)))

    def classes(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, y = byte_order(b.column(0)), b.column(1).to_numpy()
        n = np.zeros((CLASSES, 2), np.int64)
        for i, j in slices(texts):
            for r, (size, _, found) in enumerate(_scored(texts[i:j], plain.value, y[i:j] + 1)):
                n[_class(passages(size, found, plain.value)[0]), y[i + r]] += 1
        return pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["class", "n0", "n1"])

    found = df.mapInArrow(by_batch(classes), "class bigint, n0 bigint, n1 bigint").groupBy("class").agg(F.sum("n0"), F.sum("n1")).collect()
    n = np.zeros((CLASSES, 2))
    for c, a, b in found:
        n[c] = a, b
    return Model(rows, table, lam, k, _rising(n))


def _class(evidence: float) -> int:
    return int(np.clip(np.floor(evidence) - LEAST, 0, CLASSES - 1))


def _rate(evidence: float, rates: np.ndarray) -> float:
    """The rate at this evidence, between those of the middles of classes."""
    return float(np.interp(evidence - LEAST - 0.5, np.arange(CLASSES), rates))


def _rising(n: np.ndarray) -> np.ndarray:
    """Rates of label 1 by class, smoothed and made to rise with the class (pool adjacent violators); within a pool, and over
    classes that no training text has, they rise evenly between the pools' middles."""
    base = (n[:, 1].sum() + 0.5) / (n.sum() + 1)
    pools: list[list[float]] = []
    for c in np.flatnonzero(n.sum(axis=1)):
        zero, one = n[c]
        pools.append([one, zero + one, c * (zero + one)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.full(len(n), base)
    return np.interp(np.arange(len(n)), [at / all_ for _, all_, at in pools], [(one + base) / (all_ + 1) for one, all_, _ in pools])


def score(df: DataFrame, id_col: str, text_col: str, model: Model, carry: bool = False) -> DataFrame:
    """(id, score, passages) of each whole text; a passage has its first and last token, score and E.

    With carry, also df's own columns, in a struct ``row``."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_TOKENS tokens
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e", pa.float64())]))

    def run(batches):
        model = shared.value
        for b in batches:
            texts, ids = byte_order(b.column(1)), b.column(0).cast(pa.int64())
            for i, j in slices(texts):
                found = [passages(n, segs, model) for n, _, segs in _scored(texts[i:j], model)]
                rates = pa.array([_rate(e, model.rates) for e, _ in found], pa.float64())
                spans = pa.array([[{"first": a, "last": z, "score": s, "e": e} for a, z, s, e in p] for _, p in found], spans_type)
                own = [b.column(2)[i:j]] if carry else []
                yield pa.RecordBatch.from_arrays([ids[i:j], rates, spans, *own], names=[id_col, "score", "passages", "row"][: 3 + carry])

    rows = df.select(id_col, text_col, *([F.struct("*").alias("row")] if carry else []))
    kind = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, f"`{id_col}` bigint, score double, passages array<struct<first:bigint,last:bigint,score:double,e:double>>" + kind)
