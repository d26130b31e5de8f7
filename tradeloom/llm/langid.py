"""Language identification with error-correcting output codes.

Every language has a codeword.  For each bit a linear classifier over hashed byte n-grams tells the languages
with a 1 from those with a 0: its weights are smoothed log-odds of the n-gram counts of all training texts,
and its margin is their mean over a text.  A bit weighs as much as it was right about the training texts.
Decoding sums the weighted logistic losses of the margins against every codeword and takes the least;
the score is the share of the chosen language among all by these losses.  Where that share is below ``SURE``, other codewords
are nearly as close and the prediction is flagged as ambiguous.

A text that is null or has no letter is ``und`` with score 0 and is not ambiguous.  Ties go to the language that
sorts first.  Training rows with a null text or language are left out; without any, every text is ``und``.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import by_batch, byte_order, prepare

#: Hashed n-grams have so many slots; three bytes make an n-gram.
SLOTS = 1 << 16
#: Beyond so many languages the counts would no longer be small.
MOST_LANGUAGES = 512
#: Share of the chosen language below which a prediction is ambiguous.
SURE = 0.6
#: A margin counts as sure at this many nats a byte n-gram.
SHARPNESS = 24.0

_FOLD = np.full(256, 32, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c
_LETTER = re.compile(r"[^\W\d_]").search


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # bits x SLOTS
    reliance: np.ndarray  # bits


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of 1 and -1, as columns no constant bit: all splits up to 5 languages, else far-apart random ones."""
    if n <= 5:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, np.int8).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    size = int(np.ceil(8 * np.log2(n)))
    for _ in range(64):
        c = rng.choice(np.array([1, -1], np.int8), (n, size))
        near = min(int((c[i] != c[i + 1 :]).sum(axis=1).min()) for i in range(n - 1))
        if near > far and (np.abs(c.sum(axis=0)) < n).all():
            best, far = c, near
    return best


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slot of the n-gram at each byte of the texts, and the texts' offsets.  Runs of non-letters yield slot 0."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[start : start + offsets[-1]]
    folded = _FOLD[raw]
    padded = np.concatenate([[np.uint32(32), np.uint32(32)], folded]).astype(np.uint32)
    key = (padded[:-2] << np.uint32(16)) | (padded[1:-1] << np.uint32(8)) | padded[2:]
    slot = (key * np.uint32(2654435761)) >> np.uint32(16)
    # a text's first n-grams would reach into the text before it, and blank ones say nothing
    blank = (padded[1:-1] == 32) & (padded[2:] == 32)
    for k in (0, 1):
        at = offsets[:-1][sizes > k] + k
        blank[at] = True
    return np.where(blank, 0, slot).astype(np.int64), offsets


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(offsets) - 1)
    out = np.add.reduceat(np.append(values, 0), np.minimum(offsets[:-1], len(values)))
    return np.where(np.diff(offsets) > 0, out, 0)


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Texts x bits: the mean weight of a text's n-grams."""
    slot, offsets = grams(texts)
    n = np.maximum(1, _sums((slot > 0).astype(np.float64), offsets))
    return np.stack([_sums(w[slot], offsets) / n for w in weights], axis=1)


def fit(df: DataFrame, text_col: str, lang_col: str) -> Model:
    """Counts n-grams over all rows with text and language; returns the bits' weights and their reliance.

    One row of SLOTS counts per language and task is summed by slot; the driver gets languages x SLOTS numbers.
    """
    prepare(df.sparkSession)
    df = df.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = byte_order(b.column(0)), b.column(1).cast(pa.string()).dictionary_encode()
            code = langs.indices.to_numpy()
            for i, j in slices(texts):
                slot, offsets = grams(texts[i:j])
                row = np.repeat(code[i:j], np.diff(offsets))
                for k in np.unique(code[i:j]):
                    name = langs.dictionary[int(k)].as_py()
                    if name not in total and len(total) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    total[name] = total.get(name, 0) + np.bincount(slot[row == k], minlength=SLOTS)
        for name, counts in total.items():
            at = np.flatnonzero(counts[1:]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "slot", "n"])

    counts = df.mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most MOST_LANGUAGES x SLOTS numbers
    langs = sorted(got.lang.unique())
    if not langs:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((0, SLOTS), np.float32), np.zeros(0))
    c = np.zeros((len(langs), SLOTS))
    c[got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int), got.slot.to_numpy(int)] = got.n
    share = c / np.maximum(1, c.sum(axis=1, keepdims=True))  # languages count alike, however many texts they have
    code = codewords(len(langs)) if len(langs) > 1 else np.ones((1, 1), np.int8)
    smooth = 1.0 / SLOTS / 4
    weights = np.zeros((code.shape[1], SLOTS), np.float32)
    for b, bit in enumerate(code.T):
        if (bit > 0).all() or (bit < 0).all():
            continue
        one, zero = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
        weights[b] = np.log((one + smooth) / (zero + smooth))
    weights[:, 0] = 0
    model = Model(langs, code, weights, np.ones(code.shape[1]))
    # how often each bit is right about the training texts
    shared = df.sparkSession.sparkContext.broadcast(model)  # bits x SLOTS x 4 bytes

    def right(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = shared.value, byte_order(b.column(0))
        row = np.searchsorted(np.array(m.langs), b.column(1).to_numpy(zero_copy_only=False).astype(str))
        ok, n = np.zeros(len(m.code.T), np.int64), 0
        for i, j in slices(texts):
            ok += (np.sign(margins(texts[i:j], m.weights)) == m.code[row[i:j]]).sum(axis=0)
            n += j - i
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(ok))), pa.array(ok), pa.array([n] * len(ok))], names=["bit", "ok", "n"])

    rate = {r[0]: r[1] for r in df.mapInArrow(by_batch(right), "bit bigint, ok bigint, n bigint").groupBy("bit").agg(F.sum("ok") / F.sum("n")).collect()}
    p = np.clip([rate.get(b, 0.75) for b in range(code.shape[1])], 0.51, 0.999)
    return Model(langs, code, weights, np.log(p / (1 - p)) / np.log(p / (1 - p)).sum())


def decode(m: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of each row of margins."""
    loss = np.einsum("b,nlb->nl", model.reliance, np.logaddexp(0, -SHARPNESS * m[:, None, :] * model.code[None]))
    best = loss.argmin(axis=1)
    z = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score = 1 / z.sum(axis=1)
    return best, score, score < SURE


def predict(df: DataFrame, id_col: str, text_col: str, model: Model, carry: bool = False) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of each whole text; with carry, also df's own columns, in a struct ``row``."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bits x SLOTS x 4 bytes

    def run(batches):
        model = shared.value
        names = np.array([*model.langs, "und"], object)
        for b in batches:
            texts, ids = byte_order(b.column(1)), b.column(0).cast(pa.int64())
            for i, j in slices(texts):
                part = texts[i:j]
                letters = np.array([_LETTER(x) is not None for x in part.to_pylist()]) & bool(model.langs)
                best, score, unsure = np.full(j - i, len(model.langs)), np.zeros(j - i), np.zeros(j - i, bool)
                if letters.any():
                    k, s, u = decode(margins(part, model.weights), model)
                    best, score, unsure = np.where(letters, k, best), np.where(letters, s, 0.0), letters & u
                own = [b.column(2)[i:j]] if carry else []
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure), *own], names=[id_col, "lang_pred", "score", "ambiguous", "row"][: 4 + carry])

    rows = df.select(id_col, text_col, *([F.struct("*").alias("row")] if carry else []))
    kind = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, f"`{id_col}` bigint, lang_pred string, score double, ambiguous boolean" + kind)
