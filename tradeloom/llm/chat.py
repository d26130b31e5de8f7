"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical turns.

A line of a transcript begins or continues a turn of a role; these are the hidden states.  What is seen of a line is its
speaker marker (of a role, another one, or none), whether a blank line or the transcript's start precedes it, its length
and whether it asks.  Start, transition and emission probabilities are counted over all labelled transcripts;
Viterbi decoding recovers the likeliest states, all transcripts of a batch line by line together.  Then
each turn is rendered with its role and without its marker.

A null or empty transcript, or one of blank lines, has no turns and renders to the empty string.  Ties go to the state
that comes first.  Without labelled transcripts all states are alike, and markers alone decide nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import by_batch, byte_order, prepare

ROLES = ("system", "user", "assistant")
#: Names by which transcripts mark the speakers: fixed values.
SPEAKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "bot", "ai", "answer", "a", "model", "agent"),
}
#: Turns of a conversation that make one transcript at most, so that a conversation of any length is dealt out.
TURNS = 256
#: Count added to every start, transition and emission.
SMOOTH = 0.5
STATES = 2 * len(ROLES)  # begins a turn of role k: 2k; continues it: 2k + 1
SEEN = (len(ROLES) + 2) * 3 * 4 * 2

_NAME = {n: k for k, role in enumerate(ROLES) for n in SPEAKERS[role]}
_MARKER = re.compile(r"^\s*(?:#+\s*|\[\s*|\*+\s*|>+\s*)?([^\W\d_]{1,16})\s*(?:\]|\*+)?\s*(?::|>|-(?=\s))\s*(?:\*+\s*)?")


def lines_of(text: str) -> list[tuple[str, int, int]]:
    """The lines that are not blank: (line, what is seen of it, where its text begins after a marker)."""
    out, before = [], 2  # 2: start, 1: after a blank line, 0: after a line
    for line in text.split("\n"):
        if not line.strip():
            before = max(before, 1)
            continue
        m = _MARKER.match(line)
        mark = len(ROLES) + 1 if not m else _NAME.get(m[1].lower(), len(ROLES))
        size = sum(len(line) >= n for n in (40, 120, 400))
        seen = ((mark * 3 + before) * 4 + size) * 2 + line.rstrip().endswith("?")
        out.append((line, seen, m.end() if m and mark < len(ROLES) else 0))
        before = 0
    return out


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # log probabilities
    step: np.ndarray
    emit: np.ndarray


def fit(df: DataFrame, text_col: str, states_col: str) -> Model:
    """Counts over all rows with a transcript and the states (array of int) of its non-blank lines.

    The driver gets at most STATES x (1 + STATES + SEEN) counts.
    """
    prepare(df.sparkSession)
    width = 1 + STATES + SEEN

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros((STATES, width), np.int64)
        for text, states in zip(byte_order(b.column(0)).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen = [x[1] for x in lines_of(text)]
            if len(seen) != len(states) or not seen:
                continue
            n[states[0], 0] += 1
            np.add.at(n, (states[:-1], [1 + s for s in states[1:]]), 1)
            np.add.at(n, (states, [1 + STATES + o for o in seen]), 1)
        s, k = np.nonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), pa.array(n[s, k])], names=["state", "what", "n"])

    rows = df.select(text_col, states_col).where(F.col(text_col).isNotNull() & F.col(states_col).isNotNull())
    rows = rows.mapInArrow(by_batch(count), "state bigint, what bigint, n bigint").groupBy("state", "what").agg(F.sum("n").alias("n")).collect()
    n = np.zeros((STATES, width))
    for r in rows:
        n[r.state, r.what] = r.n
    log = lambda x, axis: np.log((x + SMOOTH) / (x + SMOOTH).sum(axis=axis, keepdims=True))
    # a turn can only be continued by its own role, and a transcript begins with a turn
    start, step = log(n[:, 0], 0), log(n[:, 1 : 1 + STATES], 1)
    start[1::2] = -np.inf
    for k in range(len(ROLES)):
        step[[i for i in range(STATES) if i // 2 != k], 2 * k + 1] = -np.inf
    return Model(start, step, log(n[:, 1 + STATES :], 1))


def viterbi(seen: list[list[int]], model: Model) -> list[np.ndarray]:
    """The likeliest states of each sequence; sequences advance together, the longest last."""
    order = sorted(range(len(seen)), key=lambda i: -len(seen[i]))
    size = np.array([len(seen[i]) for i in order], np.int64)
    flat = np.array([o for i in order for o in seen[i]], np.int64)
    first = np.cumsum(size) - size
    longest = int(size[0]) if len(size) else 0
    back: list[np.ndarray] = []
    live = int((size > 0).sum())
    score = model.start[None] + model.emit[:, flat[first[:live]]].T if live else np.zeros((0, STATES))
    ends = [score]
    for t in range(1, longest):
        live = int((size > t).sum())
        reach = score[:live, :, None] + model.step[None]
        back.append(reach.argmax(axis=1))
        score = reach.max(axis=1) + model.emit[:, flat[first[:live] + t]].T
        ends.append(score)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
    for r, i in enumerate(order):
        if size[r]:
            path = np.empty(size[r], np.int64)
            path[-1] = ends[size[r] - 1][r].argmax()
            for t in range(int(size[r]) - 2, -1, -1):
                path[t] = back[t][r, path[t + 1]]
            out[i] = path
    return out


def render(lines: list[tuple[str, int, int]], states: np.ndarray) -> tuple[list[str], str]:
    """Roles of the turns, and the canonical text."""
    turns: list[tuple[str, list[str]]] = []
    for (line, _, begin), s in zip(lines, states.tolist(), strict=True):
        if s % 2 == 0:
            turns.append((ROLES[s // 2], [line[begin:].strip()]))
        else:
            turns[-1][1].append(line.strip())
    return [r for r, _ in turns], "".join(f"<|im_start|>{r}\n" + "\n".join(x) + "<|im_end|>\n" for r, x in turns)


def parse(df: DataFrame, keys: list[str], text_col: str, model: Model) -> DataFrame:
    """(keys, states, roles, rendered) of each whole transcript."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # STATES x (1 + STATES + SEEN) numbers

    def run(batches):
        for b in batches:
            texts = byte_order(b.column(len(keys)))
            for i, j in slices(texts):
                lines = [lines_of(t) for t in texts[i:j].to_pylist()]
                states = viterbi([[x[1] for x in t] for t in lines], shared.value)
                done = [render(t, s) for t, s in zip(lines, states, strict=True)]
                own = [b.column(k)[i:j] for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.tolist() for s in states], pa.list_(pa.int32())), pa.array([r for r, _ in done], pa.list_(pa.string())), pa.array([x for _, x in done])], names=[*keys, "states", "roles", "rendered"])

    rows = df.select(*keys, text_col)
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, kinds + "states array<int>, roles array<string>, rendered string")


def transcripts(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, part, transcript, truth): conversations as raw transcripts, and the states of their lines.

    Turns follow each other by number, then role and text; TURNS numbers make a part.  Of five turns four begin
    with one of their role's speaker names, the fifth after a blank line only.  Equal rows count once; rows without a
    conversation are one each; an unknown or null role counts as user; a null text is empty and leaves no line.  A part without
    any line keeps its row, with an empty transcript, unless it has no conversation either.
    """
    role = F.lower(F.col(role_col))
    known = F.when(role.isin(*ROLES), role).otherwise("user")
    rows = df.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), known.alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.dropDuplicates().withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))
    name: Column = F.lit("")
    for r in ROLES:
        for k in range(4):
            mark = SPEAKERS[r][k].capitalize() + ": "
            name = F.when((F.col("role") == r) & (pick == k), F.lit(mark)).otherwise(name)
    body = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    number = F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(ROLES) for x in (r, 2 * k)]), F.col("role"))
    states = F.transform(F.col("lines"), lambda _, i: F.when(i == 0, number).otherwise(number + 1))
    rows = rows.withColumn("lines", body)
    rows = rows.select("conv_id", "own", F.size("lines").alias("n"), F.floor(F.coalesce("turn", F.lit(0)) / TURNS).cast("bigint").alias("part"), F.struct("turn", "role", "text", F.concat(F.when(name == "", F.lit("\n")).otherwise(name), F.array_join("lines", "\n")).alias("raw"), states.alias("states")).alias("t"))
    rows = rows.groupBy("conv_id", "own", "part").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("t")))).alias("turns")).where("conv_id is not null or size(turns) > 0")
    return rows.select("conv_id", "part", F.array_join("turns.raw", "\n").alias("transcript"), F.flatten("turns.states").alias("truth"))
