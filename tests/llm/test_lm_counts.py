"""The counts and log-odds of the mixers' inner loops against plain ones."""

import numpy as np
from pyspark.sql import functions as F

from tradeloom.llm import lm


def test_learner_counts_and_odds(monkeypatch):
    rng = np.random.default_rng(3)
    slots, bits = 64, 500
    learner, seen = lm.Learner.new(4, slots), []
    monkeypatch.setattr(lm, "_dot", lambda w, gate, odds: seen.append((gate, odds)) or np.zeros(len(gate), np.float32))
    want = np.zeros((4, slots, 2), np.int64)
    for _ in range(3):
        slot = [rng.integers(0, slots, bits) for _ in range(4)]
        bit = rng.integers(0, 2, bits).astype(np.int8)
        e = lm.Events(bit, np.zeros(bits, np.int32), rng.integers(0, 8, bits).astype(np.int8), np.zeros(bits, np.int32), slot, np.array([bits]))
        learner.read(e)
        gate, odds = seen[-1]
        before = [want[k][s] for k, s in enumerate(slot)]
        assert (gate == e.place * 3 + sum(x.sum(axis=1) > 0 for x in before[-lm.LONG :])).all()
        for x, o in zip(before, odds, strict=True):
            assert np.allclose(o, np.log((x[:, 1] + lm.LEAST) / (x[:, 0] + lm.LEAST)), atol=1e-5) and o.dtype == np.float32
        for k, s in enumerate(slot):
            np.add.at(want[k], (s, bit), 1)
    assert (learner.counts.reshape(4, slots, 2) == want).all()


def test_every_bit_of_a_word_is_mixed(spark):
    rng = np.random.default_rng(4)
    pairs = [f"first{k} second{k}" for k in range(2000)]
    rows = [(i, " ".join(pairs[k] for k in rng.integers(0, 2000, 200))) for i in range(200)]
    rows += [(1000, " ".join(pairs[:400])), (1001, " ".join(f"first{k} second{(k + 700) % 2000}" for k in range(400)))]
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")), "doc_id", "text", "lang", F.col("doc_id") < 1000)
    told = {r.doc_id: r.score / 400 for r in got.where("doc_id >= 1000").collect()}
    # 4,000 words of like frequency: sixteen of them share their first eight bits, which leaves 1.2 of log10 to frequency alone
    assert told[1000] > told[1001] + 3
