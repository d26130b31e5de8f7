"""Every opN query and every stage of the pipeline on whole tables with edge rows, against brute force, libraries or SQL; and on empty tables."""

import itertools
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeloom.llm import langid, queries
from tradeloom.llm.common import held_out, table

DATA = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
LONG = "the harbour and the village of the north " * 3000
EDGES = [(None, "a text without an id"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "123 -- 45!"), (9005, LONG), (9006, "one"), (9007, "one"), (9008, "One two three four"), (9008, "and another text of this id"), (9009, "x" * 5000)]
#: Names that the operators use for columns of their own.
CLASHES = ["score", "held_out", "row", "_n", "ids", "piece", "length", "node"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """A folder of the small tables with edge rows and columns of clashing names, and one of the same tables without rows."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    docs = pq.read_table(f"{DATA}/documents.parquet")
    odd = [{"doc_id": i, "text": t, "lang": "en" if i and i % 2 else None, "source": None, "n_chars": None} for i, t in EDGES]
    docs = pa.concat_tables([docs, pa.Table.from_pylist(odd, docs.schema), docs.slice(3, 1)])
    vectors = pq.read_table(f"{DATA}/embeddings.parquet")
    width = len(vectors["embedding"][0])
    apart = [0.0] * (width - 1) + [7.0]
    odd = [(9001, None, 1), (9002, [0.0] * width, 1), (9003, [math.nan] * width, 1), (9004, [None] * width, 1), (9005, vectors["embedding"][0].as_py(), None), (9100, apart, 99), (9100, apart, 99), (None, apart, None)]
    vectors = pa.concat_tables([vectors, pa.Table.from_pylist([dict(zip(vectors.schema.names, x, strict=True)) for x in odd], vectors.schema)])
    labels = pq.read_table(f"{DATA}/labels.parquet")
    odd = [(None, 1, 1), (9005, 1, 0), (9005, 1, 0), (9006, None, None), (7777, 0, 1)]
    labels = pa.concat_tables([labels, pa.Table.from_pylist([dict(zip(labels.schema.names, x, strict=True)) for x in odd], labels.schema)])
    talks = pq.read_table(f"{DATA}/conversations.parquet")
    odd = [(None, 0, "user", "no id"), (9001, None, None, None), (9002, 0, "user", ""), (9003, 1, "user", "a tie"), (9003, 1, "assistant", "a tie too")]
    talks = pa.concat_tables([talks, pa.Table.from_pylist([dict(zip(talks.schema.names, x, strict=True)) for x in odd], talks.schema)])
    for name, t in (("documents", docs), ("embeddings", vectors), ("labels", labels), ("conversations", talks)):
        for c in CLASHES:
            t = t.append_column(c, pa.array(range(len(t)), pa.int64()))
        pq.write_table(t, full / f"{name}.parquet")
        pq.write_table(t.slice(0, 0), empty / f"{name}.parquet")
    return str(full), str(empty)


@pytest.fixture(scope="module")
def docs(folders):
    return pq.read_table(f"{folders[0]}/documents.parquet").to_pylist()


def out_of(spark, name, folder):
    return queries.queries()[name](spark, folder).collect()


def rest(i, parts):
    return i is not None and zlib.crc32(str(i).encode()) % parts == 2


def in_range(rows, docs, parts):
    assert Counter(r.doc_id for r in rows) == Counter(d["doc_id"] for d in docs)
    assert all(r.held_out == rest(r.doc_id, parts) for r in rows)


def plain_language(model, text):
    """(lang, score) of a text by the definition: a mean over byte n-grams for each bit, then the least weighted loss."""
    if not text or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    fold = [b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text.encode()]
    seen = []
    for k in range(2, len(fold)):
        if fold[k - 1] != 32 or fold[k] != 32:
            key = fold[k - 2] << 16 | fold[k - 1] << 8 | fold[k]
            seen.append((key * 2654435761 & 0xFFFFFFFF) >> 16)
    seen = [s for s in seen if s]
    margin = model.weights[:, seen].astype(float).sum(axis=1) / max(1, len(seen))
    loss = [sum(w * math.log1p(math.exp(-langid.SHARPNESS * m * c)) for w, m, c in zip(model.reliance, margin, word, strict=True)) for word in model.code.tolist()]
    best = min(range(len(loss)), key=loss.__getitem__)
    return model.langs[best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def test_language_id(spark, folders, docs):
    rows = out_of(spark, "op1_language_id", folders[0])
    in_range(rows, docs, 4)
    model = langid.fit(table(spark, folders[0], "documents").where(~held_out("doc_id", 4)), "text", "lang")
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in rows:
        if r.doc_id != 9008:  # two texts
            lang, score = plain_language(model, text[r.doc_id])
            assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-6)
    lang = {d["doc_id"]: d["lang"] for d in docs if d["lang"] and (d["doc_id"] or 9000) < 9000}
    right = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and r.doc_id in lang]
    assert sum(right) >= 0.95 * len(right) > 0


def test_codewords_correct_a_wrong_bit():
    code = langid.codewords(12)
    model = langid.Model([str(k) for k in range(12)], code, np.zeros((code.shape[1], 1), np.float32), np.full(code.shape[1], 1 / code.shape[1]))
    for bit in range(code.shape[1]):
        margin = code.astype(float)
        margin[:, bit] *= -1
        assert (langid.decode(margin, model)[0] == np.arange(12)).all()


def test_toxicity(spark, folders, docs):
    rows = out_of(spark, "op3_toxicity", folders[0])
    in_range(rows, docs, 4)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    blank = {r.score for r in rows if r.doc_id in (9001, 9002, 9003)}
    assert len(blank) == 1 and blank.pop() == min(r.score for r in rows)


def test_chat_format(spark, folders):
    talks = pq.read_table(f"{folders[0]}/conversations.parquet").to_pylist()
    rows = out_of(spark, "op4_chat_format", folders[0])
    assert {r.conv_id for r in rows} == {t["conv_id"] for t in talks}
    assert all(r.n_right <= r.n_lines and r.held_out == rest(r.conv_id, 4) for r in rows)


def closed(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_embedding_neardup(spark, folders):
    given = pq.read_table(f"{folders[0]}/embeddings.parquet").to_pylist()
    whole = [g for g in given if g["vec_id"] is not None and g["label"] is not None and g["embedding"] and all(x is not None and math.isfinite(x) for x in g["embedding"]) and any(g["embedding"])]
    v = np.array([g["embedding"] for g in whole], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    same = np.array([g["label"] for g in whole])
    ids = [g["vec_id"] for g in whole]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero((u @ u.T >= 0.98) & (same[:, None] == same)), strict=True) if ids[a] != ids[b]]
    n = Counter(a for a, _ in links)
    want = closed([g["vec_id"] for g in given if g["vec_id"] is not None], links)
    rows = out_of(spark, "op5_embedding_neardup", folders[0])
    assert Counter(r.vec_id for r in rows) == Counter(g["vec_id"] for g in given)
    for r in rows:
        if r.vec_id is not None:
            assert r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)
            assert r.n_links == n[r.vec_id] or r.vec_id == 9100


def test_lm_scoring(spark, folders, docs):
    rows = out_of(spark, "op6_lm_scoring", folders[0])
    in_range(rows, docs, 7)
    tokens = sum(1 + len(re.findall("[^\x20\x09-\x0d]+", d["text"] or "")) for d in docs if not rest(d["doc_id"], 7))
    assert {r.train_tokens for r in rows} == {tokens}
    assert all(math.isfinite(r.score) and r.score < 0 and r.n_known <= r.n_tokens for r in rows)


def shingles(text, words):
    low = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(low[k : k + words]) for k in range(len(low) - words + 1)} if len(low) >= words else {tuple(low)} if low else set()


def near(docs, words, num):
    """Components of ids; rows of one id are one document."""
    sets = [(d["doc_id"], shingles(d["text"], words)) for d in docs if d["doc_id"] is not None]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if i != j and a and min(len(a), len(b)) * 100 >= num * max(len(a), len(b)) and 100 * len(a & b) >= num * len(a | b)]
    return closed([i for i, _ in sets], links)


def test_ngram_jaccard(spark, folders, docs):
    rows = out_of(spark, "op7_ngram_jaccard", folders[0])
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == Counter((d["doc_id"], len(shingles(d["text"], 3))) for d in docs)
    want = near(docs, 3, 90)
    assert all(r.component_id == want.get(r.doc_id) for r in rows)


def library_pieces(docs):
    for d in docs:
        ids = [*LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            some = np.array(ids[start : start + 2048], "<u4")
            yield d["doc_id"], k, start, len(some), zlib.crc32(some.tobytes())


def check_packed(rows, docs):
    want = Counter(library_pieces(docs))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    tokens = sum(w[3] * n for w, n in want.items())
    alone = sum(n for w, n in want.items() if w[3] > 1024)
    assert max(filled.values()) <= 2048 and len(filled) <= max(alone, -(-tokens // 2048)) + 1


def test_best_fit_packing(spark, folders, docs):
    check_packed(out_of(spark, "op8_best_fit_packing", folders[0]), docs)


def test_topk_search(spark, folders):
    duckdb.sql(f"create or replace view embeddings as select * from '{folders[0]}/embeddings.parquet'")
    rel = duckdb.sql(queries.oracle_sql()["op9_topk_search"])
    at = [list(rel.columns).index(c) for c in ("query_id", "rank", "vec_id", "score")]
    want = Counter(tuple(r[i] for i in at) for r in rel.fetchall())
    assert want and Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in out_of(spark, "op9_topk_search", folders[0])) == want


def test_codec_and_counts(spark, folders, docs):
    from sentencepiece import SentencePieceProcessor

    ids = Counter((d["doc_id"], len(LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs)
    assert Counter((r.doc_id, r.n_tokens) for r in out_of(spark, "op2_bpe_codec", folders[0])) == ids
    sp = SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    n = [(d["doc_id"], len((d["text"] or "").encode()), len(sp.encode(d["text"] or ""))) for d in docs]
    rows = out_of(spark, "op10_token_counts", folders[0])
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == Counter((*x, x[2] > 4096) for x in n)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folders, name):
    assert out_of(spark, name, folders[1]) == []


def key(rows):
    return Counter(repr(sorted((r if isinstance(r, dict) else r.asDict()).items())) for r in rows)


def test_stages(spark, folders, docs):
    """Each stage keeps what brute force keeps of its own input, in whole rows."""
    given = table(spark, folders[0], "documents")
    model = langid.fit(given.where(~held_out("doc_id", 4)), "text", "lang")
    spoken = [(d, *plain_language(model, d["text"])) for d in docs]
    got = corpus_pipeline.language(spark, given, folders[0])
    assert got.columns == given.columns and key(got.collect()) == key(d for d, lang, score in spoken if lang != "und" and score >= langid.SURE)

    toxic = {r.doc_id for r in out_of(spark, "op3_toxicity", folders[0]) if r.predicted}
    got = corpus_pipeline.clean(spark, given, folders[0])
    assert got.columns == given.columns and key(got.collect()) == key(d for d in docs if d["doc_id"] not in toxic)

    head = near(docs, 5, 80)
    often = Counter(d["doc_id"] for d in docs if d["doc_id"] is not None)
    least = {}  # rows that share an id: every different text once
    for d in docs:
        if often[d["doc_id"]] > 1:
            k = (d["doc_id"], d["text"])
            least[k] = min(least.get(k, d), d, key=lambda x: x["score"])
    want = [d for d in docs if d["doc_id"] is None or often[d["doc_id"]] == 1 and head[d["doc_id"]] == d["doc_id"]]
    got = corpus_pipeline.distinct(spark, given, folders[0])
    assert got.columns == given.columns and key(got.collect()) == key([*want, *least.values()])

    check_packed(corpus_pipeline.packed(spark, given, folders[0]).collect(), docs)


def test_pipeline(spark, folders):
    kept = table(spark, folders[0], "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, folders[0]).collect(), kept.schema)
    check_packed(corpus_pipeline.run(spark, folders[0]).collect(), [r.asDict() for r in kept.collect()])
    assert corpus_pipeline.run(spark, folders[1]).agg(F.count("*")).first()[0] == 0
