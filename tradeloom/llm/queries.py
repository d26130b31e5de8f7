"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, langid, lm, merkle, neardup_embed, ngram_join, packing, suffix_dedup, tokencount, topk, toxicity
from .common import held_out, table, written
from .merkle_sql import manifest_sql

#: Tokens beyond which op10 marks a text.
TOKEN_LIMIT = 4096
#: Labels that teach toxicity at most (under 1 MB of ids).
LABELLED = 50_000
#: Score from which a text counts as toxic.
TOXIC_SCORE = 0.3
#: Tokens of a packed sequence.
SEQUENCE_TOKENS = 2048


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out("doc_id", 4)), "text", "lang")
    found = langid.predict(docs, "doc_id", "text", model)
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    ids = bpe.encode(docs, "doc_id", "text", path)
    return bpe.digests(bpe.decode(ids, "doc_id", path), "doc_id")


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame, most: int = LABELLED) -> DataFrame:
    """Training rows for toxicity: (text, toxic) of at most ``most`` labels, those of the lowest hash of their id.

    The bound lets the labels be broadcast, so no text is shuffled; the texts are written once for several passes.  A document with
    contradicting labels is taught once with each, repeated labels once.  Where there are more labels, those above a hash that about
    ``most`` of them stay below are left out before the rest meet in one task to be ordered.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out("doc_id", 4)).distinct()
    labels = labels.withColumn("h", F.xxhash64("doc_id"))
    n, room = labels.count(), most + 10 * most**0.5 + 100
    below = labels
    while n > room:
        below = labels.where(F.col("h") <= int(room / n * 2**64) - 2**63)
        if below.count() >= most:
            break
        room *= 2
        below = labels
    some = below.orderBy("h", "doc_id", "toxic").limit(most).drop("h")
    return written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic"), "labelled")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(labelled(spark, sf_dir, docs), "text", "toxic", docs)
    found = toxicity.score(docs, "doc_id", "text", model)
    predicted = (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", predicted, F.size("passages").alias("n_passages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its turns as recovered from the transcript, lines whose role is right, and the rendered text."""
    raw = chat.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    raw = written(raw, "transcripts")
    model = chat.fit(raw.where(~held_out("conv_id", 4)), "transcript", "truth")
    found = chat.parse(raw, ["conv_id", "part", "truth"], "transcript", model)
    right = F.size(F.filter(F.zip_with("states", "truth", lambda s, t: F.floor(s / 2) == F.floor(t / 2)), lambda x: x))
    return found.select("conv_id", "part", held_out("conv_id", 4).alias("held_out"), F.size("states").alias("n_lines"), right.alias("n_right"), F.size("roles").alias("n_turns"), F.array_join("roles", ",").alias("roles"), "rendered")


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_embed.range_join(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.98)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", ~held_out("doc_id", 7))
    return found.withColumn("held_out", held_out("doc_id", 7))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, num=90, den=100)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"), SEQUENCE_TOKENS)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = tokencount.count_tokens(docs, "doc_id", "text", vocabulary("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", fields, fields | {"text": merkle.lower_ascii(F.col("text"))}, tampered)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), "lang", "text", least=30, covered=80, most=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_bpe_codec, op3_toxicity, op4_chat_format, op5_embedding_neardup, op6_lm_scoring, op7_ngram_jaccard, op8_best_fit_packing, op9_topk_search, op10_token_counts, op11_suffix_dedup, op12_merkle_manifest, op13_phrase_collocations)}


#: Full scores of all query and candidate pairs, ranked.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id,
         CAST(coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS n FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_topk_search": OP9_SQL, "op12_merkle_manifest": manifest_sql(), "op13_phrase_collocations": collocations.SQL}
