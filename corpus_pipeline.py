"""From raw documents to packed sequences: language, toxicity, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import langid, ngram_join, packing, toxicity
from tradeloom.llm.common import held_out, prepare, table, written
from tradeloom.llm.queries import SEQUENCE_TOKENS, TOXIC_SCORE, labelled, vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language is clearly nearest, go."""
    prepare(spark)
    model = langid.fit(docs.where(~held_out("doc_id", 4)), "text", "lang")
    found = langid.predict(docs, "doc_id", "text", model, carry=True)
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    prepare(spark)
    model = toxicity.fit(labelled(spark, sf_dir, docs), "text", "toxic", docs)
    return toxicity.score(docs, "doc_id", "text", model, carry=True).where(F.col("score") < TOXIC_SCORE).select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of the smallest id stays.

    Of rows that share an id every different text stays, once: an id that is not unique tells nothing about its texts.  Rows without
    an id stay, as do null and empty texts.
    """
    prepare(spark)
    groups = ngram_join.join_components(docs, "doc_id", "text", words=5, num=80, den=100)
    flags = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(F.col("component_id") != F.col("doc_id")).alias("_goes"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))  # docs may have columns of any name
    kept = rows.join(flags.where("_n > 1 or _goes"), "doc_id", "left").where("_n is null or _n > 1")
    many = kept.where("_n > 1").groupBy("doc_id", "text").agg(F.min("row").alias("row"))
    return kept.where("_n is null").select("row.*").unionByName(many.select("row.*"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the training sequences."""
    return packing.pack(docs, "doc_id", "text", vocabulary("word_bpe_49k.json"), SEQUENCE_TOKENS)


STAGES = [("language_id", language), ("toxicity", clean), ("ngram_jaccard", distinct), ("best_fit_packing", packed)]

#: SQL can't express the fitted models or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
