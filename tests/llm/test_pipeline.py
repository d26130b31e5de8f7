"""The near-duplicate stage and the shape of the stages."""

import corpus_pipeline


def test_distinct(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (7, long + " more"), (8, "quite another text of several words here"), (8, "a second text under the same id again"), (None, long), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)[:6]) for r in got.collect()) == [("5", "w0 w1 "), ("8", "a seco"), ("8", "quite "), ("9", "None"), ("None", "w0 w1 ")]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard", "best_fit_packing"]
