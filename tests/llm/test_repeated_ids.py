"""Near-duplicate stage of the pipeline on rows that share a doc_id."""

import corpus_pipeline


def test_only_equal_texts_of_a_repeated_id_go(spark):
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, words), (1, words), (1, other), (2, words), (3, "alone here"), (None, "no id"), (None, "no id"),
            (4, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, words), (1, other), (3, "alone here"), (None, "no id"), (None, "no id"),
                          (4, None), (4, "")], key=str)
