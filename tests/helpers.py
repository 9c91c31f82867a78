"""Small inputs shared by the tests."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def lines_df(spark, texts, doc_id=0):
    """Lines ``doc_id, line_pos, raw`` from a list of strings."""
    rows = [(doc_id, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, line_pos long, raw string")


def vectors_df(spark, rows, slug="s"):
    """Vector set from ``(word, [floats])`` in rank order."""
    return spark.createDataFrame([(slug, i, w, [float(x) for x in v]) for i, (w, v) in enumerate(rows)],
                                 "slug string, rank long, word string, vec array<float>")
