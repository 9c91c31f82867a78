import random
import unicodedata

from pyspark.sql import functions as F

from helpers import lines_df
from lexiclust.functions import text as ft
from lexiclust.operators import text as tx


def _norm(spark, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    return [r[0] for r in df.select(ft.normalize_text(F.col("raw"), **kw)).collect()]


def test_cyrillic_email_and_url_removed(spark):
    assert _norm(spark, ["види ж@пример.мк и www.a.mk/x тука"]) == ["види и тука"]


def test_nfkc_ligature_and_fullwidth(spark):
    assert _norm(spark, ["ﬁ Ａ"]) == ["fi a"]


def test_nfkc_sensitive_set_is_exact():
    # a string free of the listed characters is already NFKC
    chars = ft.nfkc_sensitive_chars()
    flagged = set(chars)
    rnd = random.Random(3)
    pool = [chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c <= 0xDFFF]
    for _ in range(3000):
        s = "".join(rnd.choice(pool) for _ in range(8))
        if not (set(s) & flagged):
            assert unicodedata.normalize("NFKC", s) == s
    assert "ﬁ" in flagged and "é" not in flagged and "a" not in flagged


def test_nfkc_only_changes_flagged_rows(spark):
    df = spark.createDataFrame([("café",), ("ﬁne",), ("é",)], "s string")
    out = [r[0] for r in df.select(ft.nfkc(F.col("s"))).collect()]
    assert out == ["café", "fine", "é"]


def test_reference_language_profile(spark):
    texts = ["ова е македонски текст со ќ буква", "ова е текст без посебни букви тука",
             "mostly latin letters here and ќ", "1234567890 1234567890"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = [r[0] for r in df.select(ft.matches_profile(F.col("text"), ft.MACEDONIAN)).collect()]
    assert out == [True, False, False, False]


def test_length_boundary(spark):
    lines = lines_df(spark, ["a" * 19, "b" * 20])
    kept = [r["text"] for r in tx.clean_lines(lines).collect()]
    assert kept == ["b" * 20]


def test_blank_lines_count_towards_head(spark):
    lines = lines_df(spark, ["", "first line of text here", "", "second line of text here"])
    got = tx.head_lines(lines, 3).orderBy("line_pos").collect()
    assert [r["line_pos"] for r in got] == [0, 1, 2]
    assert [r["text"] for r in tx.clean_lines(tx.head_lines(lines, 3)).collect()] == [
        "first line of text here"]


def test_head_lines_across_documents(spark):
    rows = [(d, i, f"d{d} l{i}") for d in range(5) for i in range(d + 1)]
    lines = spark.createDataFrame(rows, "doc_id long, line_pos long, raw string")
    got = tx.head_lines(lines, 7, n_blocks=3).orderBy("doc_id", "line_pos").collect()
    assert [r["raw"] for r in got] == [r[2] for r in rows[:7]]


def test_dedup_keeps_first_occurrence(spark):
    rows = [(2, 0, "the same line of text here"), (1, 5, "the same line of text here"),
            (1, 7, "The Same line of text here!")]
    lines = spark.createDataFrame(rows, "doc_id long, line_pos long, raw string")
    got = tx.clean_lines(lines).collect()
    assert [(r["doc_id"], r["line_pos"]) for r in got] == [(1, 5)]


def test_vocabulary_tie_to_first_seen(spark):
    lines = spark.createDataFrame([(0, 0, "b a b a c")], "doc_id long, line_pos long, text string")
    top = tx.top_vocab(tx.tokenize(lines), 2).orderBy("rank").collect()
    assert [(r["rank"], r["token"], r["n"]) for r in top] == [(1, "b", 2), (2, "a", 2)]


def test_counters(spark):
    lines = lines_df(spark, ["", "a line that is long enough", "a line that is long enough", "short"])
    c = tx.clean_counters(lines).first()
    assert (c["total_lines"], c["nonblank_lines"], c["long_lines"], c["kept_lines"]) == (4, 3, 2, 1)


def test_lemmatize_with_lexicon(spark):
    lines = spark.createDataFrame([(0, 0, "cats run fast")], "doc_id long, line_pos long, text string")
    tb = spark.createDataFrame([("cats", "cat", 1), ("Cats", "cats", 2), ("cats", "cat", 3)],
                               "form string, lemma string, ord long")
    lex = tx.lemma_lexicon(tb)
    assert tx.lexicon_lemmatize(lines, lex).first()["text"] == "cat run fast"
