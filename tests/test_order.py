"""First occurrences by one packed number, and logs that repeat a path."""

import pytest
from pyspark.sql import functions as F

from lexiclust.operators import labels as lb
from lexiclust.operators import runs as rn
from lexiclust.operators import text as textops
from lexiclust.operators.numbering import packed_order

BIG = (1 << 63) - 1


@pytest.mark.parametrize("rows, kind", [
    ([(5, 9, 2), (-5, 7, 1), (-5, 7, 0), (8, 0, 3)], "bigint"),
    ([(5, 9, 2), (-BIG, 7, 1), (-BIG, 6, BIG >> 32), (BIG >> 1, 0, 3)], "decimal(38,0)"),
    ([(BIG, BIG, BIG), (-BIG, 0, 1), (-BIG, 0, 0), (0, 0, 0)], "struct"),
    ([(None, 9, 2), (4, None, 1), (None, 3, 0), (4, 1, None)], "struct")])
def test_packed_places_keep_their_order_and_come_back(spark, rows, kind):
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3)
    packed, unpacked = packed_order(df, ["a", "b", "c"])
    numbers = df.select("a", "b", "c", packed.alias("p"))
    assert numbers.schema["p"].dataType.simpleString().startswith(kind)
    back = numbers.select("a", "b", "c", "p", unpacked(F.col("p")).alias("u"))
    assert all((r.a, r.b, r.c) == tuple(r.u) for r in back.collect())
    by_place = [tuple(r) for r in numbers.orderBy("a", "b", "c").select("a", "b", "c").collect()]
    assert [tuple(r) for r in numbers.orderBy("p").select("a", "b", "c").collect()] == by_place


def test_first_occurrences_are_hash_aggregated(spark):
    rows = [(d, n, p, t) for d, n, p, t in [(2, 0, 0, "a"), (1, 5, 1, "a"), (1, 4, 7, "a"), (3, 0, 0, "b")]]
    tokens = spark.createDataFrame(rows, "doc_id long, line_pos long, tok_pos long, token string")
    counts = textops.token_counts(tokens)
    assert {(r.token, r.n, tuple(r["first"])) for r in counts.collect()} == {("a", 3, (1, 4, 7)), ("b", 1, (3, 0, 0))}
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_word_map_counts_forms_and_lemmas_of_equal_rows(spark):
    rows = [("Cats", "cat", "N"), ("cat", "cat", "V"), ("cat", "cat", "V"), ("cats", "cat", "N"), ("cats", "cat", "N"),
            ("dog", "dog", "V"), ("Dog", "dog", "N"), (None, "x", "N"), ("x", None, None)]
    tb = spark.createDataFrame([(*r, (1, n)) for n, r in enumerate(rows)],
                               "form string, lemma string, upos string, ord struct<doc_id: long, line_pos: long>")
    got = {r.word: r.upos for r in lb.word_pos_map(tb).collect()}
    assert got == {"cats": "N", "cat": "V", "dog": "V", "x": "N", None: "N"}  # a tie goes to the first seen
    assert {r.word: r.upos for r in lb.lemma_pos_map(tb).collect()} == {"cat": "N", "dog": "V", "x": "N"}


def test_a_log_stays_one_row_from_its_text_to_its_values(spark):
    logs = spark.createDataFrame(
        [("p", "K=1\nsecs=2\nsecs=3.5\nvec=a"), ("p", "K=7"), ("q", "no key"), (None, "K=4\r\nmethod = x = y "),
         ("none", None)], "log_path string, text string")
    runs = rn.parse_run_logs(logs)
    got = {r.log_path: (r.K, r.secs, r.vec, r.method) for r in runs.collect()}
    assert got.keys() == {"p", "q", None} and got["p"][1:3] == (3.5, "a") and got["p"][0] in (1, 7)
    assert got[None][0] == 4 and got[None][3] == "x = y" and got["q"][0] == 0
    assert "Generate" not in runs._jdf.queryExecution().executedPlan().toString()
