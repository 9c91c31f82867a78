import pytest
from pyspark.sql import functions as F

from lexiclust.operators import clusterstats as cs
from lexiclust.operators import text as tx
from lexiclust.session import bounded_broadcast, sharded_lookup


def test_table_beyond_the_limit_is_kept(spark):
    """It was dropped once measured and derived again by every join that read it."""
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    kept = bounded_broadcast(df, max_bytes=10)
    assert kept.storageLevel.useMemory and kept.storageLevel.useDisk
    assert "InMemoryTableScan" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 1000
    kept.unpersist()


@pytest.mark.parametrize("max_bytes,joins", [(1 << 20, 1), (800, 3), (10, 0)])
def test_sharded_lookup_is_a_left_join(spark, max_bytes, joins):
    rows = spark.range(300).select(F.concat(F.lit("w"), F.col("id") % 150).alias("token"), "id").unionByName(
        spark.createDataFrame([(None, 300)], "token string, id long"))
    table = spark.range(100).select(F.concat(F.lit("w"), "id").alias("token"), F.concat(F.lit("l"), "id").alias("lemma"))
    out = sharded_lookup(rows, table, "token", "lemma", max_bytes=max_bytes)
    assert str(out._jdf.queryExecution().optimizedPlan()).count("strategy=broadcast") == joins
    want = {(r.id, r.token, "l" + r.token[1:] if r.token and int(r.token[1:]) < 100 else None) for r in rows.collect()}
    assert {(r.id, r.token, r.lemma) for r in out.collect()} == want and out.count() == 301


def test_lemmas_meet_without_a_shuffle_of_tokens(spark):
    lines = spark.createDataFrame(
        [(0, 0, "cats ran  fast"), (0, 1, " dogs"), (0, 1, "ran ran"), (None, 2, "cats x"), (1, 0, ""), (1, 1, None)],
        "doc_id long, line_pos long, text string")
    lex = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("fast", "fast"), ("dogs", None)],
                                "form string, lemma string")
    out = tx.lexicon_lemmatize(lines, lex)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1  # the lines
    # rows that share a place are put together by token place, then lemma
    assert {(r.doc_id, r.line_pos, r.text) for r in out.collect()} == {
        (0, 0, "cat run fast"), (0, 1, "run dogs run"), (None, 2, "cat x")}


def test_profile_reads_the_map_once(spark):
    members = spark.createDataFrame([("s", "m", 2, 0, w, i) for i, w in enumerate("abcd")],
                                    "slug string, method string, k int, cid int, word string, rank long")
    tags = spark.createDataFrame([("a", "V"), ("b", "N"), ("c", "N"), ("x", "V")], "word string, upos string")
    out = cs.pos_profile(members, tags)
    assert out._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 1
    row = out.first()
    assert (row.top_pos, row.covered) == ("N", 3) and row.pos_purity == pytest.approx(2 / 3)
    assert row.pos_entropy == pytest.approx(0.636514 / 2.833213, abs=1e-5)
