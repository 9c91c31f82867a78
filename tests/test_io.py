import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import lines_df
from lexiclust.operators import align, explore, runs
from lexiclust.operators import labels as lb
from lexiclust.operators import text as tx
from lexiclust.sources import sinks, text as src_text, vectors as sv


def test_vec_roundtrip_and_repeated_word(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "trained", "mk_skipgram.vec.gz")
    os.makedirs(os.path.dirname(path))
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("4 2\nа 0.5 0.25\nб 1 2 \nа 9 9\nnan 0 1\n")
    vs = sv.read_vectors(spark, path)
    got = {r["word"]: (r["rank"], r["vec"]) for r in vs.collect()}
    assert got["а"] == (0, [0.5, 0.25]) and got["б"][0] == 1 and got["nan"] == (2, [0.0, 1.0])
    assert vs.first()["slug"] == "trained-mk_skipgram"
    assert sv.read_vectors(spark, path, max_words=2).count() == 2
    assert sv.read_vectors(spark, path, max_words=3).count() == 3  # the repeated word is no third
    out = os.path.join(tmpdir_path, "out.vec")
    sv.write_vectors(vs, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    lines = [ln for p in parts for ln in open(os.path.join(out, p), encoding="utf-8").read().splitlines()]
    assert lines[0] == "3 2" and lines[1] == "а 0.500000 0.250000" and lines[-1] == "nan 0.000000 1.000000"


def test_missing_vector_file(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        sv.read_vectors(spark, os.path.join(tmpdir_path, "none.vec"))


def test_resolve_vectors(spark):
    catalog = sv.vector_catalog(spark, [
        "e/trained/mk_skipgram.vec", "e/trained/mk_lemma_skipgram.vec", "e/baseline/cc.mk.300.vec.gz",
        "e/trained/mk_cbow.vec"])
    pick = lambda *a: [r["path"] for r in sv.resolve_vectors(catalog, *a).collect()]
    assert pick("raw", "%skipgram") == ["e/trained/mk_skipgram.vec"]
    assert pick("raw") == ["e/trained/mk_cbow.vec"]
    assert pick("lemma") == ["e/trained/mk_lemma_skipgram.vec"]
    assert pick("baseline") == ["e/baseline/cc.mk.300.vec.gz"]
    assert pick("baseline", "%none%") == []
    assert sv.toplist_for("trained-mk_lemma_skipgram", {"lemma": "l.txt", "raw": "r.txt"}) == "l.txt"


CONLLU = """# sent_id = 1
# text = Тоа е на
1-2\tТоае\t_\t_\t_\t_\t_\t_\t_\t_
1\tТоа\tтоа\tPRON\t_\t_\t0\troot\t_\t_
2\tе\tсум\tAUX\t_\t_\t1\tcop\t_\t_
3\tна\tна\tADP\t_\t_\t1\tcase\t_\t_
3.1\tx\tx\tX\t_\t_\t_\t_\t_\t_

# sent_id = 2
1\tНа\tна\tADP\t_\t_\t0\troot\t_\t_
2\tкуќа\tкуќа\tNOUN\t_\t_\t1\tobj\t_\t_
"""


def test_read_treebank_and_maps(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "ud", "sub")
    os.makedirs(d)
    with open(os.path.join(d, "t.conllu"), "w", encoding="utf-8") as f:
        f.write(CONLLU)
    tb = lb.read_treebank(spark, os.path.join(tmpdir_path, "ud"))
    rows = tb.orderBy("ord").collect()
    assert [r["form"] for r in rows] == ["Тоа", "е", "на", "На", "куќа"]
    assert [r["sent"] for r in rows] == [0, 0, 0, 1, 1]
    wp = {r["word"]: r["upos"] for r in lb.word_pos_map(tb).collect()}
    assert wp["на"] == "ADP" and wp["тоа"] == "PRON" and wp["сум"] == "AUX"


def test_read_lines_toplist_and_head(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "corpus.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("first\n\nthird line\n  b  \n")
    lines = src_text.read_lines(spark, p)
    assert [r["raw"] for r in lines.orderBy("line_pos").collect()] == ["first", "", "third line", "  b  "]
    assert tx.head_lines(lines, 2).count() == 2
    top = src_text.read_toplist(spark, p)
    assert sorted(r["token"] for r in top.collect()) == ["b", "first", "third line"]


def test_files_and_sentences_in_order_of_path(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "bank")
    os.makedirs(os.path.join(d, "s b"))
    want = []
    for name, words in (("a.conllu", 3), ("s b/\u00e9.conllu", 5000), ("z.conllu", 2)):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            for i in range(words):
                f.write(f"1\tw{i}\tl\tX\n\n")
                want.append(f"w{i}")
    with open(os.path.join(d, "notes.txt"), "w", encoding="utf-8") as f:
        f.write("1\tnot\tread\tX\n")
    rows = lb.read_treebank(spark, d).orderBy("ord").collect()
    assert [r["form"] for r in rows] == want
    assert [r["sent"] for r in rows] == list(range(len(want)))  # across spans and files
    assert sorted({r["doc_id"] for r in rows}) == [0, 1, 2]
    empty = spark.createDataFrame([], "doc_id long, line_pos long, raw string")
    assert lb.parse_treebank(empty).count() == 0


def test_ordered_sinks(spark, tmpdir_path):
    lines = tx.clean_lines(lines_df(spark, ["the second line is here ok", "the first line is here too"]))
    out = os.path.join(tmpdir_path, "clean")
    sinks.write_lines(lines, out)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    text = [ln for p in parts for ln in open(os.path.join(out, p), encoding="utf-8").read().splitlines()]
    assert text == ["the second line is here ok", "the first line is here too"]
    with pytest.raises(sinks.InputError):
        sinks.require_rows(lines.filter("false"), "lines")


def test_input_guards(spark, tmpdir_path):
    with pytest.raises(sinks.InputError, match="missing input"):
        src_text.read_lines(spark, os.path.join(tmpdir_path, "none.txt"))
    with pytest.raises(sinks.InputError, match="missing cluster statistics"):
        runs.read_stats_tables(spark, tmpdir_path)
    with pytest.raises(sinks.InputError, match="missing alignments"):
        runs.read_alignments(spark, tmpdir_path)
    logs = spark.createDataFrame([("a/run.log", "vec=x.vec\nK=2"), ("b/run.log", "K=2")],
                                 "log_path string, text string")
    parsed = runs.parse_run_logs(logs)
    sinks.require_vector_paths(parsed.filter("log_path = 'a/run.log'"))
    with pytest.raises(sinks.InputError, match="missing vec= in b/run.log"):
        sinks.require_vector_paths(parsed)
    asg = spark.createDataFrame([("s", "m", 2, w, c) for w, c in [("x", 0), ("y", 0), ("z", 1), ("v", 1)]],
                                "slug string, method string, k int, word string, cluster int")
    vecs = spark.createDataFrame([("s", w, [1.0, float(n)]) for n, w in enumerate("xyz")],
                                 "slug string, word string, vec array<double>")
    assert explore.project_cluster(asg, vecs, 0).count() == 2
    with pytest.raises(sinks.InputError, match="cluster 9 not found"):
        explore.project_cluster(asg, vecs, 9)
    with pytest.raises(sinks.InputError, match="fewer than 2"):
        explore.project_cluster(asg, vecs, 1)
    with pytest.raises(sinks.InputError, match="side A"):
        align.alignment(asg.withColumn("word", F.lit("none")), asg, vecs)
    with pytest.raises(sinks.InputError, match="K mismatch"):
        align.run_pairs(asg, asg.withColumn("k", F.lit(3)))


def test_legend_and_table_order(spark):
    rows = [("wiki-raw", "sklearn"), ("wiki-lemma", "parallel"), ("wiki-lemma", "serial"),
            ("baseline-x", "parallel"), ("a-raw", "serial"), ("wiki-raw", "serial"), ("a-raw", "parallel"),
            ("a-raw", "parallel")]
    got = runs.legend_order(spark.createDataFrame(rows, "vecslug string, method string")).orderBy("place")
    assert [(r["vecslug"], r["method"]) for r in got.collect()] == [
        ("baseline-x", "parallel"), ("a-raw", "serial"), ("wiki-raw", "serial"), ("a-raw", "parallel"),
        ("wiki-lemma", "serial"), ("wiki-lemma", "parallel"), ("wiki-raw", "sklearn")]
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(5)
    placed = runs.table_order(df, ["a", "b"]).orderBy("place").collect()
    assert [(r["a"], r["b"]) for r in placed] == sorted((i % 7, i) for i in range(1000))
    assert [r["place"] for r in placed] == list(range(1, 1001))


def test_vector_matrix_from_arrow():
    import pyarrow as pa

    from lexiclust.operators.vectors import vec_matrix
    b = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))], names=["vec"])
    assert np.array_equal(vec_matrix(b), np.array([[1, 2], [3, 4]], dtype=float))


def test_treebank_lines_are_read_twice_and_meet_without_comments(spark):
    raw = ["# text = a b", "1\ta\ta\tX\t_", "1-2\t_\t_\t_\t_", "2\tb.c\tb-c\tY\t_", "short\trow", "", "",
           "# x", "1.1\tq\tq\tZ\t_", "3\td\td\tX\t_", None, "\tno id\tl\tX", "4#\te\te\tX"]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    rows = [(d, i * 3000, t) for d in (0, 1) for i, t in enumerate(raw)]
    lines = spark.createDataFrame(rows, "doc_id long, line_pos long, raw string")
    seen = lb.parse_treebank(lines.mapInArrow(counted, lines.schema))
    got = [(r.doc_id, r.sent, r.id, r.form, r.lemma, r.upos) for r in seen.orderBy("ord").collect()]
    assert got == [(d, 2 * d + s, *t.split("\t")[:4]) for d in (0, 1) for s, t in (
        (0, raw[1]), (0, raw[3]), (2, raw[9]), (2, raw[11]), (2, raw[12]))]
    assert reads.value <= 2 * len(rows)
    plan = lb.parse_treebank(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("StartsWith(raw")
