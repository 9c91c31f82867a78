import os

from lexiclust.operators import align, clusterstats as cs, runs as rn
from lexiclust.operators import text as tx


def test_text_results_do_not_depend_on_partitioning(spark):
    rows = [(d, i, f"line {(d * 7 + i) % 5} of the shared corpus text") for d in range(30) for i in range(4)]
    lines = spark.createDataFrame(rows, "doc_id long, line_pos long, raw string")
    one = tx.clean_lines(lines.coalesce(1))
    many = tx.clean_lines(lines.repartition(7))
    assert sorted(one.collect()) == sorted(many.collect())
    v1 = tx.top_vocab(tx.tokenize(one), 3).orderBy("rank").collect()
    v2 = tx.top_vocab(tx.tokenize(many), 3).orderBy("rank").collect()
    assert v1 == v2


STATS = """cid,size,suffix2,suffix2_purity,suffix3,suffix3_purity,suffix4,suffix4_purity,max_suffix_purity,top_pos,pos_purity,pos_entropy,pos_coverage,msi
0,20,,0.0,,0.0,,0.0,0.0,,0.0,0.0,0.0,0.0
1,30,ка,0.5,ска,0.25,вска,0.1,0.5,NOUN,1.0,-3.5e-13,0.1,0.5
"""

ALIGN = """cid_a,cid_b,centroid_cosine,jaccard,size_a,size_b
146,12,0.9,0.2,10,12
147,103,0.95138854,0.3,20,22
"""


def test_stats_and_alignment_tables_from_files(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "metrics")
    os.makedirs(folder)
    with open(os.path.join(folder, "cluster_stats_trained-mk_skipgram_parallel_K200.csv"), "w") as f:
        f.write(STATS)
    with open(os.path.join(folder, "cluster_stats_other_K5.csv"), "w") as f:
        f.write(STATS)
    with open(os.path.join(folder, "alignment_trained-mk_skipgram_serial__trained-mk_skipgram_parallel_K200.csv"),
              "w") as f:
        f.write(ALIGN)
    st = rn.read_stats_tables(spark, folder)
    rows = {r["cid"]: r for r in st.collect()}
    assert set(rows) == {0, 1}  # the file without a method in its name is skipped
    assert rows[0]["suffix2"] == "" and rows[0]["top_pos"] == ""  # empty strings stay strings
    assert rows[1]["slug"] == "trained-mk_skipgram" and rows[1]["method"] == "parallel" and rows[1]["k"] == 200
    mm = cs.macro_means(st).first()
    assert abs(mm["msi_mean"] - 0.25) < 1e-12 and abs(mm["suffix_mean"] - 0.25) < 1e-12
    al = rn.read_alignments(spark, folder)
    m = align.matched_cluster(al, 147).first()
    assert m["cid_b"] == 103 and abs(m["centroid_cosine"] - 0.95138854) < 1e-12
    summ = align.alignment_summary(al).first()
    assert summ["K"] == 200 and summ["pairs"] == 2
    assert abs(summ["median_centroid_cosine"] - (0.9 + 0.95138854) / 2) < 1e-12


def _lines(spark, **files):
    rows = [(f"{name}.csv", i, line) for name, text in files.items() for i, line in enumerate(text.splitlines())]
    return spark.createDataFrame(rows, "file string, line_no long, line string")


def test_tables_are_read_by_their_own_headers(spark):
    lines = _lines(
        spark,
        cluster_stats_a_serial_K2="cluster,MSI (pos-suf),max-suffix-purity,pos-purity\n0,0.5,0.25,0.75\n1,,0.1,0.3",
        cluster_stats_b_serial_K3="pos_coverage,cid,suffix_purity,pos_purity,size\n0.9,2,0.4,1.0,7\n,1,,,\n")
    got = {(r["slug"], r["cid"]): r for r in rn.parse_stats_tables(lines).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 2), ("b", 1)}
    assert got["a", 0]["msi"] == 0.5 and got["a", 0]["max_suffix_purity"] == 0.25
    assert abs(got["a", 1]["msi"] - 0.2) < 1e-12  # derived
    assert (got["b", 2]["size"], got["b", 2]["pos_coverage"], got["b", 2]["k"]) == (7, 0.9, 3)
    assert abs(got["b", 2]["msi"] - 0.6) < 1e-12 and got["b", 1]["msi"] is None


def test_alignment_columns_in_any_order(spark):
    lines = _lines(spark, alignment_a__b_K2="cid_a,cid_b,jaccard,cosine\n0,1,0.1,0.9")
    r = rn.parse_alignments(lines).first()
    assert (r["k"], r["centroid_cosine"], r["jaccard"], r["size_a"]) == (2, 0.9, 0.1, None)


def test_safe_slug(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a b/c:d.vec",), ("ok-1_2",)], "n string")
    assert [r[0] for r in df.select(rn.safe_slug(F.col("n"))).collect()] == ["a-b-c-d.vec", "ok-1_2"]


def test_runs_written_one_after_the_other_stay(spark, tmpdir_path):
    from lexiclust.sources import sinks
    schema = "slug string, method string, k int, word string, cluster int"
    run = "vecslug string, K int, method string, secs double"
    for k, secs in ((2, 1.0), (3, 2.0), (2, 4.0)):  # the last one replaces the first
        asg = spark.createDataFrame([("s", "m", k, f"w{i}", i % k) for i in range(4)], schema)
        sinks.write_run(asg, spark.createDataFrame([("s", k, "m", secs)], run), tmpdir_path)
    asg, runs = rn.read_written_runs(spark, tmpdir_path)
    assert {(r["k"], r["count"]) for r in asg.groupBy("k").count().collect()} == {(2, 4), (3, 4)}
    assert {(r["K"], r["secs"]) for r in runs.collect()} == {(2, 4.0), (3, 2.0)}


def test_cluster_words_in_order(spark, tmpdir_path):
    from lexiclust.sources import sinks
    rows = [("s", "m", 2, f"w{i:03}", i % 2, 100 - i) for i in range(60)]
    df = spark.createDataFrame(rows, "slug string, method string, k int, word string, cluster int, rank int")
    sinks.write_cluster_words(df.repartition(5), tmpdir_path + "/words")
    folder = tmpdir_path + "/words/slug=s/method=m/k=2/cluster=1"
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    words = [x for p in parts for x in open(os.path.join(folder, p)).read().split()]
    assert words == [f"w{i:03}" for i in range(59, 0, -2)]
