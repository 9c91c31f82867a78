import math
import os

from lexiclust.operators import runs as rn


def test_run_log_rules(spark):
    text = "\n".join(["K=200", "K=400", "method = parallel ", "secs=abc", "num_cores=",
                      "vec=a=b", "normed=Yes", "no equals sign here", "iterations=5.0"])
    logs = spark.createDataFrame([("p1", text), ("p2", "secs=1.5\nmethod=serial")], "log_path string, text string")
    got = {r["log_path"]: r for r in rn.parse_run_logs(logs).collect()}
    r = got["p1"]
    assert r["K"] == 400 and r["method"] == "parallel" and math.isnan(r["secs"])
    assert r["num_cores"] == 0 and r["vec"] == "a=b" and r["normed"] == 1 and r["iterations"] == 0
    assert got["p2"]["secs"] == 1.5 and got["p2"]["K"] == 0
    best = rn.best_run(rn.parse_run_logs(logs)).collect()
    assert [b["log_path"] for b in best] == ["p2"]


def test_speedup_golden(spark):
    logs = spark.createDataFrame(
        [("a", "vecslug=trained-mk_lemma_skipgram\nK=2000\nmethod=serial\nsecs=215.63"),
         ("b", "vecslug=trained-mk_lemma_skipgram\nK=2000\nmethod=parallel\nsecs=28.62"),
         ("c", "vecslug=trained-mk_lemma_skipgram\nK=2000\nmethod=parallel\nsecs=30.0")],
        "log_path string, text string")
    piv = rn.runtime_pivot(rn.best_run(rn.parse_run_logs(logs)), ["serial", "parallel"])
    r = rn.speedup(piv).first()
    assert abs(r["speedup"] - 7.5342417890) < 1e-9


def test_read_runs_from_files(spark, tmpdir_path):
    for method, secs in (("serial", "3.5"), ("parallel", "1.25")):
        d = os.path.join(tmpdir_path, "clusters", "slug", method, "K10")
        os.makedirs(d)
        with open(os.path.join(d, "run.log"), "w") as f:
            f.write(f"vecslug=slug\nK=10\nmethod={method}\nsecs={secs}\n")
    runs = rn.read_runs(spark, os.path.join(tmpdir_path, "clusters"))
    assert sorted((r["method"], r["secs"]) for r in runs.collect()) == [("parallel", 1.25), ("serial", 3.5)]


def test_read_assignments_keeps_nan_words(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "runs", "slug", "parallel", "K3")
    os.makedirs(d)
    with open(os.path.join(d, "assignments.csv"), "w") as f:
        f.write("word,cluster\nnan,0\nnull,1\n,2\n")
    got = rn.read_assignments(spark, os.path.join(tmpdir_path, "runs")).collect()
    assert sorted(r["word"] for r in got) == ["", "nan", "null"]
    assert {r["k"] for r in got} == {3} and {r["method"] for r in got} == {"parallel"}


def test_slug_and_family(spark):
    df = spark.createDataFrame([("embeddings/baseline/cc.mk.300.vec.gz",), ("embeddings/trained/mk_lemma_skipgram.vec",),
                                ("x/mk_skipgram.bin",)], "p string")
    from pyspark.sql import functions as F
    got = [(r[0], r[1]) for r in df.select(rn.run_slug(F.col("p")).alias("s")).select(
        "s", rn.run_family(F.col("s"))).collect()]
    assert got == [("baseline-cc.mk.300", "baseline"), ("trained-mk_lemma_skipgram", "lemma"),
                   ("x-mk_skipgram", "raw")]


def test_metric_series_range(spark):
    df = spark.createDataFrame([("s", "m", 1, 0.5, None), ("s", "m", 2, 0.7, None)],
                               "vecslug string, method string, K int, purity double, silhouette double")
    rows = rn.metric_series(df).collect()
    assert {r["metric"] for r in rows} == {"purity"}
    r = rows[0]
    assert abs(r["lo"] - (0.5 - 0.2 * 0.06)) < 1e-12 and abs(r["hi"] - (0.7 + 0.2 * 0.06)) < 1e-12
