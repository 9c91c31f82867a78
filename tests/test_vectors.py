import numpy as np
from pyspark.sql import functions as F

from helpers import vectors_df
from lexiclust.operators import kmeans as km
from lexiclust.operators import vectors as vo


def test_zero_vector_stays_zero(spark):
    vs = vectors_df(spark, [("z", [0, 0]), ("a", [3, 4])])
    got = {r["word"]: r["vec"] for r in vo.l2_normalize(vs).collect()}
    assert got["z"] == [0.0, 0.0]
    assert np.allclose(got["a"], [0.6, 0.8])


def test_restrict_keeps_listed_words_and_falls_back(spark):
    vs = vectors_df(spark, [("a", [1, 0]), ("b", [0, 1]), ("c", [1, 1])])
    lst = spark.createDataFrame([("b",), ("c",), ("x",)], "token string")
    assert sorted(r["word"] for r in vo.restrict_to_vocab(vs, lst).collect()) == ["b", "c"]
    none = spark.createDataFrame([("x",)], "token string")
    assert vo.restrict_to_vocab(vs, none).count() == 3
    empty = spark.createDataFrame([], "token string")
    assert vo.restrict_to_vocab(vs, empty).count() == 3
    assert vo.restrict_to_vocab(vs, None).count() == 3


def test_nearest_ties_to_lowest_id():
    X = np.array([[0.0, 0.0], [1.0, 0.0]])
    C = np.array([[1.0, 1.0], [1.0, -1.0], [1.0, 1.0]])
    assert list(vo.nearest(X, C)) == [0, 0]


def test_nearest_matches_brute_force():
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(300, 8))
    C = rnd.normal(size=(13, 8))
    brute = ((X[:, None, :] - C[None]) ** 2).sum(2).argmin(1)
    assert (vo.nearest(X, C, block=50) == brute).all()


def test_cap_rank_and_feasible_k(spark):
    vs = vectors_df(spark, [(f"w{i}", [i, 1]) for i in range(5)])
    assert vo.cap_rank(vs, 3).count() == 3
    assert sorted(r["k"] for r in vo.feasible_k(vs, [2, 5, 6]).collect()) == [2, 5]


def test_empty_cluster_takes_a_data_row(spark):
    # two equal start rows: one cluster stays empty and must be refilled
    rows = [("a", [1, 0]), ("b", [1, 0]), ("c", [0, 1]), ("d", [0.1, 1])]
    vs = vectors_df(spark, rows)
    fit = km.spherical_kmeans(vs, [3], seed=1, max_iter=3, stop_early=False)
    C = fit.centroids[3]
    assert np.allclose(np.linalg.norm(C, axis=1), 1.0, atol=1e-9)
    assert not np.isnan(C).any()


def _objective(X, C, lab):
    return float(((X - C[lab]) ** 2).sum())


def test_spherical_kmeans_invariants(spark):
    rnd = np.random.default_rng(5)
    X = rnd.normal(size=(120, 6))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    vs = vectors_df(spark, [(f"w{i}", list(x)) for i, x in enumerate(X)]).repartition(3)
    fit = km.spherical_kmeans(vs, [4, 7], seed=3, max_iter=30)
    for k, C in fit.centroids.items():
        assert C.shape == (k, 6)
        assert np.allclose(np.linalg.norm(C, axis=1), 1.0, atol=1e-9)
        lab = km.predict(vs, {k: C}).orderBy("rank").select("cluster").collect()
        lab = np.array([r[0] for r in lab])
        assert (lab == vo.nearest(X, C)).all()
        assert 1 <= fit.iterations[k] <= 30


def test_partition_independence(spark):
    rnd = np.random.default_rng(9)
    X = rnd.normal(size=(80, 5))
    rows = [(f"w{i}", list(x)) for i, x in enumerate(X)]
    one = vectors_df(spark, rows).coalesce(1)
    many = vectors_df(spark, rows).repartition(7)
    a = km.spherical_kmeans(one, [5], seed=2, max_iter=4, stop_early=False).centroids[5]
    b = km.spherical_kmeans(many, [5], seed=2, max_iter=4, stop_early=False).centroids[5]
    assert np.allclose(a, b, atol=1e-12)


def test_centroid_mean_with_empty_cluster(spark):
    vs = vectors_df(spark, [("a", [2, 0]), ("b", [0, 3])])
    asg = spark.createDataFrame([("s", "m", 3, "a", 0), ("s", "m", 3, "b", 0), ("s", "m", 3, "zz", 2)],
                                "slug string, method string, k int, word string, cluster int")
    kof = spark.createDataFrame([("s", "m", 3, 3)], "slug string, method string, k int, k_total int")
    got = {r["cid"]: r for r in vo.centroid_mean(asg, vs, kof).collect()}
    assert sorted(got) == [0, 1, 2]
    assert np.allclose(got[0]["centroid"], [2 ** -0.5, 2 ** -0.5])
    assert got[1]["centroid"] == [0.0, 0.0] and got[2]["n_words"] == 0


def test_lloyd_and_baseline_run(spark):
    rnd = np.random.default_rng(1)
    X = np.vstack([rnd.normal(loc=c, scale=0.05, size=(20, 2)) for c in ([0, 1], [1, 0], [-1, 0])])
    vs = vectors_df(spark, [(f"w{i}", list(x)) for i, x in enumerate(X)])
    model = km.lloyd_kmeans(vs, 3, n_init=2)
    labels = [r["cluster"] for r in km.model_labels(model, vs).orderBy("rank").collect()]
    assert len(set(labels[:20])) == 1 and len(set(labels)) == 3
    means = np.array([X[np.array(labels) == c].mean(0) for c in range(3)])
    assert np.allclose(means, model.centroids, atol=1e-4)
    assert abs(model.cost - ((X - means[labels]) ** 2).sum()) < 1e-3
    _, C = km.baseline_kmeans(vs, 3)
    assert np.allclose(np.linalg.norm(C, axis=1), 1.0)


def test_cluster_grid_skips_infeasible_k(spark):
    vs = vectors_df(spark, [(f"w{i}", [np.cos(i), np.sin(i)]) for i in range(6)])
    res = km.cluster_grid(vs, [2, 3, 10], method="parallel", max_iter=5)
    assert sorted(r["K"] for r in res.runs.collect()) == [2, 3]
    assert res.assignments.filter(F.col("k") == 3).count() == 6


def test_cluster_grid_methods_and_run_rows(spark):
    vs = vectors_df(spark, [(f"w{i}", [np.cos(i), np.sin(i)]) for i in range(8)])
    for method in ("serial", "sklearn"):
        res = km.cluster_grid(vs, [2, 3], method=method, max_iter=5, max_words=6, vec_path="x/s.vec")
        run = res.runs.first()
        assert (run["method"], run["N"], run["vec"], run["max_words"]) == (method, 6, "x/s.vec", "6")
        assert res.assignments.filter("k = 2").count() == 6


def test_centroid_mean_counts_a_word_in_each_of_its_clusters(spark):
    vs = vectors_df(spark, [("a", [1, 0]), ("b", [0, 1])])
    asg = spark.createDataFrame([("s", "m", 2, "a", 0), ("s", "m", 2, "a", 1), ("s", "m", 2, "b", 1),
                                 ("s", "m", 2, "b", 1)],
                                "slug string, method string, k int, word string, cluster int")
    got = {r["cid"]: (r["n_words"], r["centroid"]) for r in vo.centroid_mean(asg, vs).collect()}
    assert got[0][0] == 1 and got[1][0] == 2
    assert np.allclose(got[1][1], [2 ** -0.5, 2 ** -0.5])
