import math

from helpers import vectors_df
from lexiclust.operators import clusterstats as cs


def _asg(spark, rows):
    return spark.createDataFrame([("s", "m", 9, w, c) for w, c in rows],
                                 "slug string, method string, k int, word string, cluster int")


def _wmap(spark, rows):
    return spark.createDataFrame(rows, "word string, upos string")


def test_short_words_and_uncovered_cluster(spark):
    words = [("a", 0), ("b", 0), ("cat", 1), ("hat", 1), ("nan", 1), ("null", 1), ("zzzz", 1)]
    vs = vectors_df(spark, [(w, [1.0, 0.0]) for w, _ in words])
    st = {r["cid"]: r for r in cs.cluster_stats(_asg(spark, words), vs, _wmap(spark, [])).collect()}
    c0 = st[0]
    assert (c0["suffix2"], c0["suffix2_purity"], c0["suffix4"], c0["suffix4_purity"]) == ("", 0.0, "", 0.0)
    c1 = st[1]
    assert c1["size"] == 5  # 'nan' and 'null' are words, not missing values
    assert c1["suffix2"] == "at" and abs(c1["suffix2_purity"] - 2 / 5) < 1e-12
    assert c1["suffix3"] == "cat" and abs(c1["suffix3_purity"] - 1 / 5) < 1e-12
    assert c1["top_pos"] == "" and c1["pos_purity"] == 0.0 and not c1["pos_covered"]
    assert abs(c1["msi"] + c1["max_suffix_purity"]) < 1e-12


def test_one_tag_entropy_and_coverage(spark):
    words = [("Dog", 0), ("cat", 0), ("unknownword", 0)]
    vs = vectors_df(spark, [(w, [1.0, 0.0]) for w, _ in words[:2]])  # last word has no vector
    wm = _wmap(spark, [("dog", "NOUN"), ("cat", "NOUN"), ("unknownword", "VERB")])
    r = cs.cluster_stats(_asg(spark, words), vs, wm).first()
    assert r["size"] == 3 and r["top_pos"] == "NOUN" and r["pos_purity"] == 1.0
    assert abs(r["pos_entropy"] - (-math.log(1 + 1e-12) / math.log(17))) < 1e-20
    assert abs(r["pos_coverage"] - 2 / 3) < 1e-12


def test_suffix_tie_goes_to_first_word(spark):
    words = [("xab", 0), ("ycd", 0), ("zcd", 0), ("wab", 0)]
    vs = vectors_df(spark, [(w, [1.0]) for w, _ in words])
    r = cs.cluster_stats(_asg(spark, words), vs, _wmap(spark, [])).first()
    assert r["suffix2"] == "ab"


def _stats(spark, rows):
    return spark.createDataFrame(
        [("s", "m", 9, cid, size, pp, ms, pp - ms) for cid, size, pp, ms in rows],
        "slug string, method string, k int, cid int, size long, pos_purity double, "
        "max_suffix_purity double, msi double").selectExpr(
        "*", "'' as top_pos", "0.0 as pos_entropy", "0.0 as pos_coverage")


def test_extreme_cluster_ties_to_lowest_id(spark):
    st = _stats(spark, [(6, 20, 0.0, 1.0), (4, 20, 0.0, 1.0), (8, 20, 1.0, 0.0), (3, 20, 0.5, 0.2)])
    r = cs.extreme_cluster(st).first()
    assert (r["lowest_cid"], r["lowest_msi"], r["highest_cid"], r["highest_msi"]) == (4, -1.0, 8, 1.0)


def test_suggest_orders_and_filters(spark):
    st = _stats(spark, [(0, 10, 1.0, 0.0), (1, 20, 0.9, 0.1), (2, 20, 0.9, 0.05), (3, 30, 0.1, 0.9)])
    sem = [r["cid"] for r in cs.suggest_clusters(st, "semantic", 2).orderBy("pick").collect()]
    mor = [r["cid"] for r in cs.suggest_clusters(st, "morphological", 1).collect()]
    assert sem == [2, 1] and mor == [3]


def test_canonical_columns_derives_msi(spark):
    df = spark.createDataFrame([(1, 5, 0.4, 0.7)], "cluster int, size long, `max-suffix-purity` double, "
                                                  "`pos-purity` double")
    r = cs.canonical_columns(df).first()
    assert r["cid"] == 1 and abs(r["msi"] - 0.3) < 1e-12 and r["pos_entropy"] is None


def test_canonical_columns_of_all_spellings(spark):
    import pytest
    df = spark.createDataFrame([(3, 0.25, 0.75, 0.5)], "`Cluster ID` int, `Suffix-Purity (best)` double, "
                                                       "`POS Purity` double, `POS coverage` double")
    r = cs.canonical_columns(df).first()
    assert (r["cid"], r["max_suffix_purity"], r["pos_purity"], r["pos_coverage"]) == (3, 0.25, 0.75, 0.5)
    assert r["msi"] == 0.5 and r["size"] is None and r["pos_entropy"] is None
    with pytest.raises(ValueError):
        cs.canonical_columns(df.drop("POS Purity"))
    with pytest.raises(ValueError):
        cs.canonical_columns(df.drop("Cluster ID"))


def test_sample_words_of_zero_is_all(spark):
    asg = spark.createDataFrame([("s", "m", 1, f"w{i}", 0) for i in range(50)],
                                "slug string, method string, k int, word string, cluster int")
    assert cs.sample_words(asg, 0).count() == 50 and cs.sample_words(asg, 7).count() == 7
