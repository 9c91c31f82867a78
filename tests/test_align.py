import itertools

import numpy as np
import pytest

from helpers import vectors_df
from lexiclust.operators import align


def _sim_df(spark, S):
    k = S.shape[0]
    return spark.createDataFrame([(i, j, float(S[i, j])) for i in range(k) for j in range(k)],
                                 "cid_a int, cid_b int, sim double")


def _sequential_greedy(S):
    S = S.copy()
    out = []
    for _ in range(S.shape[0]):
        i, j = divmod(int(S.argmax()), S.shape[1])
        out.append((i, j))
        S[i, :] = -np.inf
        S[:, j] = -np.inf
    return sorted(out)


def test_greedy_equals_sequential_rule(spark):
    rnd = np.random.default_rng(11)
    for k in (3, 6, 9):
        S = np.round(rnd.uniform(-1, 1, size=(k, k)), 2)  # plenty of ties
        got = sorted((r["cid_a"], r["cid_b"]) for r in align.greedy_match(_sim_df(spark, S)).collect())
        assert got == _sequential_greedy(S)


def test_greedy_passes_stop_where_a_cut_list_ends(spark):
    rnd = np.random.default_rng(21)
    S = np.round(rnd.uniform(-1, 1, size=(12, 12)), 1)
    S[:, 0] += 1  # every row wants the same columns first
    S[:, 1] += 0.5
    for candidates in (1, 24, 40):  # lists of one column, of two, of three
        got = sorted((r["cid_a"], r["cid_b"])
                     for r in align.greedy_match(_sim_df(spark, S), candidates).collect())
        assert got == _sequential_greedy(S)


def test_greedy_chain_of_near_ties_takes_one_pass(spark, monkeypatch):
    """Each row's best column is its neighbour's second: rounds of mutual best
    pairs would settle one pair each."""
    k = 200
    S = np.zeros((k, k))
    for i in range(k):
        S[i, i] = 0.5 + 0.002 * i
        if i + 1 < k:
            S[i, i + 1] = S[i, i] + 0.001
    passes = []
    one_pass = align._greedy_pass
    monkeypatch.setattr(align, "_greedy_pass", lambda *a: passes.append(a) or one_pass(*a))
    got = sorted((r["cid_a"], r["cid_b"]) for r in align.greedy_match(_sim_df(spark, S)).collect())
    assert got == _sequential_greedy(S)
    assert len(passes) == 1


def test_optimal_equals_brute_force(spark):
    rnd = np.random.default_rng(12)
    for k in (2, 4, 6):
        S = rnd.uniform(-1, 1, size=(k, k))
        res = align.optimal_match(_sim_df(spark, S))
        pairs = sorted((r["cid_a"], r["cid_b"]) for r in res.matching.collect())
        assert sorted(i for i, _ in pairs) == list(range(k))
        assert sorted(j for _, j in pairs) == list(range(k))
        best = max(sum(round(S[i, p[i]] * 1e6) for i in range(k)) for p in itertools.permutations(range(k)))
        assert sum(round(S[i, j] * 1e6) for i, j in pairs) == best
        assert 0 <= res.gap < k + 1


def test_greedy_total_not_above_optimal(spark):
    rnd = np.random.default_rng(13)
    S = rnd.uniform(-1, 1, size=(7, 7))
    g = sum(r["sim"] for r in align.greedy_match(_sim_df(spark, S)).collect())
    o = sum(r["sim"] for r in align.optimal_match(_sim_df(spark, S)).matching.collect())
    assert g <= o + 1e-6


def _cent(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)],
                                 "cid int, centroid array<double>")


def test_k_mismatch_is_an_error(spark):
    with pytest.raises(ValueError):
        align.centroid_similarity(_cent(spark, [[1, 0], [0, 1]]), _cent(spark, [[1, 0], [0, 1], [1, 1]]))


def test_many_pairs_at_once(spark):
    """Three pairs with different K in one table: each as if it were alone."""
    rnd = np.random.default_rng(21)
    sims = {k: np.round(rnd.uniform(-1, 1, size=(k, k)), 2) for k in (2, 4, 6)}
    rows = [("s", "x", "s", "y", k, i, j, float(S[i, j]))
            for k, S in sims.items() for i in range(k) for j in range(k)]
    sim = spark.createDataFrame(rows, "slug_a string, method_a string, slug_b string, method_b string, "
                                      "k int, cid_a int, cid_b int, sim double")
    got, best = {}, {}
    for r in align.greedy_match(sim).collect():
        got.setdefault(r["k"], []).append((r["cid_a"], r["cid_b"]))
    for r in align.optimal_match(sim).matching.collect():
        best.setdefault(r["k"], []).append((r["cid_a"], r["cid_b"]))
    for k, S in sims.items():
        assert sorted(got[k]) == _sequential_greedy(S)
        assert sorted(i for i, _ in best[k]) == sorted(j for _, j in best[k]) == list(range(k))
        top = max(sum(round(S[i, p[i]] * 1e6) for i in range(k)) for p in itertools.permutations(range(k)))
        assert sum(round(S[i, j] * 1e6) for i, j in best[k]) == top


def test_alignment_of_two_k_keeps_runs_apart(spark):
    vs = vectors_df(spark, [(f"w{i}", [np.cos(i), np.sin(i)]) for i in range(12)])
    mk = lambda m, k, f: [("s", m, k, f"w{i}", f(i) % k) for i in range(12)]
    schema = "slug string, method string, k int, word string, cluster int"
    a = spark.createDataFrame(mk("x", 2, lambda i: i) + mk("x", 4, lambda i: i), schema)
    b = spark.createDataFrame(mk("y", 2, lambda i: i + 1) + mk("y", 4, lambda i: i // 3), schema)
    both = {(r["k"], r["cid_a"]): r for r in align.alignment(a, b, vs, method="greedy").collect()}
    assert sorted(both) == [(2, 0), (2, 1)] + [(4, i) for i in range(4)]
    for k in (2, 4):
        alone = align.alignment(a.filter(f"k = {k}"), b.filter(f"k = {k}"), vs, method="greedy")
        for r in alone.collect():
            assert both[k, r["cid_a"]] == r
    with pytest.raises(ValueError):
        align.alignment(a, b.filter("k = 2"), vs)


def test_alignment_end_to_end(spark):
    vs = vectors_df(spark, [("a", [1, 0]), ("b", [0.9, 0.1]), ("c", [0, 1]), ("d", [0.1, 0.9])])
    mk = lambda m, rows: spark.createDataFrame(
        [("s", m, 2, w, c) for w, c in rows], "slug string, method string, k int, word string, cluster int")
    a = mk("x", [("a", 0), ("b", 0), ("c", 1), ("d", 1)])
    b = mk("y", [("a", 1), ("b", 1), ("c", 0), ("d", 1)])
    out = {r["cid_a"]: r for r in align.alignment(a, b, vs).collect()}
    assert out[0]["cid_b"] == 1 and out[1]["cid_b"] == 0
    assert abs(out[0]["jaccard"] - 2 / 3) < 1e-12 and out[1]["jaccard"] == 0.5
    summ = align.alignment_summary(align.alignment(a, b, vs)).first()
    assert summ["pairs"] == 2
    assert align.matched_cluster(align.alignment(a, b, vs), 1).first()["cid_b"] == 0
