"""Centroids beyond the broadcast bound, partial sums beyond the direct one, and
projections of whole clusters."""

import numpy as np
import pytest

from helpers import vectors_df
from lexiclust.operators import explore
from lexiclust.operators import kmeans as km
from lexiclust.operators import vectors as vec


def _random_set(spark, n=300, d=4):
    x = np.round(np.random.default_rng(5).normal(size=(n, d)), 1)  # with ties
    return x, vectors_df(spark, [(f"w{i}", row) for i, row in enumerate(x)])


def test_centroid_blocks_give_the_labels_of_one_broadcast(spark):
    x, vs = _random_set(spark)
    C = np.concatenate([x[:20], x[:5]])  # repeated centroids: the lowest id wins
    whole = {r["word"]: r["cluster"] for r in vec.nearest_centroid(vs, C).collect()}
    for max_bytes in (1, 4 * 8 * 3, 4 * 8 * 24):
        part = vec.nearest_centroid(vs, C, max_bytes=max_bytes)
        assert part.columns == [*vs.columns, "cluster"]
        assert {r["word"]: r["cluster"] for r in part.collect()} == whole
    assert max(whole.values()) < 20


@pytest.mark.parametrize("bound,direct", [(4 * 8 * 3, 1 << 26), (1 << 29, 0)])
def test_bounds_do_not_change_the_fit(spark, monkeypatch, bound, direct):
    _, vs = _random_set(spark)
    want = km.spherical_kmeans(vec.l2_normalize(vs), [5, 9], max_iter=4)
    labels = sorted(map(tuple, km.predict(vs, want.centroids).collect()))
    monkeypatch.setattr(km, "MAX_CENTROID_BYTES", bound)
    monkeypatch.setattr(vec, "MAX_CENTROID_BYTES", bound)
    monkeypatch.setattr(km, "DIRECT_BYTES", direct)
    got = km.spherical_kmeans(vec.l2_normalize(vs), [5, 9], max_iter=4)
    for k in (5, 9):
        assert np.allclose(got.centroids[k], want.centroids[k], atol=1e-12)
    assert sorted(map(tuple, km.predict(vs, got.centroids).collect())) == labels


def test_projection_equals_a_singular_value_decomposition(spark):
    x, vs = _random_set(spark, 60)
    runs = spark.createDataFrame([("s", "m", 3, f"w{i}", 0 if i < 40 else 1 if i < 59 else 2)
                                  for i in range(60)],
                                 "slug string, method string, k int, word string, cluster int")
    got = {(r["cluster"], r["word"]): (r["x"], r["y"])
           for r in explore.project_2d(runs, vs, normed=False, n=None).collect()}
    assert len(got) == 60 and got[2, "w59"] == (0.0, 0.0)
    for cluster, rows in ((0, range(40)), (1, range(40, 59))):
        centred = x[list(rows)] - x[list(rows)].mean(0)
        _, _, vt = np.linalg.svd(centred, full_matrices=False)
        axes = [v if v[np.abs(v).argmax()] > 0 else -v for v in vt[:2]]
        have = np.array([got[cluster, f"w{i}"] for i in rows])
        assert np.allclose(have, centred @ np.array(axes).T, atol=1e-6)  # the vectors are single precision
