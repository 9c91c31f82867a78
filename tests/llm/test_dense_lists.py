"""Lists of near copies counted as matrices."""

import random
import tracemalloc

import numpy as np

from lexiclust.llm import neardup


def test_components_of_sets_equal_brute_force():
    rng = np.random.default_rng(4)
    for n, edits in ((1, 2), (40, 6), (150, 40), (90, 90)):
        whole = np.arange(200)
        sets = []
        for _ in range(n):
            gone = rng.choice(200, size=rng.integers(0, edits), replace=False)
            fresh = rng.integers(1000, 1300, size=len(gone))
            sets.append(np.unique(np.concatenate([np.delete(whole, gone), fresh])))
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a in range(n):
            for b in range(a):
                m = len(np.intersect1d(sets[a], sets[b]))
                if 100 * m >= 85 * (len(sets[a]) + len(sets[b]) - m):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        assert neardup.components_of(sets, 85).tolist() == [find(i) for i in range(n)]


def test_counted_lists_give_the_components_of_paired_ones(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(70):
        said = list(base)
        for _ in range(rng.randint(0, 4)):
            said[rng.randrange(90)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(said)))
    rows.append((3, "another text under an id that has one"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, neardup.near_duplicates(df).collect()))
    monkeypatch.setattr(neardup, "DENSE_PAIRS", 0)
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == want
    monkeypatch.setattr(neardup, "DENSE_PAIRS", 10**9)
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == want
    assert 1 < len({r[2] for r in want}) < 60


def test_counting_a_list_holds_one_square_of_bytes():
    rng = np.random.default_rng(5)
    n = 2000
    sets = [np.unique(np.concatenate([np.arange(50), rng.integers(100, 1000, 4)])) for _ in range(n)]
    tracemalloc.start()
    root = neardup.components_of(sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all()
    assert peak < 16 * n * n
