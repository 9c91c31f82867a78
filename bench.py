"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query runs once to warm up, then $BENCH_REPEATS times; the median counts
(those at the published size run once, without a warm-up).
Results are forced with the no-op sink (the whole plan runs, nothing is
collected).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from lexiclust.operators import kmeans as km  # noqa: E402
from lexiclust.operators.vectors import l2_normalize  # noqa: E402
from lexiclust.plans import registry  # noqa: E402
from lexiclust.plans.inputs import Inputs  # noqa: E402
from lexiclust.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def _sink(df):
    df.write.format("noop").mode("overwrite").save()


def kmeans_k200(spark, sf_dir):
    """The reference's unit of work: spherical k-means, K=200, to convergence
    (at most 100 rounds), then the final assignment."""
    vs = l2_normalize(Inputs(spark, sf_dir).embedding_vectors())
    fit = km.spherical_kmeans(vs, [200], seed=42, max_iter=100)
    return km.predict(vs, fit.centroids)


def kmeans_grid(spark, sf_dir):
    """M5: the reference's K grid (all feasible K) sharing each pass."""
    vs = Inputs(spark, sf_dir).embedding_vectors()
    return km.cluster_grid(vs, km.DEFAULT_K_VALUES, method="parallel").assignments


def kmeans_lloyd_k200(spark, sf_dir):
    vs = l2_normalize(Inputs(spark, sf_dir).embedding_vectors())
    model = km.lloyd_kmeans(vs, 200, seed=42, max_iter=100, n_init=10)
    return km.model_labels(model, vs)


PUBLISHED_WORDS, PUBLISHED_DIM = 21_856, 300


def _published_size(spark, sf_dir):
    """``embeddings`` repeated and shifted to the published size: copy r of a
    vector takes its components at other places, so no two rows are alike."""
    vs = Inputs(spark, sf_dir).embedding_vectors()
    d, n = len(vs.first()["vec"]), vs.count()
    copies = vs.crossJoin(spark.range(-(-PUBLISHED_WORDS // n)).withColumnRenamed("id", "r"))
    places = F.sequence(F.lit(0), F.lit(PUBLISHED_DIM - 1))
    at = lambda i, step, shift: F.get("vec", ((i * step + F.col("r") * shift) % d).cast("int"))
    vec = F.transform(places, lambda i: at(i, 1, 3) + 0.5 * at(i, 5, 1) * at(i, 7, 11) * d)
    rank = F.col("r") * n + F.col("rank")
    rows = copies.select("slug", rank.alias("rank"), rank.cast("string").alias("word"), vec.alias("vec"))
    return l2_normalize(rows.filter(F.col("rank") < PUBLISHED_WORDS))


_BUILT: dict = {}


def _published_vectors(spark, sf_dir):
    """The vectors written once and read by every run: what is timed starts at
    a stored vector set, as the published times do."""
    if sf_dir not in _BUILT:
        path = os.path.join(tempfile.mkdtemp(prefix="lexiclust-bench-"), "vectors")
        _published_size(spark, sf_dir).write.parquet(path)
        _BUILT[sf_dir] = path
    return spark.read.parquet(_BUILT[sf_dir])


def _fitted(fit):
    print(f"#   iterations: {fit.iterations}", file=sys.stderr)
    return fit.centroids


def kmeans_published_k200(spark, sf_dir):
    """Spherical k-means at 21,856 x 300, K=200, to convergence."""
    vs = _published_vectors(spark, sf_dir)
    return km.predict(vs, _fitted(km.spherical_kmeans(vs, [200], seed=42, max_iter=100)))


def kmeans_published_k2000(spark, sf_dir):
    """The same with K=2,000."""
    vs = _published_vectors(spark, sf_dir)
    return km.predict(vs, _fitted(km.spherical_kmeans(vs, [2000], seed=42, max_iter=100)))


def lloyd_published_k200(spark, sf_dir):
    """Lloyd's method at 21,856 x 300, K=200, best of ten starts."""
    vs = _published_vectors(spark, sf_dir)
    model = km.lloyd_kmeans(vs, 200, seed=42, max_iter=100, n_init=10)
    _fitted(model)
    return km.model_labels(model, vs)


BENCH = {
    "kmeans_k200": kmeans_k200,
    "kmeans_published_k200": kmeans_published_k200,
    "kmeans_published_k2000": kmeans_published_k2000,
    "lloyd_published_k200": lloyd_published_k200,
    "kmeans_grid": kmeans_grid,
    "kmeans_lloyd_k200": kmeans_lloyd_k200,
}
for _name in ("clean_lines", "clean_counters", "top_vocab", "context_vectors",
              "label_metrics", "cluster_stats", "alignment", "best_run"):
    if _name in registry.queries():
        BENCH[_name] = registry.queries()[_name]


def main():
    names = sys.argv[1:] or list(BENCH)
    spark = build_session(master=f"local[{CPUS}]", shuffle_partitions=int(CPUS))
    timings = {}
    for name in names:
        fn = BENCH[name]
        spark.catalog.clearCache()
        once = "published" in name  # long runs: timed once, cold
        if once:
            _published_vectors(spark, SF_DIR)  # built before the clock starts
        if not once:
            _sink(fn(spark, SF_DIR))  # warm-up
        runs = []
        for _ in range(1 if once else REPEATS):
            spark.catalog.clearCache()  # no reuse of inputs cached by an earlier run
            t0 = time.time()
            _sink(fn(spark, SF_DIR))
            runs.append(time.time() - t0)
        timings[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "median_query_seconds_sum",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(CPUS),
        "repeats": REPEATS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
