"""Looking inside clusters.

All clusters of all runs are handled in one job. The 2-D projection aggregates
each cluster's moments, so no group of words is handed to one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiclust.functions import vector as V
from lexiclust.operators.clusterstats import sample_words, suggest_clusters
from lexiclust.operators.vectors import RUN_KEY, centroid_mean, known_words, vec_matrix
from lexiclust.session import bounded_broadcast
from lexiclust.sources.sinks import require_cluster, require_columns, require_rows

# Fixed values of the reference: words listed per cluster, words drawn per plot.
TOP_WORDS = 50
PLOT_WORDS = 40


def top_words(assignments: DataFrame, vectors: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """M10 (+W4): per cluster the ``n`` member words closest (cosine) to the
    unit mean of the members' raw vectors; ties keep file order (rank)."""
    members = known_words(assignments, vectors).join(
        vectors.select("slug", "word", "rank", "vec"), ["slug", "word"])
    kofr = assignments.select(*RUN_KEY).distinct().withColumn("k_total", F.col("k"))
    cent = centroid_mean(assignments, vectors, kofr, normalize_members=False, unit=True)
    cent = bounded_broadcast(cent.select(*RUN_KEY, F.col("cid").alias("cluster"), "centroid"))
    sims = members.join(cent, [*RUN_KEY, "cluster"]).select(
        *RUN_KEY, "cluster", "word", "rank",
        V.dot(V.l2_normalize("vec"), "centroid").alias("sim"))
    # cosines equal to 9 decimals are ties, kept in file order
    order = [F.desc(F.round("sim", 9)), F.asc("rank")]
    top = top_n_per_group(sims, [*RUN_KEY, "cluster"], order, n, salt_col="word")
    return top.select(*RUN_KEY, "cluster", F.col("place").cast("int").alias("place"), "word", "sim")


def top_n_per_group(df: DataFrame, keys: list[str], order: list, n: int, salt_col: str,
                    salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every group in ``order`` (adds ``place``).

    Two stages, so a group holding a third of all rows is not sorted in one
    task: the top ``n`` of each (group, salt) slice first, then the top ``n``
    among at most ``n * salts`` survivors per group."""
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt).withColumn("_p", F.row_number().over(w1))
              .filter(F.col("_p") <= n).drop("_p", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return stage1.withColumn("place", F.row_number().over(w2)).filter(F.col("place") <= n)


_GROUP = [*RUN_KEY, "cluster"]


def _moments(rows: DataFrame) -> DataFrame:
    """Per cluster the number of its vectors, their sum and the sum of their
    outer products: partial sums of every batch, merged by key."""
    def fn(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = vec_matrix(b)
            keys = list(zip(*(b.column(c).to_pylist() for c in _GROUP), strict=True))
            of_key: dict = {}
            for n, key in enumerate(keys):
                of_key.setdefault(key, []).append(n)
            made = [np.concatenate([[len(at)], x[at].sum(0), (x[at].T @ x[at]).ravel()])
                    for at in of_key.values()]
            columns = [pa.array(c, b.schema.field(g).type)
                       for c, g in zip(zip(*of_key, strict=True), _GROUP, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m.tolist() for m in made])],
                                             names=[*_GROUP, "m"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _GROUP)
    partial = rows.mapInArrow(fn, f"{schema}, m array<double>")
    return partial.groupBy(*_GROUP).agg(Summarizer.sum(array_to_vector("m")).alias("m")).select(
        *_GROUP, vector_to_array("m").alias("m"))


def principal_axes(rows: DataFrame) -> DataFrame:
    """Per cluster of ``rows`` (run, ``cluster``, ``vec``): ``mean`` and the first
    two principal ``axes`` of its centred vectors, by an eigen step on its D x D
    covariance. The largest loading of an axis is positive; a cluster without
    spread, or of one dimension, has zero axes for what is missing."""
    def fn(batches):
        for b in batches:
            out = []
            for m in b.column("m"):
                m = m.values.to_numpy()
                n, d = m[0], int(np.sqrt(len(m) - 0.75) - 0.5)  # 1 + d + d * d numbers
                mean = m[1:1 + d] / n
                value, vector = np.linalg.eigh(m[1 + d:].reshape(d, d) / n - np.outer(mean, mean))
                axes = np.zeros((2, d))
                for place, at in enumerate(np.argsort(value)[::-1][:2]):
                    if value[at] > 1e-12 * max(1.0, float(mean @ mean)):
                        v = vector[:, at]
                        axes[place] = v if v[np.abs(v).argmax()] > 0 else -v
                out.append((mean.tolist(), axes[0].tolist(), axes[1].tolist()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in _GROUP), *(pa.array(c, pa.list_(pa.float64()))
                                                   for c in (zip(*out, strict=True) if out else ([], [], [])))],
                names=[*_GROUP, "mean", "axis_1", "axis_2"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _GROUP)
    return _moments(rows).mapInArrow(
        fn, f"{schema}, mean array<double>, axis_1 array<double>, axis_2 array<double>")


def project_2d(assignments: DataFrame, vectors: DataFrame, normed: bool = True,
               n: int | None = PLOT_WORDS, seed: int = 42) -> DataFrame:
    """M9: per cluster, the members drawn by L5 (at most ``n``; None: all) that
    have a vector, projected on the first two principal axes of their centred
    (unit, when ``normed``) vectors: ``run, cluster, word, x, y``. Clusters of
    any size: their moments are aggregated, and only the axes are joined back."""
    drawn = assignments if n is None else sample_words(assignments, n, seed)
    vec = V.l2_normalize("vec") if normed else V.as_double("vec")
    rows = drawn.join(vectors.select("slug", "word", vec.alias("vec")), ["slug", "word"]).select(
        *RUN_KEY, F.col("cluster").cast("int").alias("cluster"), "word", "vec")
    placed = rows.join(bounded_broadcast(principal_axes(rows.drop("word"))), _GROUP)
    centred = F.zip_with("vec", "mean", lambda a, b: a - b)
    return placed.withColumn("_c", centred).select(
        *_GROUP, "word", V.dot("_c", "axis_1").alias("x"), V.dot("_c", "axis_2").alias("y"))


def project_cluster(assignments: DataFrame, vectors: DataFrame, cid: int, normed: bool = True,
                    n: int | None = PLOT_WORDS, seed: int = 42) -> DataFrame:
    """M9 for cluster ``cid`` of each run of ``assignments``. An ``InputError`` if no
    run has it, or if fewer than two of its words have a vector."""
    require_cluster(assignments, cid)
    mine = assignments.filter(F.col("cluster") == cid)
    require_rows(known_words(mine, vectors), f"words of cluster {cid} that have a vector", 2)
    return project_2d(mine, vectors, normed, n, seed)


def projected_centroids(projection: DataFrame) -> DataFrame:
    """M9 with the centroid shown: per cluster the number of its points, the mean
    ``x, y`` of them, and the sums of squares and products along the axes."""
    return projection.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("points"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.sum(F.col("x") * F.col("y")).alias("xy"))


def viz_top_clusters(stats: DataFrame, assignments: DataFrame, vectors: DataFrame,
                     kind: str = "semantic", topn: int = 2, normed: bool = True,
                     n: int = PLOT_WORDS, seed: int = 42) -> DataFrame:
    """L1 picks the top clusters of every run, M9 projects them. An
    ``InputError`` without statistics."""
    require_columns(stats, [*RUN_KEY, "cid", "size", "msi"], "cluster statistics")
    picks = suggest_clusters(stats, kind, topn).select(*RUN_KEY, "pick", F.col("cid").alias("cluster"))
    chosen = assignments.join(F.broadcast(picks), [*RUN_KEY, "cluster"])
    proj = project_2d(chosen.drop("pick"), vectors, normed, n, seed)
    return proj.join(F.broadcast(picks), [*RUN_KEY, "cluster"])
