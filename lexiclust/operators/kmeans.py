"""k-means over vector sets.

Both methods are a driver loop over the vectors, packed once into binary blocks
and persisted. Each round ships the centroids of its models to the tasks;
every partition assigns its rows with a numpy block product and emits at most K
partial sums a model; small ones are added up on the driver, others by a grouped
merge after which only K x D a model comes back. Models (all K of a grid, all starts of Lloyd's
method) advance in the same pass, as many at a time as fit the broadcast bound.

Random choices are replaced by hashes so that runs are reproducible and can
be unrolled in SQL: the start centroids are the K rows with the lowest
``md5('seed:rank')``; in round t the empty clusters, in id order, take the
rows with the lowest ``md5('seed:t:rank')``.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiclust.functions import vector as V
from lexiclust.session import cut_lineage
from lexiclust.operators.vectors import (
    MAX_CENTROID_BYTES, cap_rank, centroid_blocks, l2_normalize, nearer, nearest,
    nearest_centroid, restrict_to_vocab, vec_matrix)

# Fixed values of the reference: all-close test of the stop rule, the norm
# guard, and the defaults of the grid.
ATOL = 1e-6
RTOL = 1e-5
EPS = 1e-12
DEFAULT_K_VALUES = (200, 400, 800, 1200, 2000)
DEFAULT_MAX_ITER = 100
DEFAULT_SEED = 42

_PARTIAL_SCHEMA = "k int, cid int, n long, s array<double>"


@dataclass
class KMeansFit:
    centroids: dict[int, np.ndarray]
    iterations: dict[int, int]
    secs: float
    n: int = 0
    dim: int = 0


def _unit_rows(C: np.ndarray) -> np.ndarray:
    return C / (np.linalg.norm(C, axis=1, keepdims=True) + EPS)


ROWS_A_BLOCK = 4096
_PACKED = "n int, dim int, ranks binary, vecs binary"


def _parts(vectors: DataFrame, n: int) -> int:
    """How many partitions ``n`` vectors are packed into."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, n // 1000), n // 50_000)


def pack(vectors: DataFrame, n: int) -> DataFrame:
    """``rank, vec`` as rows of binary blocks (float64), spread over the cluster:
    tasks read them without converting any cell."""
    parts = _parts(vectors, n)
    rows = vectors.select(F.col("rank").cast("long").alias("rank"), V.as_double("vec").alias("vec"))

    def fn(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_BLOCK):
                b = batch.slice(at, ROWS_A_BLOCK)
                X = vec_matrix(b)
                ranks = b.column("rank").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([X.shape[0]], pa.int32()), pa.array([X.shape[1]], pa.int32()),
                     pa.array([ranks.tobytes()], pa.binary()), pa.array([X.tobytes()], pa.binary())],
                    names=["n", "dim", "ranks", "vecs"])
    return rows.repartition(parts).mapInArrow(fn, _PACKED)


def _blocks(batches):
    """``ranks, matrix`` of every packed block."""
    for b in batches:
        for i in range(b.num_rows):
            n = b.column("n")[i].as_py()
            yield (np.frombuffer(b.column("ranks")[i].as_buffer(), dtype=np.int64),
                   np.frombuffer(b.column("vecs")[i].as_buffer(), dtype=np.float64).reshape(n, -1))


def _lowest_hash_rows(packed: DataFrame, prefix: str, n: int) -> np.ndarray:
    """The ``n`` rows with the lowest ``md5(prefix + rank)`` (ties by rank):
    the lowest of each block, then a bounded top-n."""
    def fn(batches):
        for ranks, X in _blocks(batches):
            h = [hashlib.md5(f"{prefix}{r}".encode()).hexdigest() for r in ranks.tolist()]
            low = sorted(range(len(h)), key=lambda i: (h[i], ranks[i]))[:n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[i] for i in low], pa.string()), pa.array(ranks[low], pa.int64()),
                 pa.array([X[i].tobytes() for i in low], pa.binary())], names=["h", "rank", "x"])
    rows = (packed.mapInArrow(fn, "h string, rank long, x binary").orderBy("h", "rank").limit(n)
            .select("x").collect())
    return np.array([np.frombuffer(r["x"], dtype=np.float64) for r in rows])


def _partial_sums(bc):
    def fn(batches):
        models = bc.value
        acc = {k: (np.zeros_like(C), np.zeros(C.shape[0], dtype=np.int64))
               for k, C in models.items()}
        sq = {k: (C * C).sum(1) for k, C in models.items()}
        for _, X in _blocks(batches):
            for k, C in models.items():
                lab = nearest(X, C, sq[k])
                order = np.argsort(lab, kind="stable")
                ls = lab[order]
                starts = np.flatnonzero(np.r_[True, ls[1:] != ls[:-1]])
                ids = ls[starts]
                acc[k][0][ids] += np.add.reduceat(X[order], starts, axis=0)
                acc[k][1][ids] += np.diff(np.r_[starts, len(ls)])
        ks, cids, ns, ss = [], [], [], []
        for k, (S, cnt) in acc.items():
            for c in np.flatnonzero(cnt):
                ks.append(k)
                cids.append(int(c))
                ns.append(int(cnt[c]))
                ss.append(S[c])
        if ks:
            flat = pa.array(np.concatenate(ss))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ss])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int32()), pa.array(cids, pa.int32()), pa.array(ns, pa.int64()),
                 pa.ListArray.from_arrays(offsets, flat)], names=["k", "cid", "n", "s"])
    return fn


def _passes(models: dict[int, np.ndarray]):
    """The models in groups that fit the broadcast bound together."""
    group, size = {}, 0
    for key, C in models.items():
        if group and size + C.nbytes > MAX_CENTROID_BYTES:
            yield group
            group, size = {}, 0
        group[key] = C
        size += C.nbytes
    if group:
        yield group


_LABELLED = _PACKED + ", labels binary, distances binary"


def _in_blocks(packed: DataFrame, k: int, C: np.ndarray) -> DataFrame:
    """Partial sums of one model beyond the broadcast bound: its centroids come
    in blocks, the packed vectors carry the nearest so far, and every packed
    block emits the sums of the clusters that it has."""
    spark = packed.sparkSession
    labelled = packed
    for n, (first, part) in enumerate(centroid_blocks(C)):
        bc = spark.sparkContext.broadcast(part)

        def label(batches, n=n, first=first, bc=bc):
            for b in batches:
                found = []
                for i, (_, X) in enumerate(_blocks([b])):
                    lab, d = np.zeros(len(X), np.int32), np.full(len(X), np.inf)
                    if n:
                        lab = np.frombuffer(b.column("labels")[i].as_buffer(), dtype=np.int32)
                        d = np.frombuffer(b.column("distances")[i].as_buffer(), dtype=np.float64)
                    lab, d = nearer(X, bc.value, first, lab, d)
                    found.append((lab.tobytes(), d.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:4], *(pa.array([f[i] for f in found], pa.binary()) for i in (0, 1))],
                    names=[*b.schema.names[:4], "labels", "distances"])
        labelled = labelled.mapInArrow(label, _LABELLED)

    def sums(batches):
        for b in batches:
            for i, (_, X) in enumerate(_blocks([b])):
                lab = np.frombuffer(b.column("labels")[i].as_buffer(), dtype=np.int32)
                ids, inv, n = np.unique(lab, return_inverse=True, return_counts=True)
                S = np.zeros((len(ids), X.shape[1]))
                np.add.at(S, inv, X)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), k, np.int32)), pa.array(ids, pa.int32()), pa.array(n, pa.int64()),
                     pa.array(list(S), pa.list_(pa.float64()))], names=["k", "cid", "n", "s"])
    return labelled.mapInArrow(sums, _PARTIAL_SCHEMA)


# Partial sums of all partitions that may come to the driver unmerged.
DIRECT_BYTES = 64 * 1024 * 1024


def kmeans_round(packed: DataFrame, centroids: dict[int, np.ndarray],
                 parts: int | None = None) -> dict[int, tuple]:
    """Per model the member sums and counts of every cluster. Every
    partition emits at most K partial sums per model. Those of all ``parts``
    partitions (where the caller knows how many) are added up as they come when
    they take ``DIRECT_BYTES`` at most, which saves the round a shuffle; else, or
    if ``parts`` is not known, they are merged by key on the executors first."""
    spark = packed.sparkSession
    out = {k: (np.zeros_like(C), np.zeros(C.shape[0], dtype=np.int64))
           for k, C in centroids.items()}
    for group in _passes(centroids):
        bc, one = None, next(iter(group))
        if group[one].nbytes > MAX_CENTROID_BYTES:
            partial = _in_blocks(packed, one, group[one])
        else:
            bc = spark.sparkContext.broadcast(group)
            partial = packed.mapInArrow(_partial_sums(bc), _PARTIAL_SCHEMA)
        if parts is None or parts * sum(C.nbytes for C in group.values()) > DIRECT_BYTES:
            partial = partial.groupBy("k", "cid").agg(
                F.sum("n").alias("n"), Summarizer.sum(array_to_vector("s")).alias("s")
            ).select("k", "cid", "n", vector_to_array("s").alias("s"))
        try:
            merged = partial.toArrow()
        finally:
            if bc is not None:
                bc.unpersist()
        sums = vec_matrix(merged, "s")
        ks, cids, ns = (merged.column(c).to_numpy() for c in ("k", "cid", "n"))
        for k in group:
            at = np.flatnonzero(ks == k)
            np.add.at(out[k][0], cids[at], sums[at])
            np.add.at(out[k][1], cids[at], ns[at])
    return out


def spherical_kmeans(vectors: DataFrame, ks, seed: int = DEFAULT_SEED,
                     max_iter: int = DEFAULT_MAX_ITER, stop_early: bool = True) -> KMeansFit:
    """M1 on one vector set (``rank, vec``) for every K in ``ks``.

    Round t: assign every row to its nearest centroid (ties to the lowest id),
    take the member mean, give empty clusters a data row, scale to unit
    length. A model stops when its centroids are all-close to the previous
    ones (``|old - new| <= 1e-6 + 1e-5 |new|``) or after ``max_iter``
    rounds."""
    ks = sorted({int(k) for k in ks})
    t0 = time.time()
    n = vectors.count()
    data, parts = pack(vectors, n).persist(), _parts(vectors, n)
    try:
        if not ks or n == 0:
            return KMeansFit({}, {}, 0.0, n, 0)
        if max(ks) > n:
            raise ValueError(f"K={max(ks)} exceeds the {n} vectors")
        S = _lowest_hash_rows(data, f"{seed}:", max(ks))
        dim = S.shape[1]
        current = {k: S[:k].copy() for k in ks}
        iterations: dict[int, int] = {}
        active = dict(current)
        for it in range(1, max_iter + 1):
            sums = kmeans_round(data, active, parts)
            need = max((int((cnt == 0).sum()) for _, cnt in sums.values()), default=0)
            spare = _lowest_hash_rows(data, f"{seed}:{it}:", need) if need else None
            nxt = {}
            for k, (Ssum, cnt) in sums.items():
                M = np.zeros_like(Ssum)
                nz = cnt > 0
                M[nz] = Ssum[nz] / cnt[nz][:, None]
                empty = np.flatnonzero(~nz)
                if len(empty):
                    M[empty] = spare[: len(empty)]
                nxt[k] = _unit_rows(M)
            for k, C in nxt.items():
                done = stop_early and np.allclose(active[k], C, rtol=RTOL, atol=ATOL)
                current[k] = C
                if done:
                    iterations[k] = it
            active = {k: current[k] for k in active if k not in iterations}
            if not active:
                break
        for k in ks:
            iterations.setdefault(k, max_iter)
        return KMeansFit(current, iterations, time.time() - t0, n, dim)
    finally:
        data.unpersist()


def predict(vectors: DataFrame, centroids: dict[int, np.ndarray],
            keep=("slug", "rank", "word")) -> DataFrame:
    """M4: the nearest centroid for every row and every model:
    ``keep + [k, cluster]``."""
    spark = vectors.sparkSession
    src = vectors.select(*keep, "vec")
    out_schema = src.drop("vec").schema.add("k", T.IntegerType()).add("cluster", T.IntegerType())

    def labels(bc):
        def fn(batches):
            models = bc.value
            sq = {k: (C * C).sum(1) for k, C in models.items()}
            for b in batches:
                X = vec_matrix(b)
                base = b.drop_columns(["vec"])
                for k, C in models.items():
                    lab = nearest(X, C, sq[k]) if X.shape[0] else np.zeros(0, np.int32)
                    yield (base.append_column("k", pa.array(np.full(len(lab), k, np.int32)))
                           .append_column("cluster", pa.array(lab, pa.int32())))
        return fn

    out = None
    for group in _passes({k: np.asarray(C, np.float64) for k, C in centroids.items()}):
        one = next(iter(group))
        if group[one].nbytes > MAX_CENTROID_BYTES:
            found = nearest_centroid(src, group[one], max_bytes=MAX_CENTROID_BYTES)
            part = found.select(*keep, F.lit(one).cast("int").alias("k"), "cluster")
        else:
            part = src.mapInArrow(labels(spark.sparkContext.broadcast(group)), out_schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], out_schema) if out is None else out


@dataclass
class LloydFit:
    centroids: np.ndarray
    cost: float
    iterations: int


SEED_ROWS = 5  # rows a cluster in the sample from which starts are drawn


def _seeded_start(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """K rows of the sample, each drawn with the squared distance to those drawn
    before (k-means++)."""
    picked = [int(rng.integers(len(sample)))]
    d = ((sample - sample[picked[0]]) ** 2).sum(1)
    while len(picked) < k:
        total = d.sum()
        i = int(rng.choice(len(sample), p=d / total)) if total > 0 else int(rng.integers(len(sample)))
        picked.append(i)
        d = np.minimum(d, ((sample - sample[i]) ** 2).sum(1))
    return sample[picked].copy()


def lloyd_kmeans(vectors: DataFrame, k: int, seed: int = DEFAULT_SEED, max_iter: int = DEFAULT_MAX_ITER,
                 tol: float = 1e-4, n_init: int = 10) -> LloydFit:
    """M2 ("serial"): plain Euclidean k-means, best of ``n_init`` starts by cost
    (ties to the earlier start); centroids are not re-normalised. Starts are
    drawn by k-means++ from a bounded sample (the rows with the lowest hashes);
    all of them advance in the same pass, and one stops when no centroid moves
    by ``tol`` or more, or after ``max_iter`` rounds. An empty cluster takes a
    data row."""
    n = vectors.count()
    if k > n:
        raise ValueError(f"K={k} exceeds the {n} vectors")
    data, parts = pack(vectors, n).persist(), _parts(vectors, n)
    try:
        sample = _lowest_hash_rows(data, f"{seed}:", min(n, SEED_ROWS * k))
        current = {i: _seeded_start(sample, k, np.random.default_rng(seed + i)) for i in range(n_init)}
        cost = dict.fromkeys(current, float("inf"))
        iterations = dict.fromkeys(current, max_iter)
        squares = data.mapInArrow(_square_sums, "s double").agg(F.sum("s")).first()[0]
        active = set(current)
        for it in range(1, max_iter + 2):
            sums = kmeans_round(data, {i: current[i] for i in sorted(active)}, parts)
            need = max(int((cnt == 0).sum()) for _, cnt in sums.values())
            spare = _lowest_hash_rows(data, f"{seed}:{it}:", need) if need else None
            for i, (S, cnt) in sums.items():
                C = current[i]
                # inertia under C: sum |x|^2 - 2 s.c + n |c|^2
                cost[i] = squares - float((2 * (S * C).sum(1) - cnt * (C * C).sum(1)).sum())
                M = S / np.maximum(cnt, 1)[:, None]
                empty = np.flatnonzero(cnt == 0)
                if len(empty):
                    M[empty] = spare[:len(empty)]
                moved = float(np.sqrt(((M - C) ** 2).sum(1)).max())
                if moved < tol or it > max_iter:
                    iterations[i] = min(it, max_iter)
                    active.discard(i)
                else:
                    current[i] = M
            if not active:
                break
        best = min(current, key=lambda i: (round(cost[i], 9), i))
        return LloydFit(current[best], cost[best], iterations[best])
    finally:
        data.unpersist()


def _square_sums(batches):
    for _, X in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([float((X * X).sum())])], names=["s"])


def baseline_kmeans(vectors: DataFrame, k: int, seed: int = DEFAULT_SEED, max_iter: int = 300,
                    tol: float = 1e-4) -> tuple[LloydFit, np.ndarray]:
    """M3 ("sklearn"): one start on unit vectors; labels from the fitted centres,
    which come back scaled to unit length too."""
    fit = lloyd_kmeans(vectors, k, seed, max_iter, tol, n_init=1)
    return fit, _unit_rows(fit.centroids)


def model_labels(fit: LloydFit, vectors: DataFrame, keep=("slug", "rank", "word")) -> DataFrame:
    return predict(vectors, {len(fit.centroids): fit.centroids}, keep).drop("k")


@dataclass
class GridResult:
    assignments: DataFrame
    runs: DataFrame


def cluster_grid(vectors: DataFrame, k_values, method: str = "parallel", normalize: bool = True,
                 toplist: DataFrame | None = None, max_words: int | None = None,
                 seed: int = DEFAULT_SEED, max_iter: int = DEFAULT_MAX_ITER,
                 restrict_path: str = "", vec_path: str = "") -> GridResult:
    """M5 for one vector set: P8, J1, P7, P13, then M1 ("parallel"), M2
    ("serial") or M3 ("sklearn": unit vectors, no toplist) for every feasible K.
    Returns assignments (``slug, method, k, word, cluster``) and one run row per
    K; ``num_cores`` is the cluster's parallelism. An empty set is an error."""
    if method not in ("parallel", "serial", "sklearn"):
        raise ValueError(f"unknown method {method!r}")
    spark = vectors.sparkSession
    vs = cap_rank(vectors, max_words)
    if method == "sklearn":
        normalize = True
    else:
        vs = restrict_to_vocab(vs, toplist)
    if normalize:
        vs = l2_normalize(vs)
    vs = vs.persist()
    try:
        first = vs.select("slug", F.size("vec").alias("d")).first()
        if first is None:
            raise ValueError("the vector set is empty")
        slug, dim = first["slug"], first["d"]
        n = vs.count()
        ks = sorted({int(k) for k in k_values if int(k) <= n})
        models, rounds, secs = {}, {}, {}
        if method == "parallel":
            fit = spherical_kmeans(vs, ks, seed=seed, max_iter=max_iter)
            models, rounds, secs = fit.centroids, fit.iterations, dict.fromkeys(ks, fit.secs)
        else:
            for k in ks:
                t0 = time.time()
                one = (lloyd_kmeans(vs, k, seed, max_iter) if method == "serial"
                       else baseline_kmeans(vs, k, seed, max_iter)[0])
                models[k], rounds[k], secs[k] = one.centroids, one.iterations, time.time() - t0
        labels = cut_lineage(predict(vs, models).select(
            "slug", F.lit(method).alias("method"), F.col("k").cast("int").alias("k"), "word", "cluster"))
        cores = spark.sparkContext.defaultParallelism
        runs = spark.createDataFrame(
            [(vec_path, slug, k, method, n, dim, int(normalize), rounds[k], cores, max_iter,
              round(secs[k], 2), str(max_words or "all"), restrict_path) for k in ks],
            "vec string, vecslug string, K int, method string, N long, D int, normed int, "
            "iterations int, num_cores int, max_iter int, secs double, max_words string, "
            "restrict_path string")
        return GridResult(labels, runs)
    finally:
        vs.unpersist()
