"""Vector-set operators.

Vector sets have the schema ``slug, rank, word, vec``: ``rank`` is the file
order (0 = first). Assignments are ``slug, method, k, word, cluster``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiclust.functions import vector as V
from lexiclust.session import bounded_broadcast

RUN_KEY = ["slug", "method", "k"]
# Largest centroid matrix we ship to every task (bytes, as float64).
MAX_CENTROID_BYTES = 512 * 1024 * 1024


def l2_normalize(vectors: DataFrame, col: str = "vec") -> DataFrame:
    """Every vector to unit length (``x / (||x|| + 1e-12)``)."""
    return vectors.withColumn(col, V.l2_normalize(col))


def cap_rank(vectors: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` words of each vector set by rank (``None``/0 = all)."""
    return vectors if not n else vectors.filter(F.col("rank") < n)


def restrict_to_vocab(vectors: DataFrame, toplist: DataFrame | None) -> DataFrame:
    """Keep the words listed in ``toplist`` (column ``token``), in rank
    order. A vector set that no listed word matches is kept whole, as is
    every set when the list is missing or empty."""
    if toplist is None:
        return vectors
    listed = bounded_broadcast(
        toplist.select(F.col("token").alias("word")).distinct().withColumn("_listed", F.lit(True)))
    tagged = vectors.join(listed, "word", "left").withColumn(
        "_listed", F.coalesce("_listed", F.lit(False)))
    # one row per vector set
    any_match = tagged.groupBy("slug").agg(F.max("_listed").alias("_any"))
    return (tagged.join(F.broadcast(any_match), "slug")
            .filter(F.col("_listed") | ~F.col("_any"))
            .select(*vectors.columns))


def known_words(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Assignments whose word has a vector in the run's vector set."""
    keys = vectors.select("slug", "word")
    return assignments.join(keys, ["slug", "word"], "left_semi")


def feasible_k(vectors: DataFrame, ks: list[int]) -> DataFrame:
    """``slug, k`` for every K that does not exceed the set's size."""
    counts = vectors.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("slug", "n", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    return grid.filter(F.col("k") <= F.col("n")).select("slug", "k")


# ---------------------------------------------------------------------------
# nearest centroid (J5) -- numpy block product inside Arrow batches

def vec_matrix(batch: pa.RecordBatch | pa.Table, col: str = "vec") -> np.ndarray:
    """A list column of equal-length vectors as an (n, D) float64 matrix."""
    arr = batch.column(col)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


# Distances that agree to this many decimals count as a tie (lowest id wins),
# so the choice does not depend on the order of floating-point sums.
TIE_DECIMALS = 9


def nearest(X: np.ndarray, C: np.ndarray, c_sq: np.ndarray | None = None,
            block: int = 4_000_000) -> np.ndarray:
    """Index of the nearest centroid by Euclidean distance; distances equal
    to ``TIE_DECIMALS`` decimals go to the lowest index. A block product finds
    the candidates; close calls are settled with exact differences."""
    n = X.shape[0]
    k = C.shape[0]
    out = np.empty(n, dtype=np.int32)
    if n == 0:
        return out
    c_sq = (C * C).sum(1) if c_sq is None else c_sq
    step = max(1, block // max(k, 1))
    half = 0.5 * c_sq
    for s in range(0, n, step):
        x = X[s:s + step]
        d = x @ C.T  # half the squared distance, but for the row's own square
        np.subtract(half, d, out=d)
        j = d.argmin(1)
        dmin = d[np.arange(len(x)), j]
        span = 0.5e-6 * (1.0 + np.abs((x * x).sum(1) + 2.0 * dmin))
        close = d <= (dmin + span)[:, None]
        # all close calls of the block at once: exact distances, then the
        # lowest id of the smallest rounded one
        r = np.flatnonzero(np.count_nonzero(close, axis=1) > 1)
        if len(r):
            at, c = np.nonzero(close[r])
            r = r[at]
            exact = np.empty(len(r))
            for a in range(0, len(r), 4096):
                diff = x[r[a:a + 4096]] - C[c[a:a + 4096]]
                exact[a:a + 4096] = np.round(np.sqrt((diff * diff).sum(1)), TIE_DECIMALS)
            order = np.lexsort((c, exact, r))
            first = np.flatnonzero(np.r_[True, np.diff(r[order]) != 0])
            j[r[order][first]] = c[order][first]
        out[s:s + step] = j
    return out


def centroid_blocks(C: np.ndarray, max_bytes: int | None = None) -> list[tuple[int, np.ndarray]]:
    """The centroids as blocks of at most ``max_bytes``, each with its first id."""
    rows = max(1, (max_bytes or MAX_CENTROID_BYTES) // max(1, C.shape[1] * 8))
    return [(at, C[at:at + rows]) for at in range(0, max(len(C), 1), rows)]


def nearer(X: np.ndarray, C: np.ndarray, first: int, label: np.ndarray,
           distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids seen before (``label``, and its rounded
    ``distance``) and those of one more block, whose ids begin at ``first``."""
    j = nearest(X, C)
    diff = X - C[j]
    d = np.round(np.sqrt((diff * diff).sum(1)), TIE_DECIMALS)
    closer = d < distance
    return np.where(closer, j + first, label).astype(np.int32), np.where(closer, d, distance)


def nearest_centroid(vectors: DataFrame, centroids: np.ndarray, col: str = "vec",
                     out_col: str = "cluster", max_bytes: int | None = None) -> DataFrame:
    """Add the nearest centroid's index to every vector. The centroids are
    broadcast in blocks of ``max_bytes``; with more than one, every row carries
    the nearest so far from block to block, in one pass and without a shuffle."""
    C = np.asarray(centroids, dtype=np.float64)
    spark = vectors.sparkSession
    out, best = vectors, f"{out_col}_distance"
    blocks = centroid_blocks(C, max_bytes)
    for n, (first, part) in enumerate(blocks):
        bc = spark.sparkContext.broadcast(part)

        def fn(batches, n=n, first=first, bc=bc):
            for b in batches:
                x = vec_matrix(b, col)
                if n:
                    label, d = (b.column(c).to_numpy() for c in (out_col, best))
                    b = b.drop_columns([out_col, best])
                else:
                    label, d = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.inf)
                if len(blocks) == 1:
                    label = nearest(x, bc.value)
                elif b.num_rows:
                    label, d = nearer(x, bc.value, first, label, d)
                yield b.append_column(out_col, pa.array(label, pa.int32())).append_column(
                    best, pa.array(d, pa.float64()))

        schema = T.StructType([*vectors.schema.fields, T.StructField(out_col, T.IntegerType()),
                               T.StructField(best, T.DoubleType())])
        out = out.mapInArrow(fn, schema)
    return out.drop(best)


# ---------------------------------------------------------------------------
# centroid mean

def centroid_mean(assignments: DataFrame, vectors: DataFrame, k_of_run: DataFrame | None = None,
                  normalize_members: bool = True, unit: bool = True) -> DataFrame:
    """Per run and cluster the mean of the member vectors (each first made
    unit length when ``normalize_members``), then unit length. Only assigned
    words with a vector count; a word counts once in each cluster that holds it. Clusters ``0..K-1``
    without members get a zero vector, K taken from ``k_of_run`` (run key +
    ``k_total``) or else the highest id + 1.

    Output: run key, ``cid``, ``centroid array<double>``, ``n_words``."""
    members = (assignments.select(*RUN_KEY, "word", F.col("cluster").alias("cid"))
               .distinct()
               .join(vectors.select("slug", "word", "vec"), ["slug", "word"]))
    vec = V.l2_normalize("vec") if normalize_members else V.as_double("vec")
    means = (members.select(*RUN_KEY, "cid", array_to_vector(vec).alias("v"))
             .groupBy(*RUN_KEY, "cid")
             .agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n_words")))
    means = means.select(*RUN_KEY, "cid", vector_to_array("m").alias("centroid"), "n_words")
    if unit:
        means = means.withColumn("centroid", V.l2_normalize("centroid"))
    if k_of_run is None:
        k_of_run = assignments.groupBy(*RUN_KEY).agg((F.max("cluster") + 1).alias("k_total"))
    dims = means.groupBy(*RUN_KEY).agg(F.max(F.size("centroid")).alias("dim"))
    ids = (k_of_run.join(dims, RUN_KEY)
           .select(*RUN_KEY, "dim", F.explode(F.sequence(F.lit(0), F.col("k_total") - 1)).alias("cid")))
    zero = F.transform(F.sequence(F.lit(1), F.col("dim")), lambda _: F.lit(0.0))
    return (ids.join(means, [*RUN_KEY, "cid"], "left")
            .select(*RUN_KEY, F.col("cid").cast("int").alias("cid"),
                    F.coalesce("centroid", zero).alias("centroid"),
                    F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words")))
