"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with a scale each and packed into blocks. Every
query block meets every candidate block as a tile. A tile's int8 product gives
each inner product with a bound on its quantisation error; pairs whose upper
bound reaches the k-th best lower bound survive and are computed again in
double precision on the original vectors. A task keeps one heap a query over
its tiles; the heaps of all tasks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiclust.llm.common import stored

NEIGHBOURS = 20
QUERY_BLOCK = 512
BLOCK = 4096
_SLACK = 1e-4  # of the largest possible product: room for float32 bounds

_BLOCK_DDL = "dim int, part int, block int, ids binary, vectors binary"


def usable(vec_id: Column, vector: Column) -> Column:
    """No null id, vector or component, no non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec_id.isNotNull() & finite
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(vectors: DataFrame, parts: int, rows: int, keep: int | None) -> DataFrame:
    """Vectors dealt to ``parts`` groups by hash and packed into blocks of at
    most ``rows`` vectors of one dimension. ``keep``: of equal vectors in a block
    only the ``keep`` smallest ids stay (no more can be among the nearest)."""
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("dim", "part", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"key": None, "ids": [], "vectors": [], "n": 0, "block": 0}

        def flush() -> list[pa.RecordBatch]:
            if not state["n"]:
                return []
            ids, vec = np.concatenate(state["ids"]), np.concatenate(state["vectors"])
            dim, part = state["key"]
            if keep is not None:
                ids, vec = _first_copies(ids, vec, keep)
            out = pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([part], pa.int32()),
                 pa.array([state["block"]], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([vec.tobytes()], pa.binary())],
                names=["dim", "part", "block", "ids", "vectors"])
            state.update(ids=[], vectors=[], n=0, block=state["block"] + 1)
            return [out]

        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            part_of = batch.column("part").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            flat = flat.astype(np.float64)
            at, cell = 0, 0
            while at < len(ids):
                key = int(dims[at]), int(part_of[at])
                if key != state["key"]:
                    yield from flush()
                    state["key"] = key
                same = (dims[at:] == key[0]) & (part_of[at:] == key[1])
                run = len(same) if same.all() else int(same.argmin())
                take = min(run, rows - state["n"])
                state["ids"].append(ids[at:at + take])
                state["vectors"].append(flat[cell:cell + take * key[0]].reshape(take, key[0]))
                state["n"] += take
                at, cell = at + take, cell + take * key[0]
                if state["n"] == rows:
                    yield from flush()
        yield from flush()

    return dealt.select("dim", "part", "id", "vector").mapInArrow(pack, _BLOCK_DDL)


def _first_copies(ids: np.ndarray, vec: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has fewer than ``keep`` equals with a smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vec = ids[order], vec[order]
    _, group = np.unique(vec, axis=0, return_inverse=True)
    group = group.ravel()
    by_group = np.argsort(group, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(group[by_group])) + 1])
    sizes = np.diff(np.append(first, len(group)))
    nth = np.empty(len(group), dtype=np.int64)
    nth[by_group] = np.arange(len(group)) - np.repeat(first, sizes)
    return ids[nth < keep], vec[nth < keep]


class Block:
    """Ids, original vectors, int8 codes (held as float32, in which their
    products are exact up to 1,000 dimensions) and the scale of each row."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.vectors = np.frombuffer(vectors, dtype=np.float64).reshape(-1, dim)
        largest = np.abs(self.vectors).max(axis=1)
        self.scale = largest / 127
        self.codes = np.rint(self.vectors / self.scale[:, None]).astype(np.int8).astype(np.float32)
        # |x - scale * code| <= scale / 2 in each component
        self.size = np.abs(self.codes).sum(axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in index order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Heaps:
    """The best ``k`` (score, -id) of each query of a block so far."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in queries.ids]

    def floor(self) -> np.ndarray:
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.best])

    def tile(self, other: Block) -> None:
        q = self.queries
        scale = q.scale[:, None] * other.scale[None, :]
        product = scale * (q.codes @ other.codes.T)
        error = scale * (0.5 * q.size[:, None] + 0.5 * other.size[None, :]
                         + 0.25 * q.codes.shape[1])
        error *= 1 + _SLACK
        own = q.ids[:, None] == other.ids[None, :]
        lower = np.where(own, -np.inf, product - error)
        k = min(self.k, lower.shape[1])
        kth = np.partition(lower, -k, axis=1)[:, -k] if k == self.k else np.full(len(q.ids), -np.inf)
        survive = (product + error >= np.maximum(kth, self.floor())[:, None]) & ~own
        rows, cols = np.nonzero(survive)
        for at in range(0, len(rows), 1 << 18):
            r, c = rows[at:at + (1 << 18)], cols[at:at + (1 << 18)]
            score = inner(q.vectors[r], other.vectors[c])
            for n, s, i in zip(r.tolist(), score.tolist(), other.ids[c].tolist(), strict=True):
                heap = self.best[n]
                if len(heap) < self.k:
                    heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapreplace(heap, (s, -i))

    def rows(self) -> pa.RecordBatch:
        flat = [(int(q), -i, s) for q, heap in zip(self.queries.ids, self.best, strict=True)
                for s, i in heap]
        q, v, s = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
            names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, key: str = "vec_id",
            vector: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK,
            parts: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest
    other rows by inner product, nearest first, ties to the smaller id; all of
    them where there are fewer.

    Vectors that are null, zero or hold a null or non-finite component take no
    part. Rows that repeat an id count as one, with the smallest vector in array
    order. Only vectors of one dimension are compared. Other columns are not
    read. Candidates are dealt to ``parts`` groups (the shuffle partitions by
    default); each query block meets each group in one task, and each task sends
    on at most ``k`` rows a query.
    """
    spark = vectors.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.where(usable(F.col(key), F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"),
        is_query.alias("is_query"))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"),
                                  F.max("is_query").alias("is_query"))
    rows = stored(rows.withColumn("dim", F.size("vector")), "vectors")
    others = stored(_blocks(rows, parts, block, k + 1), "blocks")
    asked = stored(_blocks(rows.where("is_query"), parts, query_block, None), "queries")
    # A query block and a group of candidate blocks make one row of tiles.
    groups = others.select(F.col("dim").alias("_d"), F.col("part").alias("_g")).distinct()
    left = asked.join(groups, F.col("dim") == F.col("_d")).select(
        "dim", F.col("part").alias("q_part"), F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("_g").alias("part"))
    # Rows of one query block follow one another inside a group.
    tiles = left.join(others, ["dim", "part"])
    tiles = tiles.sortWithinPartitions("part", "dim", "q_part", "q_block", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heaps = None, None
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for n in range(batch.num_rows):
                key_of = tuple(columns[c][n].as_py() for c in ("part", "dim", "q_part", "q_block"))
                dim = key_of[1]
                if key_of != current:
                    if heaps is not None:
                        yield heaps.rows()
                    current = key_of
                    heaps = Heaps(Block(columns["q_ids"][n].as_py(),
                                        columns["q_vectors"][n].as_py(), dim), k)
                heaps.tile(Block(columns["ids"][n].as_py(), columns["vectors"][n].as_py(), dim))
        if heaps is not None:
            yield heaps.rows()

    found = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
