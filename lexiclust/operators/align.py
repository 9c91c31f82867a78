"""Aligning clusterings of the same K (J6-J9, J11, A21, A22), any number of
pairs of runs at once.

A pair is the keys of its two runs (``PAIR``); centroids, similarities,
matchings and overlaps all carry it. Centroids (A8) are packed into blocks, and
each pair of blocks is one numpy product, so no centroid matrix is broadcast.
Both matchings run as rounds of jobs over the similarity table, every round
serving all pairs: ``greedy_match`` walks each row's sorted list of candidates;
``optimal_match`` is an auction with epsilon scaling whose prices and owners are
a table. Word overlap is an equi-join on the word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiclust.operators.vectors import RUN_KEY, centroid_mean, known_words
from lexiclust.session import bounded_broadcast, cut_lineage
from lexiclust.sources.sinks import InputError, require_rows

PAIR = ["slug_a", "method_a", "slug_b", "method_b", "k"]
BLOCK_CENTROIDS = 512

# Cosines equal to this many decimals are ties (lowest ids win), so the
# matching does not hinge on the order of floating-point sums.
SIM_DECIMALS = 9


def run_pairs(runs_a: DataFrame, runs_b: DataFrame) -> DataFrame:
    """Every run of A with every run of B that has its K (``PAIR``). Raises
    where a run has no partner: its K differs."""
    a = runs_a.select(F.col("slug").alias("slug_a"), F.col("method").alias("method_a"), "k").distinct()
    b = runs_b.select(F.col("slug").alias("slug_b"), F.col("method").alias("method_b"), "k").distinct()
    alone = a.join(b, "k", "left_anti").select("k").union(b.join(a, "k", "left_anti").select("k"))
    found = alone.first()
    if found is not None:
        raise InputError(f"K mismatch between runs: K={found['k']} on one side only")
    return a.join(b, "k").select(*PAIR)


def _side(cent: DataFrame, side: str) -> DataFrame:
    """Blocks of centroids of each run, its keys named for the side."""
    block = F.floor(F.col("cid") / BLOCK_CENTROIDS).alias(f"block_{side}")
    rows = cent.groupBy(*RUN_KEY, block).agg(
        F.collect_list(F.struct("cid", "centroid")).alias(f"rows_{side}"))
    return rows.withColumnsRenamed({"slug": f"slug_{side}", "method": f"method_{side}"})


def _with_run(cent: DataFrame) -> DataFrame:
    """Centroids without run keys are those of one nameless run, K = rows."""
    if all(c in cent.columns for c in RUN_KEY):
        return cent
    k = cent.count()
    return cent.withColumns({"slug": F.lit(""), "method": F.lit(""), "k": F.lit(k)})


def centroid_similarity(cent_a: DataFrame, cent_b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``PAIR + cid_a, cid_b, sim``: dot products of the unit centroids of
    the two runs of each pair (by default every pair of the same K)."""
    cent_a, cent_b = _with_run(cent_a), _with_run(cent_b)
    pairs = run_pairs(cent_a, cent_b) if pairs is None else pairs
    tiles = (pairs.join(_side(cent_a, "a"), ["slug_a", "method_a", "k"])
             .join(_side(cent_b, "b"), ["slug_b", "method_b", "k"]))

    def fn(batches):
        def side(batch, name, i):
            flat = batch.column(name).slice(i, 1).flatten()
            ids = flat.field("cid").to_numpy()
            return ids, flat.field("centroid").flatten().to_numpy().reshape(len(ids), -1)
        for b in batches:
            for i in range(b.num_rows):
                (ia, xa), (ib, xb) = side(b, "rows_a", i), side(b, "rows_b", i)
                n = len(ia) * len(ib)
                keys = [pa.array([b.column(c)[i].as_py()] * n, b.column(c).type) for c in PAIR]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(np.repeat(ia, len(ib)), pa.int32()),
                     pa.array(np.tile(ib, len(ia)), pa.int32()), pa.array((xa @ xb.T).ravel())],
                    names=[*PAIR, "cid_a", "cid_b", "sim"])

    return tiles.select(*PAIR, "rows_a", "rows_b").mapInArrow(
        fn, "slug_a string, method_a string, slug_b string, method_b string, k int, "
            "cid_a int, cid_b int, sim double")


def _pair_of(sim: DataFrame) -> list[str]:
    return [c for c in PAIR if c in sim.columns]


GREEDY_CANDIDATES = 1 << 20  # listed similarities of a pair that one task walks through


def greedy_match(sim: DataFrame, candidates: int = GREEDY_CANDIDATES) -> DataFrame:
    """J7, for every pair: repeatedly take the highest remaining similarity and
    drop its row and column (ties: lowest ``cid_a``, then ``cid_b``).

    Runs in passes over one stored table. In a pass every free row lists its best
    free columns, as many as make ``candidates`` of a pair, and one task a pair
    walks the lists from the highest similarity down. What it takes is the rule's
    own choice until a row that is still free has come to the end of a cut list;
    there it stops, and the next pass lists what is left. Pairs of up to
    ``sqrt(candidates)`` clusters take one pass, whatever their similarities."""
    key = _pair_of(sim)
    table = sim.select(*key, "cid_a", "cid_b", "sim", F.round("sim", SIM_DECIMALS).alias("_s"))
    # one pass a name: a pair without keys is one nameless pair
    table = cut_lineage(table.withColumn("_pair", F.struct(F.lit(0), *key)))
    taken = table.select("_pair", *key, "cid_a", "cid_b", "sim").limit(0)
    rest = table
    while True:
        rows = rest.groupBy("_pair").agg(F.count_distinct("cid_a").alias("n")).agg(F.max("n")).first()[0]
        if rows is None:
            return taken.drop("_pair")
        taken = cut_lineage(taken.unionByName(_greedy_pass(rest, key, max(1, candidates // rows))))
        used = bounded_broadcast(taken.select("_pair", "cid_a", "cid_b"))
        rest = (table.join(used.select("_pair", "cid_a"), ["_pair", "cid_a"], "left_anti")
                .join(used.select("_pair", "cid_b"), ["_pair", "cid_b"], "left_anti"))


def _greedy_pass(rest: DataFrame, key: list[str], most: int) -> DataFrame:
    """The pairs one pass takes when each row lists at most ``most`` columns."""
    row = Window.partitionBy("_pair", "cid_a")  # at most one row a cluster of B
    listed = (rest.withColumn("_place", F.row_number().over(row.orderBy(F.desc("_s"), "cid_b")))
              .where(F.col("_place") <= most + 1))

    def walk(rows: pa.Table) -> pa.Table:
        a, b, s, place = (rows.column(c).to_numpy() for c in ("cid_a", "cid_b", "_s", "_place"))
        order = np.lexsort((b, a, -s))
        used_a, used_b, chosen = set(), set(), []
        for n, i, j, p in zip(order.tolist(), a[order].tolist(), b[order].tolist(),
                              place[order].tolist(), strict=True):
            if i in used_a:
                continue
            if p > most:  # beyond its list a free row's best is not known
                break
            if j not in used_b:
                used_a.add(i)
                used_b.add(j)
                chosen.append(n)
        return rows.take(pa.array(chosen, pa.int64())).select(kept)
    kept = ["_pair", *key, "cid_a", "cid_b", "sim"]
    return listed.groupBy("_pair").applyInArrow(walk, rest.select(*kept).schema)


class AuctionResult:
    def __init__(self, matching: DataFrame, gap: float, rounds: int, primal: int):
        self.matching = matching
        self.gap = gap
        self.rounds = rounds
        self.primal = primal


AUCTION_ROWS = 256  # rows of a pair that bid together
EPS_STEP = 20.0


def optimal_match(sim: DataFrame, scale: float = 1e6, block_rows: int = AUCTION_ROWS) -> AuctionResult:
    """J8, for every pair: a one-to-one matching of maximum total similarity
    (cosines rounded to 1e-6), by the auction algorithm with epsilon scaling.

    Prices and owners are a table keyed (pair, column). A round is one job for
    all pairs: blocks of ``block_rows`` rows bid among themselves against the
    prices of their pair until each of their rows holds a column (``_claims``);
    what different blocks claim is settled by one aggregation per (pair,
    column), the highest price winning, ties to the lowest row. Rows that lost
    bid again in the next round. Claims stay within epsilon of a row's best
    value, since prices only rise. The driver sees counts and sums, no prices.

    Benefits are integers ``round(sim * 1e6) * (K + 1)``; the last phase runs
    with epsilon 1, so each matching is optimal for the rounded benefits
    (``gap`` = dual minus primal is below K + 1 per pair)."""
    key = _pair_of(sim)
    pair = F.struct(*key) if key else F.struct(F.lit(0).alias("one"))
    rows = cut_lineage(sim.select(pair.alias("_pair"), "cid_a", "cid_b", "sim"))
    if rows.isEmpty():
        return AuctionResult(sim.select(*key, "cid_a", "cid_b", "sim"), 0.0, 0, 0)
    sizes = rows.groupBy("_pair").agg(F.countDistinct("cid_a").alias("_k"))  # one row a pair
    benefit = F.round(F.col("sim") * scale) * (F.col("_k") + 1)
    blocks = rows.join(sizes, "_pair").groupBy(
        "_pair", F.floor(F.col("cid_a") / block_rows).alias("_block")).agg(
        F.collect_list(F.struct("cid_a", "cid_b", benefit.alias("b"))).alias("cells"))
    blocks = cut_lineage(blocks).persist()
    state = rows.select("_pair", "cid_b").distinct().select(
        "_pair", "cid_b", F.lit(0.0).alias("price"), F.lit(-1).alias("owner"))
    eps, rounds = max(1.0, (rows.agg(F.max(F.abs("sim"))).first()[0] or 0) * scale), 0
    try:
        while True:
            fresh, left = True, 1
            while left:
                rounds += 1
                state = _settled(state, _claims(blocks, state, eps, fresh))
                fresh, left = False, state.where("owner < 0").count()
            if eps <= 1.0:
                break
            eps = max(1.0, eps / EPS_STEP)
        matched = cut_lineage(rows.join(state.select("_pair", "cid_b", F.col("owner").alias("cid_a")),
                                        ["_pair", "cid_a", "cid_b"]))
        primal = matched.join(sizes, "_pair").agg(F.sum(benefit)).first()[0]
        dual = (_claims(blocks, state, eps, False).agg(F.sum("best")).first()[0]
                + state.agg(F.sum("price")).first()[0])
    finally:
        blocks.unpersist()
    out = matched.select(*(F.col(f"_pair.{c}").alias(c) for c in key), "cid_a", "cid_b", "sim")
    return AuctionResult(out, float(dual - primal), rounds, int(primal))


def _settled(state: DataFrame, claims: DataFrame) -> DataFrame:
    """The state after a round: per column the highest price and who claims it."""
    offers = state.select("_pair", "cid_b", F.struct(
        "price", F.lit(0).alias("claimed"), F.lit(1).alias("row")).alias("o")).unionByName(
        claims.select("_pair", "cid_b", F.struct(
            "price", F.lit(1).alias("claimed"), (-F.col("cid_a")).alias("row")).alias("o")))
    best = offers.groupBy("_pair", "cid_b").agg(F.max("o").alias("o"))
    return cut_lineage(best.select("_pair", "cid_b", "o.price", (-F.col("o.row")).alias("owner")))


def _claims(blocks: DataFrame, state: DataFrame, eps: float, fresh: bool) -> DataFrame:
    """``_pair, cid_a, cid_b, price, best``: the column that each row claims, at
    which price, and its best value. With ``fresh`` a row first gives up a
    column that is no longer within ``eps`` of its best."""
    known = state.groupBy("_pair").agg(  # K rows a pair
        F.sort_array(F.collect_list(F.struct("cid_b", "price", "owner"))).alias("columns"))

    def fn(batches):
        for b in batches:
            for n in range(b.num_rows):
                cells, columns = (b.column(c).slice(n, 1).flatten() for c in ("cells", "columns"))
                ids, price, owner = (columns.field(c).to_numpy() for c in ("cid_b", "price", "owner"))
                mine, at = np.unique(cells.field("cid_a").to_numpy(), return_inverse=True)
                value = np.full((len(mine), len(ids)), -np.inf)
                value[at, np.searchsorted(ids, cells.field("cid_b").to_numpy())] = cells.field("b").to_numpy()
                best = (value - price).max(axis=1)
                column, offer = _bid(value, price.copy(), _held(mine, owner), eps, fresh)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_pair").take(pa.array(np.full(len(mine), n))), pa.array(mine, pa.int32()),
                     pa.array(ids[column], pa.int32()), pa.array(offer[column]), pa.array(best)],
                    names=["_pair", "cid_a", "cid_b", "price", "best"])

    schema = T.StructType([blocks.schema["_pair"], T.StructField("cid_a", T.IntegerType()),
                           T.StructField("cid_b", T.IntegerType()), T.StructField("price", T.DoubleType()),
                           T.StructField("best", T.DoubleType())])
    return blocks.join(known, "_pair").select("_pair", "cells", "columns").mapInArrow(fn, schema)


def _held(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per row the column it owns, or -1."""
    out = np.full(len(rows), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(rows, owner), len(rows) - 1)
    ours = np.flatnonzero((owner >= 0) & (rows[at] == owner))
    out[at[ours]] = ours
    return out


def _bid(value: np.ndarray, price: np.ndarray, column: np.ndarray, eps: float,
         fresh: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows without a column bid in turn for their best one, raising its price
    by the margin to the second best and ``eps``, until none is left."""
    if fresh:
        held = np.flatnonzero(column >= 0)
        short = value[held, column[held]] - price[column[held]] < (value[held] - price).max(axis=1) - eps
        column[held[short]] = -1
    holder = np.full(len(price), -1, dtype=np.int64)
    holder[column[column >= 0]] = np.flatnonzero(column >= 0)
    waiting = np.flatnonzero(column < 0)[::-1].tolist()
    while waiting:
        i = waiting.pop()
        v = value[i] - price
        j = int(v.argmax())
        top, v[j] = v[j], -np.inf
        second = v.max()
        price[j] += (top - second if np.isfinite(second) else 0.0) + eps
        if holder[j] >= 0:
            column[holder[j]] = -1
            waiting.append(int(holder[j]))
        holder[j], column[i] = i, j
    return column, price


def cluster_overlap(words_a: DataFrame, words_b: DataFrame, matched: DataFrame) -> DataFrame:
    """For each matched pair of clusters (``PAIR + cid_a, cid_b, sim``),
    common distinct words over the words in either (at least 1), and both set
    sizes. ``words_a`` and ``words_b``: known words of the runs."""
    def side(words, s):
        return words.select(F.col("slug").alias(f"slug_{s}"), F.col("method").alias(f"method_{s}"), "k",
                            "word", F.col("cluster").alias(f"cid_{s}")).distinct()
    a, b = side(words_a, "a"), side(words_b, "b")
    ka, kb = ["slug_a", "method_a", "k", "cid_a"], ["slug_b", "method_b", "k", "cid_b"]
    size_a = a.groupBy(*ka).agg(F.count(F.lit(1)).alias("size_a"))
    size_b = b.groupBy(*kb).agg(F.count(F.lit(1)).alias("size_b"))
    pairs = matched.select(*PAIR, "cid_a", "cid_b")
    inter = (a.join(pairs, ka).join(b, [*kb, "word"])
             .groupBy(*PAIR, "cid_a", "cid_b").agg(F.count(F.lit(1)).alias("inter")))
    out = (matched.join(inter, [*PAIR, "cid_a", "cid_b"], "left")
           .join(size_a, ka, "left").join(size_b, kb, "left")
           .fillna(0, ["inter", "size_a", "size_b"]))
    union = F.greatest(F.col("size_a") + F.col("size_b") - F.col("inter"), F.lit(1))
    return out.select(*PAIR, "cid_a", "cid_b", "sim", (F.col("inter") / union).alias("jaccard"),
                      F.col("size_a").cast("long").alias("size_a"),
                      F.col("size_b").cast("long").alias("size_b"))


def alignment(asg_a: DataFrame, asg_b: DataFrame, vectors: DataFrame, normed: bool = True,
              method: str = "optimal", pairs: DataFrame | None = None) -> DataFrame:
    """A21 for all ``pairs`` of runs (default: every run of A with every run of
    B of its K; a run without a partner is an error): match clusters one-to-one
    by centroid cosine (``optimal`` = maximum total, or ``greedy``) and report
    ``PAIR + cid_a, cid_b, centroid_cosine, jaccard, size_a, size_b``. Centroids
    (A8) use each run's K; sizes count distinct words that have a vector."""
    ka, kb = known_words(asg_a, vectors), known_words(asg_b, vectors)
    for side, known in (("A", ka), ("B", kb)):
        require_rows(known, f"assigned words of side {side} that have a vector")

    def centroids(known, asg):
        k_of_run = asg.select(*RUN_KEY).distinct().withColumn("k_total", F.col("k"))
        return centroid_mean(known, vectors, k_of_run, normalize_members=normed)
    pairs = run_pairs(asg_a, asg_b) if pairs is None else pairs
    sim = cut_lineage(centroid_similarity(centroids(ka, asg_a), centroids(kb, asg_b), pairs))
    if method == "greedy":
        matched = greedy_match(sim)
    elif method == "optimal":
        matched = optimal_match(sim).matching
    else:
        raise ValueError(f"unknown method {method!r}")
    return cluster_overlap(ka, kb, matched).withColumnRenamed("sim", "centroid_cosine")


def pair_file(df: DataFrame) -> F.Column:
    """The reference's file name of an alignment table."""
    return F.concat(F.lit("alignment_"), F.col("slug_a"), F.lit("_"), F.col("method_a"), F.lit("__"),
                    F.col("slug_b"), F.lit("_"), F.col("method_b"), F.lit("_K"),
                    F.col("k").cast("string"), F.lit(".csv"))


def alignment_summary(alignments: DataFrame) -> DataFrame:
    """A22 (and A21's summary): per table (``file``) and K, the mean and
    exact median centroid cosine, the mean Jaccard and the number of pairs."""
    df = alignments if "file" in alignments.columns else alignments.withColumn("file", pair_file(alignments))
    return df.groupBy("file", F.col("k").alias("K")).agg(
        F.avg("centroid_cosine").alias("mean_centroid_cosine"),
        F.median("centroid_cosine").alias("median_centroid_cosine"),
        F.avg("jaccard").alias("mean_jaccard"),
        F.count(F.lit(1)).cast("long").alias("pairs"))


def matched_cluster(alignments: DataFrame, cid: int) -> DataFrame:
    """The partner and cosine of one cluster of run A."""
    return alignments.filter(F.col("cid_a") == cid).select(
        "cid_a", "cid_b", "centroid_cosine")
