"""Per-cluster statistics and the choices made from them
(P9, P12, P15, A7, A15-A19, A29, L1, L5).

Input: assignments ``slug, method, k, word, cluster`` for any number of runs,
the run's vector set (membership and file order) and a word-to-tag map. One
job covers every run; nothing loops over clusters.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiclust.operators.labels import sample_lowest_hash
from lexiclust.session import bounded_broadcast

RUN_KEY = ["slug", "method", "k"]
CKEY = RUN_KEY + ["cid"]

# Fixed values of the reference: suffix lengths, entropy guard and tag count,
# and the defaults for choosing clusters.
SUFFIX_LENGTHS = (2, 3, 4)
ENTROPY_EPS = 1e-12
N_UPOS_TAGS = 17
SUGGEST_TOPN = 8
SUGGEST_MIN_SIZE = 15
SAMPLE_WORDS = 40

STAT_COLUMNS = [
    "cid", "size", "suffix2", "suffix2_purity", "suffix3", "suffix3_purity", "suffix4",
    "suffix4_purity", "max_suffix_purity", "top_pos", "pos_purity", "pos_entropy",
    "pos_coverage", "msi"]


def _members(assignments: DataFrame, vectors: DataFrame) -> DataFrame:
    """J2 with the file order: assigned words that have a vector, with ``rank``."""
    keys = vectors.select("slug", "word", "rank")
    return (assignments.select(*RUN_KEY, "word", F.col("cluster").alias("cid"))
            .join(keys, ["slug", "word"]))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """Assignment rows per cluster, words without a vector included."""
    return (assignments.groupBy(*RUN_KEY, F.col("cluster").alias("cid"))
            .agg(F.count(F.lit(1)).cast("long").alias("size")))


def _top_share(counts: DataFrame, part: list[str], value: str) -> DataFrame:
    """Per ``part`` the value with the highest ``c`` (ties: lowest ``o``), its
    share of the total, and the total."""
    first = F.min_by(F.struct(F.col(value).alias("v"), "c"), F.struct((-F.col("c")).alias("c"), "o"))
    best = counts.groupBy(*part).agg(first.alias("_best"), F.sum("c").alias("_tot"))
    return best.select(*part, F.col("_best.v").alias("top"),
                       (F.col("_best.c") / F.col("_tot")).alias("share"), "_tot")


def suffix_purity(members: DataFrame, lengths=SUFFIX_LENGTHS) -> DataFrame:
    """A15 (+P9): per cluster and L, the commonest last-L letters among member
    words of at least L letters, ties to the first word in file order, and
    its share. Output ``run, cid, L, suffix, purity`` for clusters that have
    such words (the rest get ``""`` and 0 when joined)."""
    exploded = (members.select(*CKEY, "word", "rank",
                               F.explode(F.array(*[F.lit(L) for L in lengths])).alias("L"))
                .filter(F.length("word") >= F.col("L")))
    exploded = exploded.withColumn("suffix", F.expr("substring(word, -L, L)"))
    counts = exploded.groupBy(*CKEY, "L", "suffix").agg(
        F.count(F.lit(1)).alias("c"), F.min("rank").alias("o"))
    top = _top_share(counts, CKEY + ["L"], "suffix")
    return top.select(*CKEY, "L", F.col("top").alias("suffix"), F.col("share").alias("purity"))


def pos_profile(members: DataFrame, word_map: DataFrame) -> DataFrame:
    """Per cluster the top tag among covered members (lowercase lookup,
    ties to the first word in file order), its share, the entropy
    ``-sum p ln(p + 1e-12) / ln 17`` and the covered count. Clusters without
    covered words are absent."""
    m = bounded_broadcast(word_map.select(F.col("word").alias("_key"), "upos"))
    tagged = members.join(m, F.lower(F.col("word")) == F.col("_key"))
    counts = tagged.groupBy(*CKEY, "upos").agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("o"))
    # one row a cluster and tag from here: top tag and entropy in one aggregation
    share = F.col("c") / F.col("_tot")
    first = F.min_by(F.struct("upos", "c"), F.struct((-F.col("c")).alias("c"), "o"))
    out = counts.withColumn("_tot", F.sum("c").over(Window.partitionBy(*CKEY))).groupBy(*CKEY).agg(
        first.alias("_best"), F.first("_tot").alias("covered"),
        (-F.sum(share * F.log(share + F.lit(ENTROPY_EPS))) / F.lit(math.log(N_UPOS_TAGS))).alias("pos_entropy"))
    return out.select(*CKEY, F.col("_best.upos").alias("top_pos"),
                      (F.col("_best.c") / F.col("covered")).alias("pos_purity"), "pos_entropy", "covered")


def cluster_stats(assignments: DataFrame, vectors: DataFrame, word_map: DataFrame) -> DataFrame:
    """The reference's 14 statistics per cluster of every run (A7, A15,
    A16, A17), plus ``pos_covered``. An uncovered cluster has POS purity 0, so
    its MSI is minus its suffix purity (the reference's rule)."""
    members = _members(assignments, vectors)
    sizes = cluster_sizes(assignments)
    suf = suffix_purity(members)
    wide = suf.groupBy(*CKEY).pivot("L", list(SUFFIX_LENGTHS)).agg(
        F.first("suffix").alias("s"), F.first("purity").alias("p"))
    pos = pos_profile(members, word_map)
    out = sizes.join(wide, CKEY, "left").join(pos, CKEY, "left")
    cols = [*RUN_KEY, F.col("cid").cast("int").alias("cid"), "size"]
    for L in SUFFIX_LENGTHS:
        cols.append(F.coalesce(F.col(f"{L}_s"), F.lit("")).alias(f"suffix{L}"))
        cols.append(F.coalesce(F.col(f"{L}_p"), F.lit(0.0)).alias(f"suffix{L}_purity"))
    cols += [F.coalesce("top_pos", F.lit("")).alias("top_pos"),
             F.coalesce("pos_purity", F.lit(0.0)).alias("pos_purity"),
             F.coalesce("pos_entropy", F.lit(0.0)).alias("pos_entropy"),
             (F.coalesce("covered", F.lit(0)) / F.greatest(F.col("size"), F.lit(1))).alias("pos_coverage")]
    out = out.select(*cols)
    max_suf = F.greatest(*[F.col(f"suffix{L}_purity") for L in SUFFIX_LENGTHS])
    return (out.withColumn("max_suffix_purity", max_suf)
            .withColumn("msi", F.col("pos_purity") - F.col("max_suffix_purity"))
            .withColumn("pos_covered", F.col("pos_coverage") > 0)
            .select(*RUN_KEY, *STAT_COLUMNS, "pos_covered"))


def macro_means(stats: DataFrame) -> DataFrame:
    """Plain means over clusters per run."""
    return (stats.groupBy(*RUN_KEY).agg(
        F.avg("max_suffix_purity").alias("suffix_mean"),
        F.avg("pos_purity").alias("pos_purity_mean"),
        F.avg("pos_entropy").alias("pos_entropy_mean"),
        F.avg("pos_coverage").alias("pos_coverage_mean"),
        F.avg("msi").alias("msi_mean"))
        .select(F.col("slug").alias("vecslug"), "method", F.col("k").alias("K"), "suffix_mean",
                "pos_purity_mean", "pos_entropy_mean", "pos_coverage_mean", "msi_mean"))


def suggest_clusters(stats: DataFrame, kind: str = "semantic", topn: int = SUGGEST_TOPN,
                     min_size: int = SUGGEST_MIN_SIZE) -> DataFrame:
    """L1 (+P15): per run the first ``topn`` clusters of at least ``min_size``
    words. Semantic: MSI desc, POS purity desc, max suffix purity asc;
    morphological: MSI asc, max suffix purity desc, size desc; cid last."""
    df = stats.filter(F.col("size") >= min_size)
    if kind == "semantic":
        score = F.col("msi")
        order = [F.desc("_score"), F.desc("pos_purity"), F.asc("max_suffix_purity"), F.asc("cid")]
    elif kind == "morphological":
        score = -F.col("msi")
        order = [F.desc("_score"), F.desc("max_suffix_purity"), F.desc("size"), F.asc("cid")]
    else:
        raise ValueError(f"unknown kind {kind!r}")
    df = df.withColumn("_score", score)
    w = Window.partitionBy(*RUN_KEY).orderBy(*order)
    return (df.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= topn)
            .select(*RUN_KEY, F.col("pick").cast("int").alias("pick"), "cid", "size", "top_pos",
                    "pos_purity", "pos_entropy", "pos_coverage", "max_suffix_purity", "msi",
                    F.col("_score").alias("score")))


def extreme_cluster(stats: DataFrame) -> DataFrame:
    """Per run the cluster with the lowest and the highest MSI (ties to
    the lowest cid)."""
    return stats.groupBy(*RUN_KEY).agg(
        F.min_by("cid", F.struct(F.col("msi"), F.col("cid"))).alias("lowest_cid"),
        F.min("msi").alias("lowest_msi"),
        F.min_by("cid", F.struct(-F.col("msi"), F.col("cid"))).alias("highest_cid"),
        F.max("msi").alias("highest_msi"))


def sample_words(assignments: DataFrame, n: int = SAMPLE_WORDS, seed: int = 42) -> DataFrame:
    """Per run and cluster, at most ``n`` member words: the lowest
    ``md5('seed:word')`` when the cluster is larger; all of them for ``n`` = 0."""
    return assignments if not n else sample_lowest_hash(assignments, [*RUN_KEY, "cluster"], n, seed)


# Fixed values of the reference: accepted spellings of the summary columns.
COLUMN_ALIASES = {
    "suffix": ["suffix_max_purity", "max_suffix_purity", "suffix_purity_max", "max-suffix-purity"],
    "pos_purity": ["pos_purity", "pos-purity"],
    "pos_entropy": ["pos_entropy", "pos-entropy"],
    "pos_coverage": ["pos_coverage", "pos-coverage", "coverage", "POS coverage"],
    "msi": ["msi", "MSI", "msi_pos_minus_suffix", "MSI (pos-suf)"],
}
ID_ALIASES = ["cluster", "cid", "cluster_id", "c"]


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def canonical_columns(df: DataFrame) -> DataFrame:
    """Statistics with whatever column spellings (case, signs and white
    space do not count), renamed to ``cid, size, max_suffix_purity, pos_purity,
    pos_entropy, pos_coverage, msi``. The first alias found wins; for the suffix
    purity any column that names both a suffix and a purity does at last. MSI is
    POS purity minus suffix purity when absent. Other missing columns come back
    null; no cluster id, or no way to MSI, is an error."""
    by_name = {_plain(c): c for c in reversed(df.columns)}
    keep = [c for c in df.columns if c in RUN_KEY]

    def pick(names):
        return next((by_name[_plain(n)] for n in names if _plain(n) in by_name), None)
    id_col = pick(ID_ALIASES)
    if id_col is None:
        raise ValueError(f"no cluster id column among {df.columns}")
    size = pick(["size"])
    picked = {canon: pick(names) for canon, names in COLUMN_ALIASES.items()}
    if picked["suffix"] is None:
        picked["suffix"] = next((c for c in df.columns if "suffix" in _plain(c) and "purity" in _plain(c)
                                 and c != picked["msi"]), None)
    none = F.lit(None).cast("double")
    value = {k: F.col(f"`{c}`").cast("double") if c else none for k, c in picked.items()}
    if picked["msi"] is None:
        if picked["pos_purity"] is None or picked["suffix"] is None:
            raise ValueError(f"MSI is neither among {df.columns} nor can be derived")
        value["msi"] = value["pos_purity"] - value["suffix"]
    value = {"max_suffix_purity" if k == "suffix" else k: v for k, v in value.items()}
    return df.select(*keep, F.col(f"`{id_col}`").cast("int").alias("cid"),
                     (F.col(f"`{size}`") if size else F.lit(None)).cast("long").alias("size"),
                     *(v.alias(k) for k, v in value.items()))
