"""Columns compared after ``round(x, 6)`` on both sides (SURVEY's "T"
checks): floating-point sums differ in their last bits between engines."""

from __future__ import annotations

DIGITS = 6

T_COLUMNS: dict[str, list[str]] = {
    "purity": ["purity"],
    "homogeneity_completeness": ["homogeneity", "completeness"],
    "nmi_v": ["NMI", "V"],
    "silhouette_euclid": ["silhouette"],
    "silhouette_cosine": ["silhouette"],
    "silhouette_sampled": ["silhouette"],
    "label_metrics": ["purity", "NMI", "V", "homogeneity", "completeness", "silhouette"],
    "label_metrics_pos": ["purity", "NMI", "V", "homogeneity", "completeness", "silhouette"],
    "suffix_purity": ["purity"],
    "pos_profile": ["pos_purity", "pos_entropy"],
    "msi": ["msi"],
    "cluster_stats": ["suffix2_purity", "suffix3_purity", "suffix4_purity", "max_suffix_purity",
                      "pos_purity", "pos_entropy", "pos_coverage", "msi"],
    "parse_stats_tables": ["suffix2_purity", "suffix3_purity", "suffix4_purity", "max_suffix_purity",
                           "pos_purity", "pos_entropy", "pos_coverage", "msi"],
    "parse_alignments": ["centroid_cosine", "jaccard"],
    "macro_means": ["suffix_mean", "pos_purity_mean", "pos_entropy_mean", "pos_coverage_mean",
                    "msi_mean"],
    "suggest_semantic": ["pos_purity", "pos_entropy", "pos_coverage", "max_suffix_purity", "msi",
                         "score"],
    "suggest_morphological": ["pos_purity", "pos_entropy", "pos_coverage", "max_suffix_purity",
                              "msi", "score"],
    "extreme_cluster": ["lowest_msi", "highest_msi"],
    "canonical_columns": ["max_suffix_purity", "pos_purity", "pos_entropy", "pos_coverage", "msi"],
    "centroid_similarity": ["sim"],
    "greedy_match": ["sim"],
    "optimal_match": ["sim"],
    "cluster_overlap": ["jaccard"],
    "alignment": ["centroid_cosine", "jaccard"],
    "alignment_greedy": ["centroid_cosine", "jaccard"],
    "alignment_summary": ["mean_centroid_cosine", "median_centroid_cosine", "mean_jaccard"],
    "matched_cluster": ["centroid_cosine"],
    "speedup": ["speedup"],
    "top_words": ["sim"],
    "shifted_ppmi": ["x"],
    "metric_series": ["value", "lo", "hi"],
}


def round_df(name: str, df):
    from pyspark.sql import functions as F
    for c in T_COLUMNS.get(name, []):
        df = df.withColumn(c, F.round(F.col(c), DIGITS))
    return df


def round_sql(name: str, sql: str) -> str:
    cols = T_COLUMNS.get(name)
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"
