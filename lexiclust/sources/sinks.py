"""Sinks (K1, K2, K4-K7) and input guards.

Ordered text outputs are range-partitioned on their order key and sorted
inside each partition: the part files, read in name order, are the ordered
file, and no single task writes it all. Only small result tables (metrics)
are written as one CSV.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ordered_text(df: DataFrame, order: list[str], col: str, path: str) -> None:
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(F.col(col).alias("value")).write.mode("overwrite").text(path))


def write_lines(lines: DataFrame, path: str) -> None:
    """K1: kept lines in corpus order."""
    _ordered_text(lines, ["doc_id", "line_pos"], "text", path)


def write_toplist(vocab: DataFrame, path: str) -> None:
    """K2: tokens in rank order."""
    _ordered_text(vocab, ["rank"], "token", path)


def _replace_runs(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` partitioned by ``by``; only the partitions it holds are
    replaced, other runs in the folder stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def write_run(assignments: DataFrame, runs: DataFrame, root: str) -> None:
    """K4: assignments and run rows, each partitioned by run. Writing a run
    again replaces it; all other runs stay. ``operators.runs`` reads both back."""
    root = root.rstrip("/")
    _replace_runs(assignments, f"{root}/assignments", ["slug", "method", "k"])
    keyed = runs.withColumns({"slug": F.col("vecslug"), "run_method": F.col("method"),
                              "run_k": F.col("K")})
    _replace_runs(keyed, f"{root}/runs", ["slug", "run_method", "run_k"])


def write_cluster_words(assignments: DataFrame, root: str, order: str = "rank") -> None:
    """K5: one word list per cluster (folder per run and cluster), in ``order``
    (by word where there is no such column). Large clusters are spread over
    ranges of it; the part files, read in name order, are the list."""
    by = ["slug", "method", "k", "cluster"]
    cols = [*by, order if order in assignments.columns else "word"]
    (assignments.repartitionByRange(*cols).sortWithinPartitions(*cols)
     .select(*by, F.col("word").alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).text(root))


def write_centroids(centroids: DataFrame, path: str) -> None:
    """K6: unit centroids per run (``cid, centroid``); other runs stay."""
    _replace_runs(centroids, path, ["slug", "method", "k"])


def write_metrics(df: DataFrame, path: str, order: list[str]) -> None:
    """K7: a small, sorted result table as one CSV with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class InputError(ValueError):
    """A missing or unusable input, raised before the main job."""


def require_rows(df: DataFrame, what: str, at_least: int = 1) -> None:
    """Fail early when ``df`` has fewer than ``at_least`` rows (reads at
    most ``at_least`` rows)."""
    if df.limit(at_least).count() < at_least:
        raise InputError(f"{what}: fewer than {at_least} rows")


def require_columns(df: DataFrame, cols: list[str], what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise InputError(f"{what}: missing columns {missing}")


def existing(read: Callable[[], DataFrame], what: str) -> DataFrame:
    """What ``read`` plans; a missing path is an ``InputError``."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise InputError(f"missing {what}") from e
        raise


def require_vector_paths(runs: DataFrame) -> None:
    """A run whose log names no vector file cannot be looked into."""
    bad = runs.filter(F.coalesce(F.col("vec"), F.lit("")) == "").select("log_path").first()
    if bad is not None:
        raise InputError(f"missing vec= in {bad['log_path']}")


def require_cluster(assignments: DataFrame, cid: int) -> None:
    """An unknown cluster id is an error."""
    if assignments.filter(F.col("cluster") == cid).limit(1).count() == 0:
        raise InputError(f"cluster {cid} not found")
