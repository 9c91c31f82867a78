"""The driver's Parquet tables, read with column pruning left to Catalyst."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    if not os.path.exists(path) and "://" not in path:
        raise FileNotFoundError(path)
    return spark.read.parquet(path)
