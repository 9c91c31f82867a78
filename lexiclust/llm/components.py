"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id of ``links`` (columns ``a``, ``b``): the
    smallest id that can be reached.

    Each round points every vertex at its smallest neighbour and contracts the
    links to what they point at; a star takes one round, and all vertices but
    the local minima go in each. Loops and repeated links are harmless.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    found = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    found = found.withColumn("component", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("to"))
        found = found.join(near, F.col("component") == F.col("a"), "left").select(
            "id", F.coalesce("to", "component").alias("component"))
        left = near.select(F.col("a").alias("_a"), F.col("to").alias("_ta"))
        right = near.select(F.col("a").alias("_b"), F.col("to").alias("_tb"))
        contracted = edges.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
        edges = stored(contracted.where("_ta <> _tb").select(
            F.least("_ta", "_tb").alias("a"), F.greatest("_ta", "_tb").alias("b")).distinct(), "edges")
    return stored(found, "found")
