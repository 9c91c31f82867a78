"""Distributed prefix sums over an ordered key.

A global ``Window.orderBy`` runs in one task. Here the key space is cut into
ranges by quantiles; running sums are taken inside each range (in parallel)
and the few range totals are added up on a table with one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def range_blocks(df: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Add ``_block``: the index of the quantile range holding ``key``."""
    if n_blocks <= 1:
        return df.withColumn("_block", F.lit(0))
    probs = [i / n_blocks for i in range(1, n_blocks)]
    bounds = sorted(set(df.approxQuantile(key, probs, 0.001)))
    if not bounds:
        return df.withColumn("_block", F.lit(0))
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    return df.withColumn(
        "_block", F.size(F.filter(arr, lambda b: b <= F.col(key).cast("double"))))


def exclusive_prefix(df: DataFrame, order_cols: list[str], size_col: str,
                     n_blocks: int) -> DataFrame:
    """Add ``start``: the sum of ``size_col`` over all rows before this one in
    ``order_cols`` order (the first order column must be numeric)."""
    blocked = range_blocks(df, order_cols[0], n_blocks)
    w = Window.partitionBy("_block").orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, -1)
    inner = blocked.withColumn("_inner", F.coalesce(F.sum(size_col).over(w), F.lit(0)))
    # one row per block
    totals = blocked.groupBy("_block").agg(F.sum(size_col).alias("_total"))
    wb = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(F.sum("_total").over(wb), F.lit(0)).alias("_offset"))
    return (inner.join(F.broadcast(offsets), "_block")
            .withColumn("start", (F.col("_offset") + F.col("_inner")).cast("long"))
            .drop("_block", "_inner", "_offset"))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in ``order`` (columns that tell all rows
    apart): rows are range-partitioned and stored once, numbered inside each
    partition and shifted by the sizes of the partitions before (one row each).
    No window spans more than one partition."""
    from lexiclust.session import cut_lineage
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (dealt.withColumn("_in", inside).join(F.broadcast(starts), "_part")
            .withColumn(name, (F.col("_start") + F.col("_in")).cast("long"))
            .drop("_part", "_in", "_start"))


def order_fields(df: DataFrame, order: str = "ord") -> list[str]:
    """The columns of an order key: the fields of a struct, or the column itself."""
    kind = df.schema[order].dataType
    return [f"{order}.{f}" for f in kind.names] if isinstance(kind, StructType) else [order]


def packed_order(df: DataFrame, order: list[str]) -> tuple:
    """``(packed, unpacked)``: the places ``order`` (whole-number columns) as one number of
    the same order, and a function of a column of such numbers that gives them back as a
    struct. Its least is kept in place by a hash aggregation, whereas that of a struct sorts
    all rows. The ranges are measured: a long where they fit one, else a decimal; a struct
    (which is given back as it is) where neither does or a place is null."""
    names = [n.rsplit(".", 1)[-1] for n in order]
    seen = df.agg(*(f(n).alias(f"{k}{i}") for i, n in enumerate(order) for k, f in (
        ("low", F.min), ("high", F.max), ("n", F.count))), F.count(F.lit(1)).alias("rows")).first()
    plain = F.struct(*(F.col(n) for n in order))
    if not seen["rows"] or any(seen[f"n{i}"] < seen["rows"] for i in range(len(order))):
        return plain, lambda c: c
    lows = [int(seen[f"low{i}"]) for i in range(len(order))]
    spans = [int(seen[f"high{i}"]) - low + 1 for i, low in enumerate(lows)]
    size = 1
    for span in spans:
        size *= span
    if size >= 10 ** 37:
        return plain, lambda c: c
    kind = "bigint" if size < 1 << 62 and all(-(1 << 62) < x < 1 << 62 for x in lows) else "decimal(38,0)"

    def number(x: int):
        return F.lit(str(x)).cast(kind)
    packed = number(0)
    for n, low, span in zip(order, lows, spans, strict=True):
        packed = (packed * number(span) + (F.col(n).cast(kind) - number(low))).cast(kind)

    def unpacked(c):
        c, parts = c.cast(kind), []
        for n, name, low, span in reversed(list(zip(order, names, lows, spans, strict=True))):
            rest = F.pmod(c, number(span)).cast(kind)
            parts.append((rest + number(low)).cast("bigint").alias(name))
            c = F.floor((c - rest) / number(span)).cast(kind) if kind == "bigint" else (c - rest) / number(span)
        return F.struct(*reversed(parts))
    return packed, unpacked
