"""Session helpers: building a session for tests and benches, the checkpoint
folder, and a size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest measured side we broadcast.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "lexiclust") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller builds its own."""
    master = master or os.environ.get("LEXICLUST_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXICLUST_DRIVER_MEM", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by whoever runs the job (a shared
    file system). Only a local-mode session without one gets a scratch
    folder of its own, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared folder")
    path = tempfile.mkdtemp(prefix="lexiclust-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    back: lineage ends at files that every executor can read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiclust-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its rows are measured to take at most
    ``max_bytes`` (strings and arrays by their sizes, other values as 8 bytes).
    Beyond that it stays a shuffled side and the planner (with AQE) decides."""
    # measured once and kept (memory, then disk), so that neither the broadcast nor a
    # shuffled join, which may read it for several jobs, derives it again
    kept = df.persist()
    return F.broadcast(kept) if table_bytes(kept) <= max_bytes else kept


def sharded_lookup(rows: DataFrame, table: DataFrame, key: str, value: str,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES, max_shards: int = 8) -> DataFrame:
    """``rows`` with the column ``value`` of ``table`` (unique in ``key``), null without a
    match. A table beyond ``max_bytes`` is dealt by hash into up to ``max_shards`` parts of
    about that size, each broadcast by itself, so rows stay where they are; a larger one is
    a shuffled side."""
    kept = table.select(key, value).persist()
    shards = max(1, -(-table_bytes(kept) // max_bytes))
    if shards > max_shards:
        return rows.join(kept, key, "left")
    names = [f"_{value}{i}" for i in range(shards)]
    for i, name in enumerate(names):
        part = kept.filter(F.pmod(F.xxhash64(key), F.lit(shards)) == i).withColumnRenamed(value, name)
        rows = rows.join(F.broadcast(part), key, "left")
    return rows.withColumn(value, F.coalesce(*names)).drop(*names)


def table_bytes(df: DataFrame) -> int:
    """Bytes of all values: one aggregation over the table."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            size = size + F.greatest(F.size(c), F.lit(0)) * 8
        else:
            size = size + F.lit(8)
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def spread(df: DataFrame, min_partitions: int | None = None, rows: int | None = None,
           rows_per_partition: int = 20_000) -> DataFrame:
    """Round-robin ``df`` over the cluster when its scan has fewer partitions
    than there are cores (a small file read as one split). Large inputs
    already have enough splits and are left alone: no shuffle. With a known
    row count, no partition gets fewer than ``rows_per_partition`` rows, so
    tiny inputs are not cut into tasks that cost more than they do."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if rows is not None:
        want = max(1, min(want, -(-rows // rows_per_partition)))
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexiclust`` importable in the Python workers, whatever their
    working folder: a zip of the sources is added to the job's Python files,
    which the driver serves to every executor. Once per application."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lexiclust-src-"), "lexiclust_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(pkg)):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(app)
