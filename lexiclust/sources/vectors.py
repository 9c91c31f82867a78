"""Word-vector files.

A ``.vec`` file is a header ``N D`` followed by ``word x1 .. xD`` lines; the
line order is the rank. Gzip files arrive as one split, so the rows are
spread once after numbering; convert them to Parquet once and read that.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.operators.numbering import global_rank
from lexiclust.session import spread

def vec_slug(path: str) -> str:
    """P10 on a path string: ``<parent>-<name without .vec.gz/.vec/.bin>``."""
    parent = os.path.basename(os.path.dirname(path.rstrip("/")))
    stem = os.path.basename(path).replace(".vec.gz", "").replace(".vec", "").replace(".bin", "")
    return f"{parent}-{stem}"


def parse_vectors(lines: DataFrame, slug: str, max_words: int | None = None) -> DataFrame:
    """S2 over lines (``line_no`` in file order, the header first, and ``line``):
    ``slug, rank, word, vec array<float>``. The first ``max_words`` distinct words
    are kept; a repeated word keeps its first vector, and ``rank`` numbers the
    distinct words."""
    head = lines.agg(F.min("line_no").alias("_head"))  # one row
    body = lines.join(F.broadcast(head), F.col("line_no") > F.col("_head")).select(
        "line_no", F.split(F.trim("line"), " ").alias("p"))
    vecs = body.select("line_no", F.col("p")[0].alias("word"),
                       F.slice("p", 2, F.size("p") - 1).cast("array<float>").alias("vec"))
    # a repeated word keeps its first line (aggregation: partial, then final)
    first = vecs.groupBy("word").agg(F.min(F.struct("line_no", "vec")).alias("_f"))
    kept = first.select(F.col("_f.line_no").alias("_line"), "word", F.col("_f.vec").alias("vec"))
    # ranks count the distinct words: no gaps where a word was repeated
    ranked = global_rank(kept, [F.asc("_line")]).withColumn("rank", F.col("rank") - 1)
    if max_words:
        ranked = ranked.filter(F.col("rank") < max_words)
    return ranked.select(F.lit(slug).alias("slug"), "rank", "word", "vec")


def read_vectors(spark: SparkSession, path: str, max_words: int | None = None,
                 slug: str | None = None) -> DataFrame:
    """S2 from a ``.vec`` file."""
    if not os.path.exists(path) and "://" not in path:
        raise FileNotFoundError(path)
    raw = spread(spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))
    return parse_vectors(raw, slug or vec_slug(path), max_words)


def render_vectors(vectors: DataFrame, digits: int = 6) -> DataFrame:
    """K3 as lines: ``line_no, line`` with the header ``N D`` first, then one
    line per word with ``digits`` decimals, in rank order."""
    fmt = F.transform(F.col("vec").cast("array<double>"), lambda x: F.format_string(f"%.{digits}f", x))
    body = vectors.select((F.col("rank") + 1).cast("long").alias("line_no"),
                          F.concat_ws(" ", F.col("word"), F.array_join(fmt, " ")).alias("line"))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d"))
    header = size.select(F.lit(0).cast("long").alias("line_no"),
                         F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("line"))
    return header.unionByName(body)


def write_vectors(vectors: DataFrame, path: str, digits: int = 6) -> None:
    """K3: a ``.vec`` text folder. The part files, read in name order, form the
    file; no single task writes everything."""
    (render_vectors(vectors, digits).repartitionByRange("line_no").sortWithinPartitions("line_no")
     .select("line").write.mode("overwrite").text(path))


def vector_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Known vector files as a table ``slug, path`` (P10 names them)."""
    return spark.createDataFrame([(vec_slug(p), p) for p in paths], "slug string, path string")


def resolve_vectors(catalog: DataFrame, family: str, name_like: str = "%") -> DataFrame:
    """The vector set that a run uses, as the one row ``slug, path``: of the
    catalog's sets of a ``family`` (P11: baseline, lemma or raw) whose slug is
    ``LIKE name_like``, the one with the smallest slug. No row if there is none."""
    from lexiclust.operators.runs import run_family
    fits = catalog.filter((run_family(F.col("slug")) == family) & F.col("slug").like(name_like))
    return (fits.groupBy().agg(F.min(F.struct("slug", "path")).alias("_m"))
            .filter("_m IS NOT NULL").select("_m.slug", "_m.path"))


def toplist_for(slug: str, toplists: dict[str, str]) -> str | None:
    """The toplist of a vector set when none is configured: that of its family,
    from ``{family: path}``."""
    family = "lemma" if "lemma" in slug.lower() else "raw"
    return toplists.get(family)
