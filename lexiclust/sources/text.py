"""Line sources (S1) and the toplist reader.

Every line carries an explicit order key ``(doc_id, line_pos)``; no operator
relies on partition order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.functions.text import unicode_strip
from lexiclust.session import bounded_broadcast
from lexiclust.sources.sinks import existing

LINE_COLUMNS = ("doc_id", "line_pos", "raw")


def lines_from_table(docs: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per line of each document: ``doc_id, line_pos, raw``.

    Lines are the pieces between newlines, in document order; a document
    contributes at least one (possibly empty) line.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_pos", "raw"),
    ).withColumn("line_pos", F.col("line_pos").cast("long"))


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """UTF-8 text files, one row per line: ``doc_id`` ranks the files by path,
    ``line_pos`` increases with the position in the file (not contiguous).

    One scan: the ranks come from the scan's own list of files, which the planner
    holds anyway."""
    raw = existing(lambda: spark.read.options(**options).text(path), f"input {path}")
    # a local path is written with one slash or three
    files = sorted(re.sub("^file:/+", "file:/", f) for f in raw.inputFiles())
    ranks = spark.createDataFrame([(f, n) for n, f in enumerate(files)], "file_path string, doc_id long")
    df = raw.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file_path"),
                    F.monotonically_increasing_id().alias("line_pos"), F.col("value").alias("raw"))
    return df.join(bounded_broadcast(ranks), "file_path").select(*LINE_COLUMNS)


def read_toplist(spark: SparkSession, path: str) -> DataFrame:
    """One token per line, trimmed, blanks dropped: ``token`` (distinct)."""
    return (spark.read.text(path)
            .select(unicode_strip(F.col("value")).alias("token"))
            .filter(F.col("token") != "")
            .distinct())
