"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet under the shared checkpoint folder and hands the stored
table to the next. All but the last return the columns of ``docs``; extra
columns pass through, whatever their names. Rows are dropped only by the
decision a stage is named for:

- ``language_id`` drops texts in which no language is found (null, empty, or
  without a letter) or whose likeliest one has less than half the likelihood;
- ``quality`` drops texts that score below the operator's threshold;
- ``near_dedup`` keeps the document with the smallest id of each group;
- ``decontamination`` drops documents with a word inside a benchmark window;
- ``packing`` cuts and packs all that is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.llm import decontaminate, langid, neardup, packing, quality
from lexiclust.llm.common import stored, table
from lexiclust.session import ship_package

MIN_LANGUAGE_SHARE = 0.5
NEAR_THRESHOLD = 80  # percent of shared word shingles (operator 4's query has 85 by contract)
BROADCAST_IDS = 1_000_000
_MARK = "_lexiclust_stage"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found (operator 3)."""
    ship_package(spark)
    found = langid.predict(docs, langid.fit(docs), out=_MARK)
    return found.where((F.col(f"{_MARK}.lang_pred") != langid.UNKNOWN)
                       & (F.col(f"{_MARK}.score") >= MIN_LANGUAGE_SHARE)).drop(_MARK)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality (operator 1)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out=_MARK)
    return scored.where(F.col(_MARK) >= quality.THRESHOLD).drop(_MARK)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 4). Of rows that
    repeat both a doc_id and its text one stays; a repeated doc_id with another
    text, and rows without a doc_id, stay."""
    ship_package(spark)
    groups = stored(neardup.near_duplicates(docs, threshold=NEAR_THRESHOLD), "groups")
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias(_MARK)).distinct()
    kept = docs.join(_small(gone), F.col("doc_id") == F.col(_MARK), "left_anti")
    twice = stored(groups.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias(_MARK)).count().where("count > 1").select(_MARK), "twice")
    if twice.isEmpty():
        return kept
    same = F.col("doc_id") == F.col(_MARK)
    return kept.join(_small(twice), same, "left_anti").unionByName(
        kept.join(_small(twice), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast up to a million ids (8 MB); beyond that a shuffled join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window (operator 5)."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), out=_MARK)
    return found.where(F.col(f"{_MARK}.n_hit") == 0).drop(_MARK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed pieces with their token ids (operator 6), which
    ``packing.sequences`` joins."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The first two stages learn models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the packed pieces with their token ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
