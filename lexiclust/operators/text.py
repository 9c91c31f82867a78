"""Corpus cleaning and vocabulary.

Input lines carry ``doc_id, line_pos, raw``; ``(doc_id, line_pos)`` is the
corpus order. Every "first seen" rule is a ``min`` over that key, so results
do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiclust.functions.text import (
    MIN_LINE_LENGTH, REFERENCE_KEEP_CLASS, LanguageProfile, is_blank, matches_profile,
    normalize_text)
from lexiclust.operators.numbering import exclusive_prefix, global_rank, order_fields, packed_order
from lexiclust.session import bounded_broadcast, sharded_lookup, table_bytes

LEMMA_PART_BYTES = 16 << 20  # text of the lines whose tokens are put together in one task
_SEG_BITS = 33  # read_lines numbers lines by partition in the high bits


def head_lines(lines: DataFrame, n: int, n_blocks: int | None = None) -> DataFrame:
    """P5: the first ``n`` raw lines in corpus order, counted before any filter
    (blank lines count). ``n <= 0`` keeps everything.

    Lines are counted per segment (a document, or one split of a file); a
    distributed prefix sum gives each segment its first global line number;
    only segments that start before ``n`` are joined back, and there are at
    most ``n`` of them.
    """
    if n <= 0:
        return lines
    spark = lines.sparkSession
    n_blocks = n_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seg = F.shiftright("line_pos", _SEG_BITS)
    segs = (lines.groupBy("doc_id", seg.alias("seg"))
            .agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_pos").alias("first_pos")))
    segs = segs.persist()
    try:
        starts = exclusive_prefix(segs, ["doc_id", "seg"], "n_lines", n_blocks)
        head = starts.filter(F.col("start") < n).select("doc_id", "seg", "start", "first_pos")
        head = bounded_broadcast(head.persist())
        out = (lines.withColumn("seg", seg)
               .join(head, ["doc_id", "seg"])
               .filter(F.col("start") + (F.col("line_pos") - F.col("first_pos")) < n)
               .select(*lines.columns))
        return out
    finally:
        segs.unpersist()


def normalize_lines(lines: DataFrame, lowercase: bool = True,
                    keep_class: str = REFERENCE_KEEP_CLASS, use_nfkc: bool = True) -> DataFrame:
    """P2 then P1: drop blank lines, normalise the rest into ``text``."""
    return (lines.filter(~is_blank(F.col("raw")))
            .select("doc_id", "line_pos",
                    normalize_text(F.col("raw"), lowercase, keep_class, use_nfkc).alias("text")))


def min_length(df: DataFrame, n: int = MIN_LINE_LENGTH, col: str = "text") -> DataFrame:
    """Keep texts of at least ``n`` code points."""
    return df.filter(F.length(col) >= n)


def language_filter(df: DataFrame, profile: LanguageProfile, col: str = "text") -> DataFrame:
    """Keep texts matching the language profile."""
    return df.filter(matches_profile(F.col(col), profile))


def dedup_lines(df: DataFrame, with_copies: bool = False) -> DataFrame:
    """A1: one row per distinct ``text``; the first occurrence stays.

    Grouping by the text (partial aggregation first, so a line repeated a
    billion times costs one row per map partition)."""
    aggs = [F.min(F.struct("doc_id", "line_pos")).alias("first")]
    if with_copies:
        aggs.append(F.count(F.lit(1)).alias("copies"))
    out = df.groupBy("text").agg(*aggs)
    cols = [F.col("first.doc_id").alias("doc_id"), F.col("first.line_pos").alias("line_pos"), "text"]
    if with_copies:
        cols.append("copies")
    return out.select(*cols)


def clean_lines(lines: DataFrame, min_len: int = MIN_LINE_LENGTH, lowercase: bool = True,
                profile: LanguageProfile | None = None, head: int = 0,
                use_nfkc: bool = True) -> DataFrame:
    """``clean-text``: P5, P2, P1, P3, P4 (when a profile is given), A1.

    The keep-class follows the profile (the reference class without one).
    Each line is normalised next to its length and profile tests; a rejected
    line's key is null, so its text never enters the exchange.
    """
    keep = profile.keep_class if profile else REFERENCE_KEEP_CLASS
    df = head_lines(lines, head) if head else lines
    text = normalize_text(F.col("raw"), lowercase, keep, use_nfkc)
    df = df.select("doc_id", "line_pos", text.alias("text"), is_blank(F.col("raw")).alias("blank"))
    ok = (F.length("text") >= min_len) & ~F.col("blank")
    if profile is not None:
        ok = ok & matches_profile(F.col("text"), profile)
    # rejected lines share the null key: one row per map task, no text shuffled. They go
    # by their count: a test of the key itself would be moved below the aggregation, where
    # every line would be normalised once more for it
    df = df.select("doc_id", "line_pos", F.when(ok, F.col("text")).alias("key"))
    out = df.groupBy("key").agg(F.min(F.struct("doc_id", "line_pos")).alias("first"),
                                F.count("key").alias("_n"))
    return out.filter(F.col("_n") > 0).select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.line_pos").alias("line_pos"),
        F.col("key").alias("text"))


def clean_counters(lines: DataFrame, min_len: int = MIN_LINE_LENGTH, lowercase: bool = True,
                   profile: LanguageProfile | None = None, head: int = 0,
                   use_nfkc: bool = True) -> DataFrame:
    """A2: total lines read, non-blank, long enough, in profile, and kept
    (= unique) lines, in one row. One shuffle (by text) for the uniques."""
    keep = profile.keep_class if profile else REFERENCE_KEEP_CLASS
    df = head_lines(lines, head) if head else lines
    blank = is_blank(F.col("raw"))
    text = normalize_text(F.col("raw"), lowercase, keep, use_nfkc)
    df = df.select(blank.alias("blank"), F.when(~blank, text).alias("text"))
    long_enough = (~F.col("blank")) & (F.length("text") >= min_len)
    passes = long_enough & matches_profile(F.col("text"), profile) if profile else long_enough
    df = df.select("blank", long_enough.alias("long"), passes.alias("pass"),
                   F.when(passes, F.col("text")).alias("key"))
    per_key = df.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("blank").cast("long")).alias("n_blank"),
        F.sum(F.col("long").cast("long")).alias("n_long"),
        F.sum(F.col("pass").cast("long")).alias("n_pass"))
    return per_key.agg(
        F.sum("n").cast("long").alias("total_lines"),
        (F.sum("n") - F.sum("n_blank")).cast("long").alias("nonblank_lines"),
        F.sum("n_long").cast("long").alias("long_lines"),
        F.sum("n_pass").cast("long").alias("profile_lines"),
        F.count("key").cast("long").alias("kept_lines"),
    )


def tokenize(df: DataFrame, col: str = "text", keep: tuple = ()) -> DataFrame:
    """Split on white space: ``doc_id, line_pos, tok_pos, token``, and the line's
    columns ``keep``."""
    return (df.select("doc_id", "line_pos", *keep,
                      F.posexplode(F.split(F.col(col), r"(?U)\s+")).alias("tok_pos", "token"))
            .filter(F.col("token") != "")
            .select("doc_id", "line_pos", F.col("tok_pos").cast("long").alias("tok_pos"), "token", *keep))


def token_counts(tokens: DataFrame) -> DataFrame:
    """A5: ``token, n, first`` where ``first`` is the first occurrence key."""
    packed, unpacked = packed_order(tokens, ["doc_id", "line_pos", "tok_pos"])
    return tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.min(packed).alias("first")).select(
        "token", "n", unpacked(F.col("first")).alias("first"))


def top_vocab(tokens: DataFrame, n: int | None = None) -> DataFrame:
    """A6 + W1: the ``n`` most frequent tokens (all of them by default), ties to
    the first occurrence, as ``rank, token, n``.

    The counts are aggregated once and ranked without a global window."""
    ranked = global_rank(token_counts(tokens), [F.desc("n"), F.asc("first")])
    ranked = ranked.select("rank", "token", F.col("n").cast("long").alias("n"))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def lemma_lexicon(treebank: DataFrame) -> DataFrame:
    """Form-to-lemma lexicon for M8: per lowercase form, the most frequent
    lemma, ties to the first seen. Input ``form, lemma, ord``."""
    packed, _ = packed_order(treebank, order_fields(treebank))
    per = (treebank.groupBy(F.lower("form").alias("form"), "lemma")
           .agg(F.count(F.lit(1)).alias("c"), F.min(packed).alias("o")))
    w = Window.partitionBy("form").orderBy(F.desc("c"), F.asc("o"))
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").select("form", "lemma")


def lexicon_lemmatize(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """M8 as a data job: each token of each line replaced by its lexicon lemma
    (unknown tokens unchanged), lines regrouped in token order; lines without
    tokens are dropped. Output ``doc_id, line_pos, text``."""
    # lines are dealt by their key before they become tokens, which then meet again without
    # a shuffle; the parts are sized by their text, as their tokens are many times as large.
    # A form that is its own lemma is as good as unknown
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                table_bytes(lines.select("text")) // LEMMA_PART_BYTES)
    toks = tokenize(lines.repartition(parts, "doc_id", "line_pos"))
    lex = lexicon.filter(F.col("lemma") != F.col("form")).withColumnRenamed("form", "token")
    mapped = sharded_lookup(toks, lex, "token", "lemma").select(
        "doc_id", "line_pos", "tok_pos", F.coalesce("lemma", "token").alias("lemma"))
    return (mapped.groupBy("doc_id", "line_pos")
            .agg(F.sort_array(F.collect_list(F.struct("tok_pos", "lemma"))).alias("t"))
            .select("doc_id", "line_pos", F.array_join(F.col("t.lemma"), " ").alias("text")))
