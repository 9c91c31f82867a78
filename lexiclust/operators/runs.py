"""Run logs and the tables built from them.

A run log is ``key=value`` lines. Parsing is a DataFrame job: explode the
lines, split each at the first ``=``, keep the last value of every key, pivot
the known keys into typed columns with the reference's lenient rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiclust.functions.text import unicode_strip
from lexiclust.operators.numbering import global_rank
from lexiclust.sources.sinks import existing

# Fixed values of the reference: the keys of a run log, their types, the
# boolean spellings, the method names of the speedup, the metrics drawn
# against K and the padding of their range.
STRING_KEYS = ["vec", "vecslug", "method", "max_words"]
INT_KEYS = ["K", "N", "D", "iterations", "num_cores", "max_iter"]
BOOL_KEYS = ["normed"]
FLOAT_KEYS = ["secs"]
TRUE_WORDS = ["1", "true", "yes"]
SERIAL, PARALLEL = "serial", "parallel"
SERIES_METRICS = ["purity", "NMI", "V", "homogeneity", "completeness", "silhouette"]
PAD_FRACTION = 0.06
PAD_MIN = 1e-6

# Order of the families and methods in a figure's legend; others come after.
LEGEND_FAMILIES = ["baseline", "raw", "lemma"]
LEGEND_METHODS = [SERIAL, PARALLEL]

RUN_COLUMNS = ["vec", "vecslug", "method", "K", "N", "D", "normed", "iterations", "num_cores",
               "max_iter", "max_words", "secs", "log_path"]
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def _key_values(text: str) -> F.Column:
    """The lines of a log that have a ``=``, as ``pos, key, value``."""
    lines = F.filter(F.transform(F.split(F.col(text), _LINE_BREAK), lambda line, pos: F.struct(
        pos.alias("pos"), line.alias("line"))), lambda x: x["line"].contains("="))
    return F.transform(lines, lambda x: F.struct(
        x["pos"].alias("pos"), unicode_strip(F.substring_index(x["line"], "=", 1)).alias("key"),
        unicode_strip(F.substring(x["line"], F.instr(x["line"], F.lit("=")) + 1, F.length(x["line"]))).alias("value")))


def _last(key: str) -> F.Column:
    return F.try_element_at(F.filter("_pairs", lambda x: x["key"] == key), F.lit(-1))


def parse_run_logs(logs: DataFrame, path_col: str = "log_path", text_col: str = "text") -> DataFrame:
    """One typed row per log. Lines without ``=`` are ignored; key and
    value are stripped; the last value of a key wins. Integers that do not
    parse read 0, numbers NaN, booleans are 1 for ``1``/``true``/``yes``."""
    keys = STRING_KEYS + INT_KEYS + BOOL_KEYS + FLOAT_KEYS
    # the lines of a log stay in its row: its last line of every known key. Logs are dealt
    # by path first, so rows of one path meet without a sort before the shuffle (which also
    # keeps the pairs from being made once for every key)
    pairs = logs.select(F.col(path_col).alias("log_path"), _key_values(text_col).alias("_pairs"))
    last = pairs.filter(F.col("_pairs").isNotNull()).repartition("log_path").select(
        "log_path", *[_last(k).alias(k) for k in keys])
    wide = last.groupBy("log_path").agg(*[
        F.max_by(F.col(f"`{k}`.value"), F.col(f"`{k}`.pos")).alias(k) for k in keys])
    cols = {}
    for k in STRING_KEYS:
        cols[k] = F.coalesce(F.col(f"`{k}`"), F.lit(""))
    for k in INT_KEYS:
        v = F.col(f"`{k}`")
        cols[k] = F.when(v.rlike(r"^[+-]?[0-9]+$"), F.expr(f"try_cast(`{k}` AS BIGINT)")).otherwise(
            F.lit(0)).cast("long")
        cols[k] = F.coalesce(cols[k], F.lit(0).cast("long"))
    for k in BOOL_KEYS:
        cols[k] = F.when(F.lower(F.col(f"`{k}`")).isin(TRUE_WORDS), F.lit(1)).otherwise(F.lit(0)).cast("long")
    for k in FLOAT_KEYS:
        cols[k] = F.coalesce(F.expr(f"try_cast(`{k}` AS DOUBLE)"), F.lit(float("nan")))
    return wide.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in RUN_COLUMNS])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """S5 from files: every ``run.log`` under ``root`` (recursively)."""
    logs = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "run.log")
            .option("wholetext", "true").text(root)
            .select(F.col("_metadata.file_path").alias("log_path"), F.col("value").alias("text")))
    return parse_run_logs(logs)


def read_assignments(spark: SparkSession, root: str) -> DataFrame:
    """Every ``assignments.csv`` under ``root/<slug>/<method>/K<k>/``,
    words read as text (``nan`` and ``null`` stay words, an empty field is
    the empty word)."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "assignments.csv")
          .option("header", "true").option("nullValue", "\u0000").option("nanValue", "\u0000")
          .schema("word string, cluster int").csv(root))
    path = F.col("_metadata.file_path")
    m = r"([^/]+)/([^/]+)/K([0-9]+)/assignments\.csv$"
    return df.select(F.regexp_extract(path, m, 1).alias("slug"), F.regexp_extract(path, m, 2).alias("method"),
                     F.regexp_extract(path, m, 3).cast("int").alias("k"),
                     F.coalesce(F.col("word"), F.lit("")).alias("word"), "cluster")


def read_written_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What ``sinks.write_run`` wrote: assignments and run rows of all runs."""
    root = root.rstrip("/")
    return (spark.read.parquet(f"{root}/assignments").select("slug", "method", "k", "word", "cluster"),
            spark.read.parquet(f"{root}/runs").drop("slug", "run_method", "run_k"))


def csv_rows(lines: DataFrame) -> DataFrame:
    """CSV tables that each have their own header, from ``file, line_no, line``:
    ``file, line_no, cells`` with a map from column name to text for every data
    row. The header is a file's first line; an empty field is the empty string.
    Cells are split at commas: these tables quote nothing."""
    head = lines.groupBy("file").agg(F.min_by("line", "line_no").alias("_head"),
                                     F.min("line_no").alias("_first"))
    names = F.transform(F.split("_head", ","), lambda x: F.trim(x))
    rows = lines.join(head, "file").filter((F.col("line_no") > F.col("_first")) & (F.trim("line") != ""))
    cells = F.slice(F.split("line", ",", -1), 1, F.size(names))
    return rows.select("file", "line_no", F.map_from_arrays(
        F.slice(names, 1, F.size(cells)), cells).alias("cells"))


def _pick(names: list[str]) -> F.Column:
    """The first of the spellings that a row's table has; names are compared
    without case, signs and white space."""
    plain = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(
        F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("key"), e["value"].alias("value"))))
    want = list(dict.fromkeys(re.sub("[^a-z0-9]", "", n.lower()) for n in names))
    return F.coalesce(*(F.try_element_at(plain, F.lit(n)) for n in want))


def _number(value: F.Column, kind: str) -> F.Column:
    return F.when(F.trim(value) == "", None).otherwise(value).try_cast(kind)


# Column spellings of the tables (fixed values).
STATS_COLUMNS = {
    "cid": (["cid", "cluster", "cluster_id", "c"], "int"), "size": (["size", "n_words"], "bigint"),
    **{f"suffix{n}": ([f"suffix{n}"], "string") for n in (2, 3, 4)},
    **{f"suffix{n}_purity": ([f"suffix{n}_purity"], "double") for n in (2, 3, 4)},
    "max_suffix_purity": (["max_suffix_purity", "suffix_purity", "suffix"], "double"),
    "top_pos": (["top_pos"], "string"), "pos_purity": (["pos_purity"], "double"),
    "pos_entropy": (["pos_entropy"], "double"), "pos_coverage": (["pos_coverage", "coverage"], "double"),
    "msi": (["msi", "msi_pos_minus_suffix", "msi_pos_suf"], "double"),
}
ALIGN_COLUMNS = {
    "cid_a": (["cid_a", "a"], "int"), "cid_b": (["cid_b", "b"], "int"),
    "centroid_cosine": (["centroid_cosine", "cosine", "sim"], "double"),
    "jaccard": (["jaccard"], "double"), "size_a": (["size_a"], "bigint"), "size_b": (["size_b"], "bigint"),
}


def _columns(spec: dict) -> list[F.Column]:
    return [(_pick(names) if kind == "string" else _number(_pick(names), kind)).alias(name)
            for name, (names, kind) in spec.items()]


def parse_stats_tables(lines: DataFrame, methods=("serial", "parallel", "sklearn")) -> DataFrame:
    """S6 over lines: tables named ``cluster_stats_<slug>_<method>_K<k>.csv``, each
    read by its own header whatever the order and spelling of its columns; other
    files are skipped. MSI is POS purity minus suffix purity where it is absent."""
    m = r"^cluster_stats_(.+)_(" + "|".join(methods) + r")_K([0-9]+)\.csv$"
    rows = csv_rows(lines.filter(F.col("file").rlike(m))).select(
        F.regexp_extract("file", m, 1).alias("slug"), F.regexp_extract("file", m, 2).alias("method"),
        F.regexp_extract("file", m, 3).cast("int").alias("k"), *_columns(STATS_COLUMNS))
    return rows.withColumn("msi", F.coalesce("msi", F.col("pos_purity") - F.col("max_suffix_purity")))


def parse_alignments(lines: DataFrame) -> DataFrame:
    """S7 over lines: alignment tables by their headers; ``k`` from ``_K<n>.csv``."""
    k = F.regexp_extract("file", r"_K([0-9]+)\.csv$", 1)
    return csv_rows(lines).select("file", F.when(k != "", k.cast("int")).alias("k"),
                                  *_columns(ALIGN_COLUMNS))


def render_csv(rows: DataFrame, file: F.Column, columns: list[str]) -> DataFrame:
    """Result rows as CSV lines with a header per file: ``file, line_no, line``;
    a null is the empty field. Lines follow the order of the columns' values."""
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    order = F.row_number().over(Window.partitionBy("file").orderBy(*columns))  # a small table a file
    body = rows.select(file.alias("file"), *columns).select(
        "file", order.cast("long").alias("line_no"), F.array_join(cells, ",").alias("line"))
    head = body.select("file").distinct().select(
        "file", F.lit(0).cast("long").alias("line_no"), F.lit(",".join(columns)).alias("line"))
    return head.unionByName(body)


def _table_lines(spark: SparkSession, pattern: str, what: str) -> DataFrame:
    return existing(lambda: spark.read.text(pattern), what).select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"))


def read_stats_tables(spark: SparkSession, folder: str, methods=("serial", "parallel", "sklearn")) -> DataFrame:
    """S6 from files; an ``InputError`` where there are none."""
    lines = _table_lines(spark, folder.rstrip("/") + "/cluster_stats_*_K*.csv", "cluster statistics")
    return parse_stats_tables(lines, methods)


def read_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """S7 from files; an ``InputError`` where there are none."""
    return parse_alignments(_table_lines(spark, folder.rstrip("/") + "/alignment_*_K*.csv", "alignments"))


def safe_slug(name: F.Column) -> F.Column:
    """a name safe for files: runs of other characters than letters,
    digits, dots, underscores and hyphens become one hyphen."""
    return F.regexp_replace(name, r"[^0-9A-Za-z._-]+", "-")


def run_slug(path: F.Column) -> F.Column:
    """P10: ``<parent>-<file name without .vec.gz/.vec/.bin>``."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))
    stem = F.replace(F.replace(F.replace(name, F.lit(".vec.gz"), F.lit("")), F.lit(".vec"), F.lit("")),
                     F.lit(".bin"), F.lit(""))
    return F.concat(parent, F.lit("-"), stem)


def run_family(slug: F.Column) -> F.Column:
    """Baseline / lemma / raw."""
    s = F.lower(slug)
    return (F.when(s.startswith("baseline-"), F.lit("baseline"))
            .when(s.contains("lemma"), F.lit("lemma")).otherwise(F.lit("raw")))


def drop_missing_secs(runs: DataFrame) -> DataFrame:
    """Runs whose time parsed."""
    return runs.filter(F.col("secs").isNotNull() & ~F.isnan("secs"))


def best_run(runs: DataFrame) -> DataFrame:
    """Per (vecslug, K, method) the fastest run, whole row (ties: log
    path). An aggregation (partial, then final), so a key holding most of
    the logs is never sorted in one task."""
    key = ["vecslug", "K", "method"]
    rest = [c for c in runs.columns if c not in key]
    best = (drop_missing_secs(runs).groupBy(*key)
            .agg(F.min_by(F.struct(*rest), F.struct("secs", "log_path")).alias("_b")))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*runs.columns)


def runtime_pivot(runs: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Per (vecslug, K) the minimum seconds of each method as columns."""
    if methods is None:
        methods = sorted(r["method"] for r in runs.select("method").distinct().collect())
    return runs.groupBy("vecslug", "K").pivot("method", methods).agg(F.min("secs"))


def speedup(pivot: DataFrame, numerator: str = SERIAL, denominator: str = PARALLEL) -> DataFrame:
    """``numerator / denominator`` seconds where both exist."""
    num, den = F.col(f"`{numerator}`"), F.col(f"`{denominator}`")
    return pivot.select("vecslug", "K", num.alias(numerator), den.alias(denominator),
                        F.when(num.isNotNull() & den.isNotNull() & (den != 0), num / den).alias("speedup"))


def msi_pivot(stats: DataFrame, digits: int = 3) -> DataFrame:
    """Rows K, one column per ``slug|method``, mean MSI rounded."""
    runs = stats.select(F.concat_ws("|", "slug", "method").alias("run"), "k", "msi")
    names = sorted(r["run"] for r in runs.select("run").distinct().collect())
    return (runs.groupBy(F.col("k").alias("K")).pivot("run", names)
            .agg(F.round(F.avg("msi"), digits)))


def metric_series(metrics: DataFrame, names=SERIES_METRICS) -> DataFrame:
    """The points of every (vecslug, method) line of each metric against
    K (lines without any value dropped), with the metric's padded range
    ``lo, hi`` (6 % of the span, at least 1e-6)."""
    df = metrics
    if "vecslug" not in df.columns:
        df = df.withColumn("vecslug", F.lit("unspecified"))
    if "method" not in df.columns:
        df = df.withColumn("method", F.lit(SERIAL))
    present = [m for m in names if m in df.columns]
    if not present:
        raise ValueError("no metric column")
    stack = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in present]))
    long = df.select("vecslug", "method", "K", stack.alias("p")).select(
        "vecslug", "method", "K", "p.metric", "p.value").filter(
        F.col("value").isNotNull() & ~F.isnan("value"))
    rng = long.groupBy("metric").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    pad = F.greatest(F.lit(PAD_MIN), (F.col("vmax") - F.col("vmin")) * PAD_FRACTION)
    rng = rng.select("metric", (F.col("vmin") - pad).alias("lo"), (F.col("vmax") + pad).alias("hi"))
    return long.join(F.broadcast(rng), "metric")


def legend_order(lines: DataFrame, methods=LEGEND_METHODS) -> DataFrame:
    """L4: the distinct (vecslug, method) lines of a figure with their ``family``
    (P11) and their 1-based ``place`` in its legend: families in order, in each its
    known methods in order, then by slug. Lines of a method that is not known come
    last, by slug and method."""
    known = {(f, m): n for n, (f, m) in enumerate(
        (f, m) for f in LEGEND_FAMILIES for m in methods)}
    place = F.lit(None).cast("int")
    for (family, method), n in known.items():
        place = F.when((F.col("family") == family) & (F.col("method") == method), n).otherwise(place)
    rows = lines.select("vecslug", "method").distinct().withColumn("family", run_family(F.col("vecslug")))
    rows = rows.withColumn("_group", F.coalesce(place, F.lit(len(known))))
    return global_rank(rows, ["_group", "vecslug", "method"], "place").drop("_group")


def table_order(table: DataFrame, order: list[str]) -> DataFrame:
    """L4: the rows of a result table with their 1-based ``place`` when sorted by
    ``order`` (columns that tell all rows apart), as ``write_metrics`` writes them."""
    return global_rank(table, order, "place")
