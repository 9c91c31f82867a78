"""Inputs the registered queries read, derived from the driver's tables.

The reference reads files (a line corpus, word vectors, a treebank, run logs).
Here each of them is derived by Spark from the test tables; the builders only
shape rows into the schema the operators expect and do none of their work.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.operators import embed
from lexiclust.operators import text as textops
from lexiclust.session import spread
from lexiclust.sources.tables import read_table
from lexiclust.sources.text import lines_from_table


def _kept(fn):
    """Derive once per ``Inputs`` and keep the result (memory, then disk)
    for the several jobs of one query."""
    @functools.wraps(fn)
    def wrapper(self):
        if fn.__name__ not in self._memo:
            self._memo[fn.__name__] = fn(self).persist()
        return self._memo[fn.__name__]
    return wrapper


# Latin letters and the Cyrillic ones that stand for them.
LATIN = "abdefgilmnoprstuvhcqwABDEFGILMNOPRSTUV"
CYRILLIC = "абдефгилмнопрстувњцќџАБДЕФГИЛМНОПРСТУВ"


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    _memo: dict = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- text -------------------------------------------------------------
    def raw_lines(self) -> DataFrame:
        """The corpus: ``documents.text`` split on newlines, in (doc_id, line) order."""
        return lines_from_table(spread(self.table("documents").select("doc_id", "text")))

    def cyrillic_lines(self) -> DataFrame:
        """The corpus in Cyrillic letters, with two that only NFKC makes plain:
        ``k`` is written as г and a combining accent, ``z`` full width."""
        lines = self.raw_lines()
        text = F.translate(F.translate("raw", "@", " "), LATIN, CYRILLIC)
        text = F.translate(F.regexp_replace(text, "k", "\u0433\u0301"), "z", "\uff5a")
        return lines.withColumn("raw", text)

    @_kept
    def clean(self) -> DataFrame:
        return textops.clean_lines(self.raw_lines())

    def tokens(self) -> DataFrame:
        """A row a token: many times the lines, which are what is kept."""
        return textops.tokenize(self.clean())

    def conversation_tokens(self) -> DataFrame:
        """Tokens of the cleaned ``conversations`` corpus (a second corpus)."""
        conv = self.table("conversations").select(
            (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"), "text")
        return textops.tokenize(textops.clean_lines(lines_from_table(spread(conv))))

    # -- vectors ----------------------------------------------------------
    def embedding_vectors(self) -> DataFrame:
        """``embeddings`` as a vector set: rank = vec_id, word = its text."""
        return self.table("embeddings").select(
            F.lit("embeddings").alias("slug"), F.col("vec_id").cast("long").alias("rank"),
            F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))

    def vocab(self) -> DataFrame:
        """The whole vocabulary, ranked."""
        return textops.top_vocab(self.tokens())

    @_kept
    def context_vectors(self) -> DataFrame:
        """Word vectors of the document vocabulary (M7 stand-in for training)."""
        toks = self.tokens()
        return embed.context_vectors(toks, self.vocab(), dims=16, slug="documents-context")

    # -- runs and labels --------------------------------------------------
    def treebank(self) -> DataFrame:
        """Treebank rows from the cleaned corpus: form = token, lemma = token
        without its last two letters when longer than five, upos = the
        document's language in upper case; ``ord`` = corpus order."""
        from lexiclust.session import bounded_broadcast
        langs = bounded_broadcast(self.table("documents").select("doc_id", F.upper("lang").alias("upos")))
        toks = textops.tokenize(self.clean().join(langs, "doc_id"), keep=("upos",))
        lemma = F.when(F.length("token") > 5, F.expr("substring(token, 1, length(token) - 2)")
                       ).otherwise(F.col("token"))
        return toks.select(
            F.col("token").alias("form"), lemma.alias("lemma"), "upos",
            F.struct("doc_id", "line_pos", "tok_pos").alias("ord"))

    def treebank_lines(self) -> DataFrame:
        """The treebank as CoNLL-U lines ``doc_id, line_pos, raw``: each line of the
        cleaned corpus is a sentence of a comment, its token rows with a multiword
        node after the first, and a blank line."""
        from lexiclust.session import bounded_broadcast
        langs = bounded_broadcast(self.table("documents").select("doc_id", F.upper("lang").alias("upos")))

        def row(token, n):
            lemma = F.when(F.length(token) > 5, F.substring(token, F.lit(1), F.length(token) - 2)).otherwise(token)
            return F.concat_ws("\t", (n + 1).cast("string"), token, lemma, F.col("upos"), F.lit("_"))
        rows = F.transform(F.split("text", " "), row)
        lines = F.concat(F.array(F.concat(F.lit("# text = "), F.col("text"))), F.slice(rows, 1, 1),
                         F.array(F.lit("1-2\t_\t_\t_\t_")), F.slice(rows, F.lit(2), F.size(rows)),
                         F.array(F.lit("")))
        found = self.clean().join(langs, "doc_id").select("doc_id", "line_pos", F.posexplode(lines).alias("n", "raw"))
        return found.select("doc_id", (F.col("line_pos") * 1_000_000 + F.col("n")).alias("line_pos"), "raw")

    def runs_over(self, vectors: DataFrame, ks, rounds: int, seed: int = 42) -> DataFrame:
        """Assignments ``slug, method, k, word, cluster`` of spherical k-means
        after ``rounds`` rounds for every K (one shared pass per round)."""
        from lexiclust.operators import kmeans as km
        fit = km.spherical_kmeans(vectors, ks, seed=seed, max_iter=rounds, stop_early=False)
        return km.predict(vectors, fit.centroids).select(
            "slug", F.lit("parallel").alias("method"), "k", "word", "cluster")

    def unit_embeddings(self) -> DataFrame:
        from lexiclust.operators.vectors import l2_normalize
        return l2_normalize(self.embedding_vectors())

    @_kept
    def embedding_runs(self) -> DataFrame:
        return self.runs_over(self.unit_embeddings(), (5, 10, 20), rounds=3)

    def embedding_truth(self) -> DataFrame:
        """Embedding runs with the ``label`` column as truth."""
        lab = self.table("embeddings").select(F.col("vec_id").cast("string").alias("word"),
                                              F.col("label").alias("truth"))
        return self.embedding_runs().join(lab, "word")

    @_kept
    def context_runs(self) -> DataFrame:
        return self.runs_over(self.context_vectors(), (10,), rounds=1)

    def run_logs(self) -> DataFrame:
        """Run-log text (``key=value`` lines) built from ``events``: vector
        set ``u<user_id div 10>``, method = event type, K from the ``k`` of
        ``props`` in five steps of 100, seconds = value. One log per event."""
        ev = spread(self.table("events"))
        k = (F.floor(F.get_json_object("props", "$.k").cast("int") / 20) + 1) * 100
        slug = F.concat(F.lit("u"), F.floor(F.col("user_id") / 10).cast("string"))
        text = F.concat_ws(
            "\n",
            F.concat(F.lit("vec=embeddings/vectors/"), slug, F.lit(".vec")),
            F.concat(F.lit("vecslug="), slug),
            F.concat(F.lit("K="), k.cast("string")),
            F.concat(F.lit("method="), F.col("event_type")),
            F.concat(F.lit("N="), F.col("event_id").cast("string")),
            F.lit("D=64"),
            F.lit("normed=1"),
            F.concat(F.lit("iterations="), F.get_json_object("props", "$.k")),
            F.lit("num_cores="),
            F.lit("max_iter=100"),
            F.concat(F.lit("secs="), F.coalesce(F.col("value").cast("string"), F.lit(""))),
            F.lit("max_words=all"))
        path = F.concat(F.lit("clusters/"), slug, F.lit("/"), F.col("event_type"), F.lit("/K"),
                        k.cast("string"), F.lit("/run.log#"), F.col("event_id").cast("string"))
        return ev.select(path.alias("log_path"), text.alias("text"))

    @_kept
    def parsed_runs(self) -> DataFrame:
        from lexiclust.operators.runs import parse_run_logs
        return parse_run_logs(self.run_logs())
