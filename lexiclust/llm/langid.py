"""Language identification with word-first backoff.

A word met in training scores by its log frequency in each language. A word
never met falls back to the longest of its character n-grams that were met:
first those of ``MAX_GRAM`` characters, then shorter ones, down to one. A text
scores by the sum over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, chunks, give_back, held_out

TRAIN_ROWS = 10_000  # texts learnt from, at most about this many, shared by the languages
MAX_WORDS = 100_000  # words the model knows; the n-grams stand for the rest
MAX_GRAMS = 100_000
MIN_COUNT = 2  # a word met once says little; its n-grams do
MAX_GRAM = 4
SMOOTHING = 0.5
CACHE_WORDS = 100_000  # unseen words whose scores a worker remembers
UNKNOWN = "und"

WORD = r"\p{L}[\p{L}\p{M}]*"  # a letter and the letters and marks after it


class BackoffModel:
    """``words`` and ``grams``: keys with a count for each of ``langs``."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray],
                 grams: dict[str, np.ndarray], prior: np.ndarray, max_gram: int = MAX_GRAM):
        self.langs, self.max_gram = langs, max_gram
        self.prior = np.log(prior / prior.sum()) if len(langs) else np.zeros(0)
        self.words = {w: n for n, w in enumerate(words)}
        self.word_rows = _log_frequencies(list(words.values()), len(langs))
        # each length of n-gram is its own distribution
        by_size: dict[int, list[str]] = {}
        for g in grams:
            by_size.setdefault(len(g), []).append(g)
        ordered = [g for size in sorted(by_size) for g in by_size[size]]
        self.grams = {g: n for n, g in enumerate(ordered)}
        self.gram_rows = np.concatenate(
            [np.zeros((0, len(langs)))]
            + [_log_frequencies([grams[g] for g in by_size[size]], len(langs))
               for size in sorted(by_size)])

    def backoff(self, unseen: list[str]) -> np.ndarray:
        """Log scores of words without a frequency: the mean over the longest
        n-grams known, or 0 for all languages if not even a letter is."""
        picked: list[int] = []
        counts = np.zeros(len(unseen), dtype=np.int64)
        get = self.grams.get
        for n, word in enumerate(unseen):
            edged = f"_{word}_"
            for size in range(min(self.max_gram, len(edged)), 0, -1):
                found = [g for i in range(len(edged) - size + 1)
                         if (g := get(edged[i:i + size])) is not None]
                if found:
                    picked += found
                    counts[n] = len(found)
                    break
        out = np.zeros((len(unseen), len(self.langs)))
        some = np.flatnonzero(counts)
        if len(some):
            begins = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(self.gram_rows[picked], begins) / counts[some, None]
        return out


def _log_frequencies(counts: list[np.ndarray], n_langs: int) -> np.ndarray:
    if not counts:
        return np.zeros((0, n_langs))
    table = np.array(counts, dtype=np.float64) + SMOOTHING
    return np.log(table / table.sum(axis=0))


class Scorer:
    """Scores texts with a model, remembering unseen words."""

    def __init__(self, model: BackoffModel):
        import regex

        self.model = model
        self.find = regex.compile(WORD).findall
        self._forget()

    def _forget(self) -> None:
        self.row_of = dict(self.model.words)
        self.rows = np.concatenate([self.model.word_rows, np.zeros((1024, len(self.model.langs)))])
        self.used = len(self.model.words)

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.row_of))
        if self.used + len(new) > len(self.model.words) + CACHE_WORDS:
            self._forget()
            new = list(words.difference(self.row_of))
        if self.used + len(new) > len(self.rows):
            more = np.zeros((self.used + 2 * len(new) - len(self.rows), len(self.model.langs)))
            self.rows = np.concatenate([self.rows, more])
        if new:
            self.rows[self.used:self.used + len(new)] = self.model.backoff(new)
            self.row_of.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its share of the
        likelihood; ``und`` and 0 without a letter or without a model."""
        langs = self.model.langs
        words = [self.find(t.lower()) if t else [] for t in texts]
        if not langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        self._learn(set().union(*words))
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        some = np.flatnonzero(sizes)
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not len(some):
            return out
        get = self.row_of.__getitem__
        rows = np.fromiter((r for w in words for r in map(get, w)), dtype=np.int64,
                           count=int(sizes.sum()))
        begins = (np.cumsum(sizes) - sizes)[some]
        total = np.add.reduceat(self.rows[rows], begins) + self.model.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for d, b, s in zip(some.tolist(), best.tolist(), share.tolist(), strict=True):
            out[d] = langs[b], s
        return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        train_rows: int = TRAIN_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
        max_gram: int = MAX_GRAM) -> BackoffModel:
    """Word and n-gram frequencies per language, counted by Spark over a sample
    of the rows that are not held out and have a language and a text.

    The sample is bounded by ``train_rows`` (by hash of the key, the same for
    any partitioning), which the languages share evenly: one with fewer rows
    than its part gives all of them and leaves the rest to the others, so a rare
    language is learnt alike from a small and a large table. The model is bounded
    by ``max_words`` words and ``max_grams`` n-grams, those of the highest
    relative frequency in any language. Repeated rows count each time. Without
    rows the model knows no language and every text is ``und``.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    rows = _sample(rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"),
                               F.col(lang).alias("_lang")), train_rows)
    words = (rows.select("_lang", F.explode(F.expr(
        rf"regexp_extract_all(lower(_text), '({WORD})', 1)".replace("\\", "\\\\"))).alias("_k"))
        .groupBy("_lang", "_k").agg(F.count(F.lit(1)).alias("_n")).persist())
    edged = F.concat(F.lit("_"), F.col("_k"), F.lit("_"))
    grams = words.select("_lang", "_n", edged.alias("_e"),
                         F.explode(F.sequence(F.lit(1), F.lit(max_gram))).alias("_s"))
    grams = grams.where(F.length("_e") >= F.col("_s")).select("_lang", "_n", F.explode(F.expr(
        "transform(sequence(1, length(_e) - _s + 1), i -> substring(_e, i, _s))")).alias("_k"))
    grams = grams.groupBy("_lang", "_k").agg(F.sum("_n").alias("_n"))
    shares = {r[0]: r[1] for r in words.groupBy("_lang").agg(F.sum("_n")).collect()}
    langs = sorted(shares)
    model = BackoffModel(langs, _table(words, shares, max_words),
                         _table(grams, shares, max_grams), np.ones(len(langs)), max_gram)
    words.unpersist()
    return model


def even_shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows such that at most ``most`` are taken in
    all: as evenly as the sizes allow, whole languages first."""
    out: dict[str, float] = {}
    for n, (name, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        part = most / (len(sizes) - n)
        out[name] = min(1.0, part / size)
        most -= out[name] * size
    return out


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows by hash order of ``_key``, shared evenly by ``_lang``;
    rows of a null key are left out."""
    rows = rows.where(F.col("_key").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    shares = rows.sparkSession.createDataFrame(
        [(name, int(share * (1 << 31))) for name, share in even_shares(sizes, most).items()],
        "_lang string, _below long")
    return (rows.join(F.broadcast(shares), "_lang")  # one row a language
            .where(F.pmod(F.xxhash64("_key"), F.lit(1 << 31)) < F.col("_below")).drop("_below"))


def _table(counts: DataFrame, totals: dict[str, int], most: int) -> dict[str, np.ndarray]:
    """The keys of the highest relative frequency in any language, with their
    counts in each; ``totals`` are the words of each language."""
    langs = sorted(totals)
    if not langs:
        return {}
    wide = counts.groupBy("_k").agg(F.sum("_n").alias("_all"), *(
        F.sum(F.when(F.col("_lang") == x, F.col("_n")).otherwise(0)).alias(f"_{n}")
        for n, x in enumerate(langs)))
    share = [F.col(f"_{n}") / float(totals[x]) for n, x in enumerate(langs)]
    top = F.greatest(*share) if len(share) > 1 else share[0]
    got = (wide.where(F.col("_all") >= MIN_COUNT).orderBy(F.desc(top), "_k").limit(most)
           .drop("_all").toArrow())
    table = np.stack([got.column(f"_{n}").to_numpy() for n in range(len(langs))], axis=1)
    return dict(zip(got.column("_k").to_pylist(), table, strict=True))


def predict(docs: DataFrame, model: BackoffModel, text: str = "text",
            out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang_pred`` and ``score``: the
    likeliest language and its share of the likelihood. Only the text is read;
    null texts and texts without a letter are ``und`` with score 0; ties go to
    the language first in order. All other columns stay; a column already named
    ``out`` is replaced. The model is bounded by ``fit`` and broadcast."""
    shared = Shared(docs.sparkSession, model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.build(Scorer)
        for texts in batches:
            rows = [x for part in chunks(texts) for x in scorer.predict(part)]
            yield pa.StructArray.from_arrays(
                [pa.array([x[0] for x in rows], pa.string()),
                 pa.array([x[1] for x in rows], pa.float64())], names=["lang_pred", "score"])
        give_back()
    return docs.withColumn(out, identify(F.col(text)))
