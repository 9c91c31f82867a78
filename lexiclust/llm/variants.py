"""Groups of spelling variants by reduced-alphabet generation.

Words are counted over whole texts. A word's letters are hashed to a few symbols;
the word so reduced is spelt in an alphabet small enough to write out its full
one-edit neighbourhood (every deletion, replacement and insertion, and the reduced
word itself, as letters of one symbol replace each other unseen). If two words are
one edit apart, so are their reduced forms, or they are equal: each neighbourhood is
joined with the reduced vocabulary, and what meets there is verified on the original
spellings.

A reduced word travels as a 64-bit polynomial hash, from which those of all
neighbours follow by arithmetic on prefix and suffix sums; a collision of hashes is
one more candidate that the verification rejects. A bitmap of fixed size over the
reduced vocabulary keeps neighbours that no word has from being shuffled; it answers
"absent" only when that is so, and a vocabulary that fills it costs time, not pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, stored
from lexiclust.llm.wordhash import mix

MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
SYMBOLS = 8
BITMAP_BITS = 26  # 8 MB, whatever the vocabulary
HELD_WORDS = 300_000  # distinct words a task holds before it passes their counts on
CHUNK_LETTERS = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_BASE = np.uint64(_BASE)


def _run_letters() -> bytes:
    """Latin-1 bytes of runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, all else a space."""
    return bytes(i if 0x61 <= i <= 0x7A or i >= 0xC0 else i + 0x20 if 0x41 <= i <= 0x5A else 0x20
                 for i in range(256))


_RUN_LETTERS = _run_letters()


def _runs(text: str, min_length: int) -> list[bytes]:
    """The text's runs of letters, lower-cased, in Latin-1 (one byte a code point)."""
    return [w for w in text.encode("latin-1", "replace").translate(_RUN_LETTERS).split(b" ")
            if len(w) >= min_length]


def _damaged(counts: Counter, runs: list[bytes], doc_id, every: int) -> None:
    """Move the counts of the document's runs that lose a code point."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w in set(runs):
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % every == 0:
            n, at = runs.count(w), h % len(w)
            counts[w] -= n
            counts[w[:at] + w[at + 1:]] += n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                damage_every: int | None = None) -> DataFrame:
    """``word, n``: runs ``[A-Za-z\\u00C0-\\u00FF]+`` of all texts with A-Z lower-cased, of at
    least ``min_length`` code points and ``min_count`` occurrences. Null and empty texts
    have none. ``damage_every`` plants typing errors: a run for which it divides the crc32
    ``h`` of ``<key>:<run>`` loses its code point ``h % length`` wherever it stands in that
    row's text (a null key is written as nothing)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            kept = {w.decode("latin-1"): n for w, n in counts.items() if n and len(w) >= min_length}
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = _runs(t.as_py() or "", min_length)
                counts.update(runs)
                if damage_every:
                    _damaged(counts, runs, doc_id, damage_every)
                if len(counts) > HELD_WORDS:
                    yield out()
        yield out()

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _reduced(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (from 1) of all words' code points, each one's place in its word, sizes."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (mix(points.astype(np.uint64)) % np.uint64(symbols)).astype(np.int64) + 1, place, sizes


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def reduced_keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The hash of each reduced word (no word may be empty)."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    sym, place, sizes = _reduced(words, symbols)
    begin = np.cumsum(sizes) - sizes
    return np.add.reduceat(sym.astype(np.uint64) * _powers(int(sizes.max()))[place], begin)


def neighbourhood(words: list[str], symbols: int = SYMBOLS,
                  present=None) -> tuple[np.ndarray, np.ndarray]:
    """``(index of the word, key)`` of every distinct word within one edit of each reduced
    word, itself included; ``present`` tells which keys of an array to keep."""
    none = np.empty(0, dtype=np.int64)
    if not words:
        return none, none.astype(np.uint64)
    sym, place, sizes = _reduced(words, symbols)
    owner = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    weight = _powers(int(sizes.max()) + 1)
    value = sym.astype(np.uint64) * weight[place]
    run = np.cumsum(value, dtype=np.uint64)
    whole = np.add.reduceat(value, begin)
    before = run - value - np.repeat(run[begin] - value[begin], sizes)  # of the letters before
    after = whole[owner] - before - value  # of those behind, in their places
    previous = np.where(place > 0, np.roll(sym, 1), 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(ix: np.ndarray, keys: np.ndarray) -> None:
        if present is not None:
            there = present(keys)
            ix, keys = ix[there], keys[there]
        found.append((ix, keys))

    every = np.arange(len(words))
    add(every, whole)
    first = sym != previous  # deleting any of a run of one symbol gives the same word
    add(owner[first], before[first] + after[first] * _INVERSE)
    for c in range(1, symbols + 1):
        s = np.uint64(c)
        other = sym != c
        add(owner[other], (before + s * weight[place] + after)[other])
        gap = previous != c  # behind a symbol of its kind, it was inserted before it
        add(owner[gap], (before + s * weight[place] + (value + after) * _BASE)[gap])
        last = sym[begin + sizes - 1] != c
        add(every[last], (whole + s * weight[sizes])[last])
    ix = np.concatenate([f[0] for f in found])
    keys = np.concatenate([f[1] for f in found])
    order = np.lexsort((keys, ix))
    ix, keys = ix[order], keys[order]
    fresh = np.ones(len(ix), dtype=bool)
    fresh[1:] = (ix[1:] != ix[:-1]) | (keys[1:] != keys[:-1])
    return ix[fresh], keys[fresh]


def _word_chunks(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The words in order, with where they begin, at most ``CHUNK_LETTERS`` letters each
    time (a longer word stands alone)."""
    at = 0
    while at < len(words):
        end, letters = at, 0
        while end < len(words) and (end == at or letters + len(words[end]) <= CHUNK_LETTERS):
            letters += len(words[end])
            end += 1
        yield at, words[at:end]
        at = end


def _keyer(symbols: int):
    @F.arrow_udf("bigint")
    def key(words: pa.Array) -> pa.Array:
        found = [reduced_keys(part, symbols) for _, part in _word_chunks(words.to_pylist())]
        return pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))
    return key


def _bit(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    place = mix(keys) >> np.uint64(64 - bits)
    return (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)


def _bitmap(vocab: DataFrame, bits: int) -> np.ndarray:
    """The bits of all keys: one row for each 64 of them reaches the driver, at most
    ``2 ** bits / 64`` whatever the vocabulary."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bit = _bit(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], names=["w", "b"])

    rows = (vocab.select("key").mapInArrow(place, "w bigint, b bigint")
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(max(1, (1 << bits) // 64), dtype=np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def near_words(vocab: DataFrame, symbols: int = SYMBOLS, bits: int = BITMAP_BITS) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of distinct words of ``vocab`` (``word``,
    ``n``; no word twice, null or empty) that differ by exactly one code point inserted,
    deleted or replaced."""
    spark = vocab.sparkSession
    keyed = stored(vocab.select("word", "n", _keyer(symbols)("word").alias("key")), "reduced")
    sent = Shared(spark, _bitmap(keyed, bits))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.build(lambda value: value)

        def present(keys: np.ndarray) -> np.ndarray:
            word, bit = _bit(keys, bits)
            return (bitmap[word] >> bit) & np.uint64(1) == 1

        for batch in batches:
            for at, part in _word_chunks(batch.column(0).to_pylist()):
                ix, keys = neighbourhood(part, symbols, present)
                rows = batch.take(pa.array(ix + at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys.view(np.int64))],
                                                 names=["word", "n", "key"])

    around = keyed.select("word", "n").mapInArrow(generate, "word string, n bigint, key bigint")
    other = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # the planner takes what is generated to be as small as the words it comes from, and the
    # words for the size of their files: neither side is to go through the driver by that
    return around.join(other.hint("merge"), "key").where(
        (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    ).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the rows ``word, form`` (one a word, without cycles): the end of
    each chain. Every round doubles the steps taken."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = stored(found.join(onward.hint("merge"), "root", "left").select("word", "root", "_next"), "roots")
        if step.where(F.col("_next").isNotNull()).isEmpty():
            return found
        found = step.select("word", F.coalesce("_next", "root").alias("root"))


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                   ratio: int = FORM_RATIO, symbols: int = SYMBOLS, bits: int = BITMAP_BITS,
                   damage_every: int | None = None) -> DataFrame:
    """One row per word of ``docs`` (see ``word_counts``): ``word``, ``n``, ``n_near`` (words
    one edit away), ``form`` (the near word of largest ``n``, ties to the smallest in
    code-point order, if that is at least ``ratio`` times the word's; else null), ``form_n``
    and ``root`` (where the chain of forms ends; the word itself without one).

    Only ``key`` and ``text`` are read, so other columns may have any name; repeated rows
    count again; an empty table gives no rows. ``ratio`` must be above 1: counts rise along
    a chain, so it ends."""
    if ratio <= 1:
        raise ValueError("the ratio must be above 1")
    vocab = stored(word_counts(docs, key, text, min_length, min_count, damage_every), "vocabulary")
    best = near_words(vocab, symbols, bits).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    rows = vocab.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("_best.less") >= F.col("n") * ratio, F.col("_best")).alias("_best"))
    rows = stored(rows.select("word", "n", "n_near", F.col("_best.near").alias("form"),
                              (-F.col("_best.less")).alias("form_n")), "variants")
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
