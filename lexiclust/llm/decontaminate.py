"""Benchmark decontamination: one Aho-Corasick automaton over the word windows
of the test items, scanned once over every document.

The automaton's alphabet is the items' word ids (every other word is 0), so a
match position is a word position; words map back to offsets in the original
text. Its size is bounded by the normalised bytes of the items: beyond
``SHARD_BYTES`` the items are dealt by hash to several automata, one of which
is on the driver and in a worker at a time. The texts are then stored once
under a row number; each automaton leaves only the row numbers, runs and items
of the rows it hits, and these are merged by a join. No item is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, chunks, stored

WINDOW_WORDS = 10
SHARD_BYTES = 4 << 20  # normalised item bytes under one automaton

# A-Z lower-cased; every ASCII byte outside 0-9 and a-z separates words.
_FOLD = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A
                                             or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20
    for b in range(256))

HITS = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
HITS_DDL = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
            "spans:array<struct<start:bigint,end:bigint>>>")


def words(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


class WindowAutomaton:
    """Windows of ``window`` consecutive item words; an item of fewer words,
    but not none, is one window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text))
            if not ids:
                continue
            for i in range(max(1, len(ids) - window + 1)):
                got = owners.setdefault(ids[i:i + window], set())
                if item_id is not None:
                    got.add(item_id)
        self.owners = list(owners.values())
        self.lengths = [len(k) for k in owners]
        self.shortest = min(self.lengths, default=1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, key in enumerate(owners):
            self.automaton.add_word(key, n)
        if owners:
            self.automaton.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs ``[first, end)`` of hit words, and the items that occur."""
        if not self.owners or not found:
            return [], set()
        known = self.vocab
        ids = [known.get(w, 0) for w in found]
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        # A word outside the alphabet puts the automaton back at its root, so
        # it walks the stretches between such words that can hold a window.
        foreign = np.flatnonzero(np.array([0, *ids, 0]) == 0) - 1
        for n in np.flatnonzero(np.diff(foreign) > self.shortest):
            begin = int(foreign[n]) + 1
            for last, n_key in self.automaton.iter(tuple(ids[begin:int(foreign[n + 1])])):
                end = begin + last + 1
                runs.append((end - self.lengths[n_key], end))
                items |= self.owners[n_key]
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def code_points(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs as code point offsets into the original text."""
    raw = np.frombuffer(text.encode().translate(_FOLD), dtype=np.uint8)
    inside = np.concatenate([[False], raw != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edge[0::2], edge[1::2]
    original = np.frombuffer(text.encode(), dtype=np.uint8)
    before = np.concatenate([[0], np.cumsum((original & 0xC0) != 0x80)])
    return [{"start": int(before[begins[a]]), "end": int(before[ends[b - 1]])} for a, b in runs]


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW_WORDS, out: str = "leaks",
               shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with a column ``out``: a struct of ``n_words``, ``n_hit`` (words
    inside any occurrence of a window), ``items`` (their ids as sorted strings)
    and ``spans`` (code point ranges of the hit runs in the original text).

    A null or empty text has no words and no hits. An item without words is no
    window; an item with a null id still marks words but names no item;
    repeated items count once. All other columns stay; a column already named
    ``out`` is replaced. Without items nothing is hit.
    """
    rows, n_shards = _dealt(items, item_id, item_text, shard_bytes)
    if n_shards == 1:
        return _scan(docs, Shared(docs.sparkSession, _shard(rows, 0)), text, window, out)
    row = _free(docs, "leak_row")
    # the numbers hold once the rows are written
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "leaks")
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    found = None
    for n in range(n_shards):
        shared = Shared(docs.sparkSession, _shard(rows, n))
        hits = _scan(texts, shared, "text", window, "hit").select("row", "hit.*")
        hits = stored(hits.where("n_hit > 0").select("row", "items", "runs"), "hits")
        shared.sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    # a row meets at most one entry a shard
    found = found.groupBy(F.col("row").alias(row)).agg(F.struct(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("runs")).alias("runs")).alias(f"{row}_hits"))
    kept = [c for c in docs.columns if c not in (row, out)]
    joined = docs.join(found, row, "left")
    return joined.select(*(F.col(f"`{c}`") for c in kept), _settled(
        F.col(f"`{text}`"), F.col(f"{row}_hits.items"), F.col(f"{row}_hits.runs")).alias(out))


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` starts so."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def _dealt(items: DataFrame, item_id: str, item_text: str,
           shard_bytes: int) -> tuple[DataFrame, int]:
    """The distinct items, dealt by hash into ``shard`` numbers of about
    ``shard_bytes`` each (a longer item stays whole); the number of shards."""
    rows = items.select(F.col(item_id).cast("string").alias("id"),
                        F.col(item_text).alias("text")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // shard_bytes))
    if n > 1:
        rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n))), "items")
    return rows, n


def _shard(rows: DataFrame, n: int) -> list[tuple[str | None, str | None]]:
    mine = rows.where(F.col("shard") == n) if "shard" in rows.columns else rows
    return sorted(((r.id, r.text) for r in mine.select("id", "text").collect()), key=str)


def _scan(docs: DataFrame, shared: Shared, text: str, window: int, out: str) -> DataFrame:
    @F.arrow_udf(_WITH_RUNS_DDL)
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.build(lambda rows: WindowAutomaton(rows, window))
        for texts in batches:
            values = []
            for part in chunks(texts):
                for t in part:
                    found = words(t)
                    runs, names = automaton.scan(found)
                    values.append(_value(t, len(found), runs, sorted(names)))
            yield pa.array(values, type=_WITH_RUNS)
    return docs.withColumn(out, leaks(F.col(f"`{text}`")))


def _settled(text: Column, items: Column, runs: Column) -> Column:
    """The struct of a row from what all shards found of it."""

    @F.arrow_udf(_WITH_RUNS_DDL)
    def settle(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names, found in batches:
            values = []
            at = 0
            for part in chunks(texts):
                rest = zip(names.slice(at, len(part)).to_pylist(),
                           found.slice(at, len(part)).to_pylist(), strict=True)
                for t, (some, runs) in zip(part, rest, strict=True):
                    runs = merged([(x["start"], x["end"]) for x in runs or []])
                    values.append(_value(t, len(words(t)), runs, some or []))
                at += len(part)
            yield pa.array(values, type=_WITH_RUNS)
    return settle(text, items, runs)


def _value(text: str | None, n_words: int, runs: list[tuple[int, int]], items: list[str]) -> dict:
    return {"n_words": n_words, "n_hit": sum(b - a for a, b in runs), "items": items,
            "spans": code_points(text, runs) if runs else [],
            "runs": [{"start": a, "end": b} for a, b in runs]}


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WITH_RUNS = pa.struct([*HITS, ("runs", _RUNS)])
_WITH_RUNS_DDL = HITS_DDL[:-1] + ",runs:array<struct<start:bigint,end:bigint>>>"
