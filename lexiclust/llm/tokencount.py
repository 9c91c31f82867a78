"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged array of symbol ids. In each
round every sequence finds its lowest-rank adjacent pair and merges all of its
occurrences, for all sequences at once; a sequence without a mergeable pair is
done, and its surviving symbols are its token count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, chunks

# The pre-token pattern that byte-level BPE files with use_regex stand for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_TOKENS = 300_000  # pre-tokens whose counts a worker remembers

COUNTS = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
COUNTS_DDL = "struct<n_bytes:bigint,n_tokens:bigint>"
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next one from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class MergeTable:
    """Vocabulary and merge ranks of a byte-level BPE file as sorted arrays."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        vocab = model["vocab"]
        self.width = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.pattern = regex.compile(PATTERN)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in
                                              sorted(added, key=len, reverse=True))) if added else None

    def count(self, tokens: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token after all merges."""
        raw = [t.encode() for t in tokens]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        result = sizes.copy()
        ids = np.flatnonzero(sizes > 1)  # sequences still merging
        symbols = symbols[np.repeat(sizes > 1, sizes)]
        sizes = sizes[ids]
        while len(ids):
            begins = np.cumsum(sizes) - sizes
            pairs = np.full(len(symbols), -1, dtype=np.int64)
            pairs[:-1] = symbols[:-1] * self.width + symbols[1:]
            pairs[begins + sizes - 1] = -1  # no pair across sequences
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            hit = self.keys[at] == pairs
            rank = np.where(hit, self.ranks[at], _NONE)
            lowest = np.minimum.reduceat(rank, begins)
            live = lowest != _NONE
            take = (rank == np.repeat(lowest, sizes)) & hit
            take = _alternate(take)
            symbols = np.where(take, self.made[at], symbols)
            keep = np.ones(len(symbols), dtype=bool)
            keep[1:] = ~take[:-1]  # the right half of each merged pair goes
            left = np.add.reduceat(keep.astype(np.int64), begins)
            result[ids] = left
            live &= left > 1
            symbols = symbols[keep & np.repeat(live, sizes)]
            ids, sizes = ids[live], left[live]
        return result


def _alternate(take: np.ndarray) -> np.ndarray:
    """Of each run of adjacent marked pairs (as in ``aaa``) every other one,
    from the left: merges must not overlap."""
    at = np.flatnonzero(take)
    if len(at) < 2 or not (np.diff(at) == 1).any():
        return take
    begin = np.concatenate([[True], np.diff(at) != 1])
    first = at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
    out = np.zeros_like(take)
    out[at[(at - first) % 2 == 0]] = True
    return out


class Counter:
    """Counts of whole texts, remembering the counts of frequent pre-tokens."""

    def __init__(self, merges: MergeTable, cache_tokens: int = CACHE_TOKENS):
        self.merges, self.cache, self.limit = merges, {}, cache_tokens

    def split(self, text: str | None) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        if not text:
            return [], 0
        find, special = self.merges.pattern.findall, self.merges.special
        if special is None or not special.search(text):
            return find(text), 0
        parts = special.split(text)
        return [t for p in parts for t in find(p)], len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.split(t) for t in texts]
        new = list(set().union(*(t for t, _ in split)).difference(self.cache))
        if len(self.cache) + len(new) > self.limit:
            self.cache.clear()
            new = list(set().union(*(t for t, _ in split)))
        if new:
            self.cache.update(zip(new, self.merges.count(new).tolist(), strict=True))
        get = self.cache.__getitem__
        return [sum(map(get, tokens)) + extra for tokens, extra in split]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text",
                 out: str = "tokens") -> DataFrame:
    """``docs`` with a column ``out``: a struct of ``n_bytes`` (UTF-8) and
    ``n_tokens`` of the whole text under the byte-level BPE file at
    ``tokenizer_path`` (read by the driver, a few MB, and broadcast).

    Added tokens of the file count one each where they occur; a null or empty
    text counts 0 and 0. All other columns stay; a column already named ``out``
    is replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = Shared(docs.sparkSession, f.read())

    @F.arrow_udf(COUNTS_DDL)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = spec.build(lambda text: Counter(MergeTable(json.loads(text))))
        for texts in batches:
            n = []
            for part in chunks(texts):
                n += counter.counts(part)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.StructArray.from_arrays([size, pa.array(n, pa.int64())],
                                             fields=list(COUNTS))
    return docs.withColumn(out, tokens(F.col(text)))
