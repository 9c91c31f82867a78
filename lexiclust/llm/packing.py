"""Packing of documents into fixed-length training sequences by
shortest-pack-first over the length histogram.

Documents become token pieces of at most one sequence. Only the histogram of
piece lengths (at most ``max_tokens`` bins) reaches the driver; it is packed
there into patterns with counts, longest lengths first, each into the packs
with the most room. Pieces find their place again by their rank among the
pieces of their length.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiclust.llm.common import Shared, chunks, give_back, stored

MAX_TOKENS = 2048
END_ID = 1  # closes every document
CACHE_WORDS = 120_000  # words whose ids a worker remembers, some 0.3 KB each
_WORD_END = "</w>"  # closes every pre-token's last symbol (fixed value of the file format)
_JOINED = 2000  # words in one call of the tokenizer
# Signs before a space or the end, after a letter or digit.
_ODD = "<|", "\u03a3", "\u0130"
_WORD_THEN_SIGNS = re.compile(r"[,.!*&$%#|](?<=[^\W_].)[,.!*&$%#|]*(?=[ \n]|\Z)")
_SIGNS = ".,;:!?*&$%#|\"()-"  # ASCII signs that may end a word

_PIECE_FIELDS = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                 T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())]


class WordIds(dict):
    """Word -> its ids as little-endian uint32 bytes, filled by the tokenizer.

    Bounded: once ``limit`` words are held, the half not met for longest is forgotten.
    """

    def __init__(self, tokenizer_json: str, limit: int = CACHE_WORDS):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = json.loads(tokenizer_json)["model"]["vocab"]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(_WORD_END)]] = True
        self.limit = limit
        # Letters that the tokenizer keeps as they are, and their bytes as its model has them.
        letters = [c for c in map(chr, range(256)) if c.isalpha()
                   and self.tokenizer.normalizer.normalize_str(c) == c]
        self.spelt = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.plain = re.compile(f"[{''.join(letters)}]+").fullmatch

    def learn(self, words: set[str]) -> None:
        """Make sure that all ``words`` are held."""
        new = words.difference(self)
        for word in words - new:
            self[word] = self.pop(word)  # last in order
        if len(self) + 2 * len(new) > self.limit:
            for word in list(self)[:len(self) // 2]:
                del self[word]
            self[""] = b""
            new = words.difference(self)
        # A word of letters and a tail of other signs is two pre-tokens, and
        # the tokenizer folds case, so most new words are known in their parts.
        whole, single, parts, plain = [], set(), [], self.plain
        for word in new:
            if plain(word):
                single.add(word)
                continue
            stem = word.rstrip(_SIGNS)
            low = stem.lower()
            if not low.isalpha() or "\u03a3" in stem:  # (capital sigma folds by its place)
                whole.append(word)
                continue
            if low not in self:
                single.add(low)
            if low != word:
                tail = word[len(stem):]
                if tail not in self:
                    single.add(tail)
                parts.append((word, low, tail))
        for at in range(0, len(whole), _JOINED):
            group = whole[at:at + _JOINED]
            for word, e in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False),
                               strict=True):
                self[word] = np.array(e.ids, dtype="<u4").tobytes()
        self._encode_single(list(single))
        for word, low, tail in parts:
            self[word] = self[low] + self[tail]

    def _encode_single(self, words: list[str]) -> None:
        """Ids of words that are one pre-token each. Words of plain letters go to the
        tokenizer's model at once; of others many go in one call, told apart by the ids
        that end a word."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, array("I"), [0]
        own = list(filter(self.plain, words))
        for word in own:
            spelt = word if word.isascii() else word.translate(self.spelt)
            ids.extend([token.id for token in tokenize(spelt)])
            ends.append(4 * len(ids))
        raw = np.array(ids, dtype="<u4").tobytes()
        self.update((word, raw[a:b]) for word, (a, b) in zip(own, itertools.pairwise(ends), strict=True))
        words = [word for word in words if not self.plain(word)]
        for at in range(0, len(words), _JOINED):
            group = words[at:at + _JOINED]
            e = self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0]
            ids = np.array(e.ids, dtype="<u4")
            raw, begin = ids.tobytes(), 0
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            for word, end in zip(group, ends, strict=True):
                self[word] = raw[begin:end]
                begin = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, each as little-endian uint32 bytes."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tobytes() for a, b in itertools.pairwise([0, *ends.tolist()])]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and where each text's end. The
        tokenizer drops white space and no token spans it, so a text's ids are those of
        its words in turn; each different word is looked up once."""
        split = pc.split_pattern(pa.array([_spaced(t) if t else "" for t in texts], pa.string()), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(set(distinct))
        found = list(map(self.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        table, begin = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        word = words.indices.to_numpy()
        ends = np.cumsum(sizes[word])
        shift = begin[word] - ends + sizes[word]  # from a place in the result to one in the table
        ids = table[np.repeat(shift, sizes[word]) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[split.offsets.to_numpy()[1:]]


def _spaced(text: str) -> str:
    """The text with spaces for white space and between a word and the signs that end
    it, where two pre-tokens meet; case is folded as the tokenizer does. Not so
    beside what may be a special token, which is matched before folding, nor
    with a capital sigma or dotted I, which fold by their place or to two."""
    if not any(odd in text for odd in _ODD):
        text = _WORD_THEN_SIGNS.sub(r" \g<0>", text.lower())
    return text.replace("\n", " ").replace("\t", " ")


def token_pieces(docs: DataFrame, tokenizer_path: str, keys: list[str], text: str = "text",
                 max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``keys``, ``start`` (the document's ids before it),
    ``length``, ``ids`` (little-endian uint32 bytes) and ``doc_tokens`` (with
    the end id). A document is cut after every ``max_tokens`` ids.

    The tokenizer must drop white space (as word-end BPE files do). A null or
    empty text has the end id alone. Repeated documents each have their own
    pieces. Columns outside ``keys`` are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = Shared(docs.sparkSession, f.read())

    rows = docs.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*(rows.schema[k] for k in keys), *_PIECE_FIELDS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = spec.build(WordIds)
        for batch in batches:
            begin = 0
            for part in chunks(batch.column(len(keys))):
                # one batch out for each few texts: ids are never held for more
                ids, ends = encoder.encode_flat(part)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                tokens = np.diff(ends, prepend=0)
                cuts = -(-tokens // max_tokens)
                owner = np.repeat(np.arange(len(part)), cuts)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * max_tokens
                length = np.minimum(tokens[owner] - start, max_tokens)
                offsets = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                pieces = pa.BinaryArray.from_buffers(
                    pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                whose = pa.array(begin + owner)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(whose) for k in range(len(keys))), pa.array(start),
                     pa.array(length), pieces, pa.array(tokens[owner])],
                    names=[*keys, *(f.name for f in _PIECE_FIELDS)])
                begin += len(part)
            give_back()
    return rows.mapInArrow(cut, schema)


@dataclass
class Pattern:
    """``count`` sequences that all hold ``runs`` of (length, copies)."""

    count: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def plus(self, length: int, copies: int, count: int) -> Pattern:
        if self.runs and self.runs[-1][0] == length:
            return Pattern(count, [*self.runs[:-1], (length, self.runs[-1][1] + copies)])
        return Pattern(count, [*self.runs, (length, copies)])


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[Pattern]:
    """Patterns that place every length of the histogram.

    Lengths go longest first; each goes into the packs with the most room
    left (the shortest packs), and where it fits none into new packs, as many
    copies as fit. One step turns whole patterns over and splits at most one,
    so there are at most two patterns a length.
    """
    room_of: dict[int, list[Pattern]] = {}  # room left -> patterns
    rooms: list[int] = []  # keys of room_of in order

    def put(room: int, p: Pattern) -> None:
        if p.count:
            if room not in room_of:
                room_of[room] = []
                insort(rooms, room)
            room_of[room].append(p)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern = room_of[room].pop()
            if not room_of[room]:
                del room_of[room]
                del rooms[bisect_left(rooms, room)]
            used = min(left, pattern.count)
            put(room, Pattern(pattern.count - used, pattern.runs))
            put(room - length, pattern.plus(length, 1, used))
            left -= used
        each = max_tokens // length
        put(max_tokens - each * length, Pattern(left // each, [(length, each)]))
        if left % each:
            put(max_tokens - left % each * length, Pattern(1, [(length, left % each)]))
    return [p for room in rooms for p in room_of[room]]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, copies, first sequence, offset)``: the
    pieces of a length, by rank, in the sequences of each pattern."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, copies in p.runs:
            lo = rank.get(length, 0)
            rank[length] = lo + copies * p.count
            out.append((length, lo, rank[length], copies, sequence, offset))
            offset += copies * length
        sequence += p.count
    return out


def pack(pieces: DataFrame, order: list[str | Column], max_tokens: int = MAX_TOKENS,
         salts: int | None = None) -> DataFrame:
    """``pieces`` (a column ``length`` of 1 to ``max_tokens``) with ``sequence_id``
    and ``offset``: gapless from 0 inside each sequence, none over
    ``max_tokens``.

    ``pieces`` is read three times and should be a stored table. ``order``
    ranks the pieces of a length; rows equal in all of it must be
    interchangeable. A length may hold most rows: ranks are counted inside
    ``salts`` hash groups of each length (the shuffle partitions by default),
    shifted by the sizes of the groups before. An empty table packs to an
    empty one. The slot table is bounded: at most two patterns a length, each
    with at most sqrt(2 max_tokens) different lengths.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if any(n < 1 or n > max_tokens for n in histogram):
        raise ValueError(f"a piece must have 1 to {max_tokens} tokens")
    places = spark.createDataFrame(
        slots(shortest_pack_first(histogram, max_tokens)),
        "_len long, _lo long, _hi long, _copies long, _first long, _at long")
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"),
                           F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*cols))
    ranked = (salted.withColumn("_rank", inside - 1)
              .join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s")))
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_len"))
                         & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    step = F.col("_rank") - F.col("_lo")
    return placed.select(
        *pieces.columns, (F.col("_first") + F.floor(step / F.col("_copies"))).alias("sequence_id"),
        (F.col("_at") + step % F.col("_copies") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                   with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places: ``key``, ``start``, ``length``,
    ``doc_tokens``, ``ids_crc32``, ``sequence_id``, ``offset`` and, unless
    ``with_ids`` is off, ``ids``.

    Null keys and repeated documents are packed like any other row.
    """
    pieces = token_pieces(docs, tokenizer_path, [key], text, max_tokens, end_id)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    order = [key, "start", "doc_tokens", "ids_crc32"]
    pieces = pieces.select(key, "start", "length", "ids_crc32", "doc_tokens",
                           *(["ids"] if with_ids else []))
    return pack(stored(pieces, "pieces"), order + (["ids"] if with_ids else []), max_tokens)


def sequences(packed: DataFrame, max_tokens: int = MAX_TOKENS, pad_id: int = 0) -> DataFrame:
    """The token sequences themselves: ``sequence_id``, ``tokens`` (ids used),
    ``ids`` (little-endian uint32 bytes, padded to ``max_tokens`` unless the
    used length is a power of two). A group holds at most ``max_tokens`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    n = F.col("tokens")
    pad = F.expr(f"unhex(repeat(hex(reverse(unhex(lpad(hex({pad_id}), 8, '0')))), "
                 f"cast({max_tokens} - tokens as int)))")
    return joined.withColumn("ids", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids"))
                             .otherwise(F.concat("ids", pad)))
