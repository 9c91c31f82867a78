"""Near-duplicate documents by a signature-coordinate inverted join.

Each document is the set of its distinct word shingles. Equal sets are one
class with one representative. A representative's MinHash signature has
``COORDINATES`` coordinates; a pair at the threshold shares almost all of them
and at least ``matches`` (15 at 0.85, 12 at 0.80), so it must share one of the
first ``COORDINATES - matches + 1`` (the prefix): documents are posted only under
those coordinate-value pairs. Inside a posting list the two whole signatures are
laid side by side (eight coordinates in one 64-bit word), the collisions are
counted and pairs below ``matches`` are skipped. What is left is confirmed on the
full sets.

Members of a list are first compared with its first one. What is then in several
components meets inside one task: the members' signatures are counted against each
other there and only pairs that may be linked leave it. Where these are many (a list
of near copies), the members' sets are counted instead, exactly and all at once, as
products of their incidence matrices, and only one link a member leaves the task.

A list of more than ``LIST_LENGTH`` documents is never paired with itself as
it is. If members of several components remain, those documents are peeled: one can be in a link only if
the shingles that others of them have too make up the threshold's share of its
set. The rest are posted again under longer tuples of coordinates, in which
only very similar documents meet. Nothing is dropped without such a proof.

``matches``, the lists that long pairs share and the tuples of the later rounds
follow from the threshold: a pair exactly at it has fewer matches with
probability ``MISSED_MATCHES`` at most, and fewer lists or no tuple of a later
round with ``MISSED_LISTS`` at most; more similar pairs with far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, bounded_batches, chunks, give_back, stored
from lexiclust.llm.components import connected_components
from lexiclust.llm.wordhash import mix, segment, shingle_hashes

SHINGLE_WORDS = 5
THRESHOLD = 85  # percent
COORDINATES = 32
LIST_LENGTH = 4096
# A list with more candidate pairs than this for each member has its sets counted, if
# they hold no more shingles together than that.
DENSE_PAIRS = 4
DENSE_SHINGLES = 1 << 22
SQUARE_ROWS, SQUARE_COLUMNS = 256, 1024  # of the products that count a list's sets
PAIRS_HELD = 1 << 17  # candidate pairs of one Arrow batch
# How likely a pair exactly at the threshold may be passed over by the matches, and
# by the lists and tuples of each round.
MISSED_MATCHES = 1e-7
MISSED_LISTS = 5.4e-9
# The rounds after the first take the widest tuples of which no more than these do.
LATER_TUPLES = (24, 64)
BROADCAST_IDS = 1_000_000


def shared_at_least(coordinates: int, threshold: int, missed: float) -> int:
    """The largest count of which a pair at ``threshold`` percent shares fewer, of
    ``coordinates``, with probability ``missed`` at most (0: it may share none)."""
    t, below = threshold / 100, 0.0
    for n in range(coordinates + 1):
        below += math.comb(coordinates, n) * t ** n * (1 - t) ** (coordinates - n)
        if below > missed:
            return n
    return coordinates


def later_rounds(threshold: int) -> list[tuple[int, int]]:
    """``(tuples, coordinates in each)`` of the rounds after the first."""
    def tuples(width: int) -> int:
        alone = 1 - (threshold / 100) ** width
        return math.ceil(math.log(MISSED_LISTS) / math.log(alone)) if alone else 1

    # (at 100 % one tuple of any width does)
    return [(tuples(w), w) for w in (max([1, *(w for w in range(2, 33) if tuples(w) <= most)])
                                     for most in LATER_TUPLES)]


def shingle_sets(texts: list[str | None], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text: A-Z lower-cased,
    words ``[^\\x20\\x09-\\x0D]+``; fewer words than ``size`` are one shingle,
    none are the empty set."""
    raw = [(t or "").encode().lower() for t in texts]
    return [np.unique(h) for h in shingle_hashes(segment(raw), size)]


def minima(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    """The MinHash signature of a set that is not empty."""
    factor = mix(np.arange(1, coordinates + 1, dtype=np.uint64) + np.uint64(seed << 20))
    factor |= np.uint64(1)
    out = np.empty(coordinates, dtype=np.uint64)
    for at in range(0, coordinates, 32):
        out[at:at + 32] = (shingles[None, :] * factor[at:at + 32, None]).min(axis=1)
    return mix(out)


_SKETCH = pa.struct([("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                     ("keys", pa.list_(pa.int64())), ("packed", pa.list_(pa.int64()))])
_SKETCH_DDL = ("struct<n:bigint,hi:bigint,lo:bigint,keys:array<bigint>,packed:array<bigint>>")


def _sketcher(size: int, coordinates: int, matches: int):
    """Set size, a 128-bit digest of the set, the posting keys of the prefix
    and the signature's low bytes, eight to a word."""
    prefix = coordinates - matches + 1

    @F.arrow_udf(_SKETCH_DDL)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        Shared.release()
        place = np.arange(prefix, dtype=np.uint64) << np.uint64(56)
        for texts in batches:
            rows = []
            for part in chunks(texts):
                for s in shingle_sets(part, size):
                    if not len(s):
                        rows.append({"n": 0})
                        continue
                    sig = minima(s, coordinates, 0)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                    keys = (sig[:prefix] >> np.uint64(8)) | place
                    rows.append({
                        "n": len(s), "hi": int(digest[0]), "lo": int(digest[1]),
                        "keys": keys.view(np.int64).tolist(),
                        "packed": sig.astype(np.uint8).view(np.int64).tolist()})
            yield pa.array(rows, type=_SKETCH)
    return sketch


def _tupler(size: int, tuples: int, width: int):
    """Posting keys that stand for ``width`` coordinates together."""

    @F.arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = np.arange(tuples, dtype=np.uint64) << np.uint64(56)
        for texts in batches:
            rows = []
            for part in chunks(texts):
                for s in shingle_sets(part, size):
                    if not len(s):
                        rows.append([])
                        continue
                    sig = minima(s, tuples * width, width).reshape(tuples, width)
                    joint = np.zeros(tuples, dtype=np.uint64)
                    for j in range(width):
                        joint = mix(joint + sig[:, j])
                    rows.append(((joint >> np.uint64(8)) | place).view(np.int64).tolist())
            yield pa.array(rows, type=pa.list_(pa.int64()))
    return keys


def _setter(size: int):
    @F.arrow_udf("array<bigint>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        Shared.release()
        for texts in batches:
            rows = [s.view(np.int64) for part in chunks(texts) for s in shingle_sets(part, size)]
            ends = np.cumsum([0, *map(len, rows)])
            flat = np.concatenate([*rows, np.empty(0, dtype=np.int64)])
            del rows
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    return sets


def _collisions(words: int) -> Column:
    """How many bytes of two packed signatures agree: at least as many as
    coordinates do (one in 256 others by chance)."""
    agree = F.lit(8 * words)
    for i in range(words):
        x = F.expr(f"x.s{i} ^ y.s{i}")
        for shift in (4, 2, 1):  # every byte's bits gather in its lowest one
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        agree = agree - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return agree


def _close(threshold: int) -> Column:
    """Set sizes that allow the threshold, and shared parts that do: the
    intersection is at most the smaller of the shared counts ``c``."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    inter = F.least("x.c", "y.c")
    return (small * 100 >= large * threshold) & (
        inter * 100 >= (F.col("x.n") + F.col("y.n") - inter) * threshold)


def _candidates(threshold: int, matches: int):
    """Of each list the pairs that ``_Search.fits`` allows, or one row of nulls where its
    sets are to be counted."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = batch.column("m").slice(i, 1).flatten()
                ids, comp = m.field("id"), m.field("comp").dictionary_encode().indices.to_numpy()
                n, c = m.field("n").to_numpy(), m.field("c").to_numpy()
                sig = m.field("s").flatten().to_numpy().reshape(len(n), -1).view(np.uint8)
                countable = int(n.sum()) <= DENSE_SHINGLES
                left, right, held = [], [], 0

                def pairs():
                    a, b = np.concatenate(left), np.concatenate(right)
                    return pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(np.full(len(a), i))), ids.take(pa.array(a)),
                         ids.take(pa.array(b))], names=["key", "a", "b"])

                for at in range(0, len(n), 64):
                    x = np.arange(at, min(at + 64, len(n)))[:, None]
                    small, large = np.minimum(n[x], n), np.maximum(n[x], n)
                    shared = np.minimum(c[x], c)
                    fits = ((np.arange(len(n)) > x) & (comp[x] != comp) & (small * 100 >= large * threshold)
                            & (shared * 100 >= (n[x] + n - shared) * threshold))
                    a, b = np.nonzero(fits)
                    a += at
                    close = np.empty(len(a), dtype=bool)
                    for k in range(0, len(a), 1 << 16):
                        part = slice(k, k + (1 << 16))
                        close[part] = (sig[a[part]] == sig[b[part]]).sum(axis=1) >= matches
                    left.append(a[close])
                    right.append(b[close])
                    held += len(left[-1])
                    if countable and held > DENSE_PAIRS * len(n):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("key").slice(i, 1), pa.nulls(1, ids.type),
                             pa.nulls(1, ids.type)], names=["key", "a", "b"])
                        break
                    if not countable and held > PAIRS_HELD:
                        yield pairs()
                        left, right, held = [], [], 0
                else:
                    if left:
                        yield pairs()
        give_back()
    return fn


def _counted(threshold: int):
    """The components of each list under the exact threshold, as links to one member."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m = batch.column("m").slice(i, 1).flatten()
                root = components_of([s.values.to_numpy() for s in m.field("set")], threshold)
                other = np.flatnonzero(root != np.arange(len(root)))
                ids = m.field("id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(root[other])), ids.take(pa.array(other))], names=["a", "b"])
        give_back()
    return fn


def components_of(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each set the first one that links lead to. Of the squares of the sets' count
    only one, of single bytes, is held; the others are made for some sets at a time."""
    count = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=count)
    owner, starts = _by_shared(sets, sizes)
    linked = np.empty((count, count), dtype=bool)
    for lo in range(0, count, SQUARE_ROWS):
        rows = slice(lo, min(lo + SQUARE_ROWS, count))
        inter = np.zeros((rows.stop - lo, count - lo), dtype=np.float32)
        for at in range(0, len(starts) - 1, SQUARE_COLUMNS):
            ends = starts[at:at + SQUARE_COLUMNS + 1]
            column = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            mine = owner[ends[0]:ends[-1]]
            part = np.zeros((count - lo, SQUARE_COLUMNS), dtype=np.float32)
            part[mine[mine >= lo] - lo, column[mine >= lo]] = 1
            inter += part[:rows.stop - lo] @ part.T
        both = inter.astype(np.int64)
        linked[rows, lo:] = both * 100 >= (sizes[rows, None] + sizes[lo:] - both) * threshold
        linked[lo:, rows] = linked[rows, lo:].T
    root = np.arange(count)
    while True:
        near = np.empty_like(root)
        for lo in range(0, count, SQUARE_ROWS):
            near[lo:lo + SQUARE_ROWS] = np.where(linked[lo:lo + SQUARE_ROWS], root, count).min(axis=1)
        near = np.minimum(near, root)
        near = near[near]
        if (near == root).all():
            return root
        root = near


def _by_shared(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that hold each shingle of more than one set, shingle by shingle, and
    where each shingle's begin, with the end."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(flat), 1), dtype=bool), flat[1:] != flat[:-1]]))
    del flat
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[order]
    del order
    times = np.diff(np.append(first, len(owner)))
    owner = owner[np.repeat(times > 1, times)]
    return owner, np.concatenate([[0], np.cumsum(times[times > 1])])


class _Search:
    """One run over the representatives of a document table (``info``: ``id``,
    set size ``n``, shared part ``c`` and signature words ``s0``...)."""

    def __init__(self, docs: DataFrame, info: DataFrame, size: int, threshold: int, matches: int,
                 list_length: int, words: int):
        self.docs, self.info, self.size, self.threshold = docs, info, size, threshold
        self.list_length, self.later, self.matches = list_length, later_rounds(threshold), matches
        # of the first round's lists, which are 8 * words - matches + 1 a document
        self.long_lists = max(1, shared_at_least(8 * words - matches + 1, threshold, MISSED_LISTS))
        self.fits = _close(threshold) & (_collisions(words) >= matches)

    def texts(self, ids: DataFrame) -> DataFrame:
        """``id, _text`` of the given distinct ids (any of the rows of an id:
        the caller keeps what fits)."""
        ids = ids.select("id")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return self.docs.join(ids, "id", "left_semi")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold on their full sets."""
        pairs = stored(pairs.distinct(), "pairs")
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = self.sets(ids)
        a = sets.select(F.col("id").alias("a"), F.col("set").alias("_x"))
        b = sets.select(F.col("id").alias("b"), F.col("set").alias("_y"))
        both = pairs.join(a, "a").join(b, "b").select(
            "a", "b", F.size("_x").alias("nx"), F.size("_y").alias("ny"),
            F.size(F.array_intersect("_x", "_y")).alias("m"))
        return stored(both.where((F.col("nx") + F.col("ny") - F.col("m")) * self.threshold
                                 <= F.col("m") * 100).select("a", "b"), "links")

    def sets(self, ids: DataFrame) -> DataFrame:
        sets = self.texts(ids).select("id", _setter(self.size)("_text").alias("set"))
        return stored(sets, "sets")

    def stars(self, kept: DataFrame) -> DataFrame:
        """Every document with the first one of each of its lists."""
        star = kept.where("id <> lead").select("id", "lead").distinct()
        x, y = self.info.alias("x"), self.info.alias("y")
        return (star.join(x, F.col("x.id") == star["id"]).join(y, F.col("y.id") == star["lead"])
                .where(self.fits).select(F.col("y.id").alias("a"), F.col("x.id").alias("b")))

    def paired(self, lists: DataFrame) -> DataFrame:
        """The links between members of each list that are in different components,
        every pair compared."""
        rows = lists.select("key", "id", "comp").join(self.info, "id")
        pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key"))
                                     & (F.col("x.id") < F.col("y.id"))
                                     & (F.col("x.comp") != F.col("y.comp")) & self.fits)
        return self.confirmed(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))

    def across(self, lists: DataFrame) -> DataFrame:
        """Links that join the components of each list (of at most ``list_length``
        members) as all pairs of its members would."""
        rows = lists.select("key", "id", "comp").join(self.info, "id")
        words = [c for c in self.info.columns if c not in ("id", "n", "c")]
        grouped = rows.groupBy("key").agg(
            F.collect_list(F.struct("id", "comp", "n", "c", F.array(*words).alias("s"))).alias("m"))
        kind = self.info.schema["id"].dataType.simpleString()
        found = stored(grouped.mapInArrow(_candidates(self.threshold, self.matches),
                                          f"key bigint, a {kind}, b {kind}"), "candidates")
        links = self.confirmed(found.where("a is not null").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        dense = found.where("a is null").select("key")
        if dense.isEmpty():
            return links
        members = stored(lists.select("key", "id").join(dense, "key"), "dense")
        sets = self.sets(members.select("id").distinct())
        # An id whose rows differ has several sets; the classes keep the one of its size.
        whole = members.join(sets, "id").join(self.info.select("id", "n"), "id").where(
            F.size("set") == F.col("n")).groupBy("key").agg(
            F.collect_list(F.struct("id", "set")).alias("m"))
        return links.union(stored(whole.mapInArrow(_counted(self.threshold), f"a {kind}, b {kind}"), "links"))

    def mixed(self, kept: DataFrame, found: DataFrame) -> DataFrame:
        """The lists whose members are in several components, with ``comp``."""
        comps = connected_components(found)
        placed = kept.drop("comp").join(comps, "id", "left").withColumn(
            "comp", F.coalesce("component", "id")).drop("component")
        several = (placed.groupBy("key").agg(F.min("comp").alias("l"), F.max("comp").alias("h"))
                   .where("l < h").select("key"))
        return stored(placed.join(several, "key"), "mixed")

    def banded(self, lists: DataFrame) -> DataFrame:
        """Lists split by set size into bands as wide as the threshold allows;
        every document is in its band and the next, so a pair that can be linked
        meets. ``banded``: the size of the part; parts of one component go."""
        width = -math.log(self.threshold / 100) * (1 + 1e-9)  # no pair at the very edge is lost
        band = F.floor(F.log("n") / width).alias("_band")
        rows = lists.join(self.info.select("id", "n"), "id").select(
            "key", "id", "lead", "comp", "size", band)
        rows = rows.select(F.explode(F.array("_band", F.col("_band") + 1)).alias("_band"), "key", "id",
                           "lead", "comp", "size").withColumn("key", F.xxhash64("key", "_band"))
        parts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("banded"), F.min("comp").alias("l"),
                                        F.max("comp").alias("h")).where("l < h").drop("l", "h")
        return stored(rows.drop("_band").join(parts, "key"), "banded")

    def links(self, posts: DataFrame) -> DataFrame:
        """All links between representatives that their components need."""
        found, level = None, 0
        while True:
            lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size"),
                                             F.min("id").alias("lead")).where("size > 1")
            kept = stored(posts.join(lists, "key"), "kept")
            new = self.confirmed(self.stars(kept))
            found = new if found is None else found.union(new)
            mixed = self.mixed(kept, found)
            short = F.col("size") <= self.list_length
            last = level == len(self.later)  # what still meets here is paired in full
            if mixed.isEmpty():
                return found
            if last:
                return found.union(self.across(mixed.where(short))).union(
                    self.paired(mixed.where(~short)))
            banded = self.banded(mixed.where(~short))
            settled = F.col("banded") <= self.list_length
            new = self.across(mixed.where(short).select("key", "id", "comp").union(
                banded.where(settled).select("key", "id", "comp")))
            found = found.union(new)
            mixed = banded.where(~settled).drop("banded")
            if mixed.isEmpty():
                return found
            # A pair that shares a short list is settled; one that shares only
            # long ones shares several of them.
            if not new.isEmpty():
                mixed = self.mixed(mixed, found)
            often = mixed.groupBy("id").agg(F.count(F.lit(1)).alias("_lists"),
                                            F.mode("lead", True).alias("lead"))
            often = often.where(F.col("_lists") >= (self.long_lists if level == 0 else 1))
            open_ids = stored(often.drop("_lists").join(self.info, "id"), "open")
            if open_ids.isEmpty():
                return found
            self.info = self.peeled(open_ids)
            if self.info.isEmpty():
                return found
            tuples, width = self.later[level]
            posts = stored(self.texts(self.info).select(
                "id", F.explode(_tupler(self.size, tuples, width)("_text")).alias("key")), "posts")
            level += 1

    def peeled(self, ids: DataFrame) -> DataFrame:
        """The documents that may still be in a link among themselves: enough
        of their shingles are in others of them too. ``c`` becomes that count.

        A shingle that a document shares with the first of its list (``lead``) is
        shared; only the rest of its set is laid out, beside the whole sets of
        the leads, to find what no other document has."""
        leads = ids.select(F.col("lead").alias("id")).distinct()
        sets = self.sets(ids.select("id").union(leads).distinct())
        lead_sets = sets.join(leads, "id", "left_semi").select(F.col("id").alias("lead"),
                                                               F.col("set").alias("_l"))
        own = ids.select("id", "lead").join(sets, "id").join(lead_sets, "lead")
        laid = own.select("id", F.explode(F.array_except("set", "_l")).alias("g")).union(
            lead_sets.select(F.lit(None).cast(ids.schema["id"].dataType), F.explode("_l")))
        alone = (laid.groupBy("g").agg(F.count(F.lit(1)).alias("_m"), F.min("id").alias("id"))
                 .where("_m = 1 and id is not null").groupBy("id").agg(F.count("g").alias("_u")))
        kept = ids.join(alone, "id", "left").withColumn(
            "c", F.col("n") - F.coalesce("_u", F.lit(0))).drop("_u", "lead")
        return stored(kept.where(F.col("c") * 100 >= F.col("n") * self.threshold), "open")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    size: int = SHINGLE_WORDS, threshold: int = THRESHOLD,
                    coordinates: int = COORDINATES, matches: int | None = None,
                    list_length: int = LIST_LENGTH) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of
    their shingle sets; ``component_id`` is the smallest key that can be
    reached, and the document with that key is ``kept``. Texts that are null,
    empty or without words are linked with nothing. Rows that repeat a key
    count as one document: whatever one of them is linked with, all are. A row
    with a null key is linked with nothing, has a null component and is kept.

    ``docs`` is read several times and should be a stored table; only ``key``
    and ``text`` are read. ``coordinates`` must be a multiple of 8. ``matches``
    follows from ``threshold`` and ``coordinates`` (see ``MISSED_MATCHES``); one
    given by hand that is higher loses pairs. A threshold that needs more
    coordinates (32 do down to 40) is an error.
    """
    if matches is None:
        matches = shared_at_least(coordinates, threshold, MISSED_MATCHES)
    if matches < 1:
        raise ValueError(f"{coordinates} coordinates are too few for a threshold of {threshold} %")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("_text"))
    words = coordinates // 8
    sketch = _sketcher(size, coordinates, matches)
    base = docs.select("id", sketch("_text").alias("_s")).select(
        "id", "_s.n", "_s.hi", "_s.lo", "_s.keys", "_s.packed")
    base = stored(base, "sketch")
    classes = base.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("hi", "lo").agg(
        F.min("id").alias("rep"))
    classes = stored(classes, "classes")
    reps = base.join(classes, ["hi", "lo"]).where(F.col("id") == F.col("rep")).dropDuplicates(
        ["hi", "lo"])
    reps = stored(reps.select("id", "n", F.col("n").alias("c"), "keys",
                              *(F.col("packed")[i].alias(f"s{i}") for i in range(words))), "reps")
    search = _Search(docs, reps.drop("keys"), size, threshold, matches, list_length, words)
    links = search.links(reps.select("id", F.explode("keys").alias("key")))
    # A key with several sets joins their classes.
    of_class = base.where("n > 0").join(classes, ["hi", "lo"]).select("id", "rep")
    same_key = of_class.where("id is not null and id <> rep").select(
        F.col("rep").alias("a"), F.col("id").alias("b"))
    comps = connected_components(links.union(same_key))
    rows = base.select("id", "n").join(comps, "id", "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                       component.alias("component_id"),
                       F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
