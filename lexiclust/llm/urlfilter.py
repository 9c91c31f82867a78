"""URL filters by a Bloom filter cascade.

A rule names a host and a path; it fits the host and its subdomains where the
path starts with the rule's. A url's possible rules are therefore its host's
suffixes with the prefixes of its path that have the length of some rule's
path. All such keys of the corpus are the key universe. A cascade holds which
of them are listed: its first Bloom filter encodes the listed keys, the second
the other keys that the first lets through, the third the listed keys that the
second lets through, and so on until nothing is let through wrongly. A key of
the universe is then listed exactly if the number of filters it passes in a row
is odd. Urls are judged from the cascade alone, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, stored
from lexiclust.llm.wordhash import mix

ALLOW, BLOCK = "allow", "block"
MAX_LEVELS = 64
BITS_A_KEY = 14  # of the first level, at least; about one in 800 other keys passes
LATER_BITS = 6

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` as in ``example.com/en/``: the path starts at the
    first slash."""

    verdict: str
    name: str

    @property
    def host(self) -> str:
        return self.name.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.name[len(self.host):]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased)
    and path (then up to ``?``, ``#``); both empty without ``://`` or for null."""
    begin = F.instr(url, "://")
    rest = F.coalesce(F.when(begin > 0, url.substr(begin + 3, F.length(url))), F.lit(""))
    # (?s): a line break is like any other character
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _A, _Z)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def candidates(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """All rule names that would fit, the longest first: the host's last
    ``labels`` labels (numbers of labels that rules have) with the path's
    prefixes of the given lengths. Linear in the host, however many its dots."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    none = F.array().cast("array<string>")
    suffixes = F.filter(F.array(*(F.when(n >= x, F.substring_index(host, ".", -x))
                                  for x in labels)), F.isnotnull) if labels else none
    suffixes = F.when(host == "", none).otherwise(suffixes)
    sizes = F.filter(F.array(*(F.lit(x) for x in lengths)) if lengths
                     else F.array().cast("array<int>"), lambda x: x <= F.length(path))
    names = F.flatten(F.transform(suffixes, lambda h: F.transform(
        sizes, lambda x: F.concat(h, F.substring(path, F.lit(1), x)))))
    return F.array_sort(F.array_distinct(names), lambda a, b: F.length(b) - F.length(a))


def key_hash(name: Column) -> Column:
    return F.xxhash64(name)


class Bloom:
    """A Bloom filter for ``n_keys`` 64-bit key hashes; ``level`` seeds its positions."""

    def __init__(self, n_keys: int, bits_a_key: int, level: int):
        self.size = max(64, n_keys * bits_a_key)
        self.hashes = max(1, round(bits_a_key * 0.69))
        self.seed = np.uint64(level + 1)
        self.words = np.zeros(self.size // 64 + 1, dtype=np.uint64)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a = mix(keys.view(np.uint64) + mix(np.array([self.seed])))
        b = mix(a) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(self.size)

    def add(self, keys: np.ndarray) -> Bloom:
        for at in self._places(keys):
            np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return self

    def add_table(self, keys: DataFrame) -> Bloom:
        """The keys of a table (column ``key``): their bits are set on the executors,
        merged by OR, and only the filter's own words reach the driver."""
        empty = Shared(keys.sparkSession, self)

        @F.arrow_udf("array<bigint>")
        def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bloom = empty.build(lambda filter_: filter_)
            for some in batches:
                at = np.stack(list(bloom._places(some.to_numpy(zero_copy_only=False))), axis=1)
                ends = np.arange(len(some) + 1, dtype=np.int32) * bloom.hashes
                yield pa.ListArray.from_arrays(ends, at.ravel().view(np.int64))
        words = (keys.select(F.explode(places("key")).alias("at"))
                 .groupBy(F.shiftright("at", 6).alias("word"))
                 .agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
                 .toArrow())
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(
            np.uint64)
        return self

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


class Cascade:
    """Filters in order; ``listed`` is exact for every key of its universe."""

    def __init__(self):
        self.levels: list[Bloom] = []

    def listed(self, keys: np.ndarray) -> np.ndarray:
        passing = np.ones(len(keys), dtype=bool)
        odd = np.zeros(len(keys), dtype=bool)
        for level in self.levels:
            passing &= level.holds(keys)
            odd ^= passing
        return odd


def _wrongly(shared: Shared):
    """True for a key that passes the level but is not listed."""

    @F.arrow_udf("boolean")
    def wrong(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bloom, inside = shared.build(lambda both: both)
        for keys in batches:
            k = keys.to_numpy(zero_copy_only=False)
            passed = bloom.holds(k)
            passed[passed] &= ~np.isin(k[passed], inside)
            yield pa.array(passed)
    return wrong


def build_cascade(universe: DataFrame, listed: np.ndarray,
                  bits_a_key: int = BITS_A_KEY) -> Cascade:
    """A cascade of ``listed`` (key hashes) exact over ``universe`` (a stored
    table of distinct key hashes ``key``). Each level keeps of the universe only
    what passed the levels before, so a level costs one scan of what is left.

    The first filter's bits follow the universe (1.44 log2 of its keys for each
    listed key, at least ``bits_a_key``), so about as many keys pass it wrongly as
    are listed and the whole cascade stays in proportion to the rules, however
    many urls there are. Filters of corpus keys are built on the executors."""
    out = Cascade()
    if not len(listed):
        return out
    spark = universe.sparkSession
    inside = every = np.unique(listed)
    left, n_wrong = universe, universe.count()
    first_bits = max(bits_a_key, math.ceil(1.44 * math.log2(max(1, n_wrong / len(every)))))
    for level in range(MAX_LEVELS):
        if level % 2 == 0:  # a filter of listed keys: which others pass?
            bloom = Bloom(len(inside), first_bits if level == 0 else LATER_BITS, level).add(inside)
            left = stored(left.where(_wrongly(Shared(spark, (bloom, every)))("key")), "passing")
            n_wrong = left.count()
        else:  # a filter of other keys: which listed ones pass?
            bloom = Bloom(n_wrong, LATER_BITS, level).add_table(left)
            inside = inside[bloom.holds(inside)]
            n_wrong = len(inside)
        out.levels.append(bloom)
        if not n_wrong:
            return out
    raise ValueError("the cascade does not end; two keys share a hash")


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", out: str = "judged",
          default: str = ALLOW) -> DataFrame:
    """``pages`` with a struct ``out`` of ``host``, ``path``, ``rule`` (the
    longest that fits, else null) and ``verdict`` (its verdict, else
    ``default``).

    The cascades (one of all rules, one of the blocking ones) are built over
    the keys of all urls. A rule given with both verdicts blocks. A null or
    malformed url has an empty host and path and no rule. Repeated urls are
    judged alike; all other columns stay, but a column already named ``out`` is
    replaced. ``pages`` is read twice.
    """
    lengths = sorted({len(r.path) for r in rules})
    labels = sorted({r.host.count(".") + 1 for r in rules})
    host, path = host_and_path(F.col(url))
    spread = pages.select(host.alias("h"), path.alias("p")).distinct()
    keys = spread.select(F.explode(candidates(F.col("h"), F.col("p"), lengths, labels))
                         .alias("name"))
    universe = stored(keys.distinct().select(key_hash(F.col("name")).alias("key")).distinct(),
                      "universe")
    names = sorted({r.name for r in rules})
    blocking = {r.name for r in rules if r.verdict == BLOCK}
    spark = pages.sparkSession
    hashed = {}
    if names:
        hashed = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "name string")
                  .select("name", key_hash(F.col("name"))).collect()}
    as_keys = lambda some: np.array([hashed[n] for n in some], dtype=np.int64)
    cascades = Shared(spark, (build_cascade(universe, as_keys(names)),
                              build_cascade(universe, as_keys(sorted(blocking)))))

    @F.arrow_udf("struct<at:int,blocked:boolean>")
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The first (longest) listed candidate, from 1, and if it blocks."""
        rules_of, blocks = cascades.build(lambda both: both)
        for arr in batches:
            flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) if x is not None else 0 for x in arr.to_pylist()],
                             dtype=np.int64)
            hit = np.flatnonzero(rules_of.listed(flat))
            begins = np.cumsum(sizes) - sizes
            nth = np.searchsorted(hit, begins)
            ok = (nth < len(hit)) & (sizes > 0)
            where = np.where(ok, hit[np.minimum(nth, len(hit) - 1)] if len(hit) else 0, 0)
            ok &= where < begins + sizes
            verdict = blocks.listed(flat[where]) if len(flat) else np.zeros(len(arr), bool)
            yield pa.StructArray.from_arrays(
                [pa.array(np.where(ok, where - begins + 1, 0), pa.int32()),
                 pa.array(verdict & ok)], names=["at", "blocked"])

    at = _free(pages, "url_parts")
    field = lambda name: F.col(f"{at}.{name}")
    found = pages.withColumn(at, F.struct(host.alias("host"), path.alias("path")))
    found = found.withColumn(at, F.struct(
        field("host"), field("path"),
        candidates(field("host"), field("path"), lengths, labels).alias("names")))
    found = found.withColumn(at, F.struct(
        f"{at}.*", first(F.transform(field("names"), key_hash)).alias("first")))
    fits = field("first.at") > 0
    verdict = F.when(fits, F.when(field("first.blocked"), BLOCK).otherwise(ALLOW))
    judged = F.struct(
        field("host"), field("path"),
        F.when(fits, F.get(field("names"), field("first.at") - 1)).alias("rule"),
        F.coalesce(verdict, F.lit(default)).alias("verdict"))
    return found.withColumn(out, judged).drop(at)
