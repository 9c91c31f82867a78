"""Quality classifier by nearest-neighbour voting.

A text becomes counts of terms: hashed word shapes (``x.``, ``X!!``, ``x***``),
repeats (the word or the shingle seen before, and how far back) and hashed
words. Latent-semantic analysis of a bounded sample of labelled texts gives
each text a dense unit vector. The labelled vectors are broadcast; every text
is compared with all of them in blocked exact cosine products, and its nearest
ones vote, each with the power of its similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiclust.llm.common import Shared, bounded_sample, chunks, give_back, held_out
from lexiclust.llm.wordhash import mix, powers, segment, shingle_hashes

TRAIN_ROWS = 6000  # labelled texts in the broadcast model, at most about this many
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 8.0
THRESHOLD = 0.3

_SHAPES, _REPEATS, _WORDS = 1024, 16, 512
TERMS = _SHAPES + _REPEATS + _WORDS

# Letters fold to one class each of lower and upper case, digits to another;
# every other ASCII byte is its own class, and bytes of other scripts are lower.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")


def term_counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its terms (ascending) and how often each occurs."""
    raw = [(t or "").encode() for t in texts]
    words = segment(raw)
    h = words.hashes()
    shapes = _shape_hashes(words)
    terms = [(shapes % np.uint64(_SHAPES)).astype(np.int64),
             (mix(h ^ np.uint64(1)) % np.uint64(_WORDS)).astype(np.int64) + _SHAPES + _REPEATS]
    out = []
    shingles = shingle_hashes(words, 4)
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(),
                                   strict=True)):
        own = h[a:b]
        repeats = np.array([_equal(own, 1), _equal(own, 2), _equal(own, 3),
                            b - a - len(np.unique(own)),
                            len(shingles[d]) - len(np.unique(shingles[d]))])
        ids, n = np.unique(np.concatenate([t[a:b] for t in terms]), return_counts=True)
        kinds = np.flatnonzero(repeats)
        ids = np.concatenate([ids, kinds + _SHAPES])
        n = np.concatenate([n, repeats[kinds]])
        order = np.argsort(ids)
        out.append((ids[order], n[order]))
    return out


def _equal(h: np.ndarray, lag: int) -> int:
    return int((h[lag:] == h[:-lag]).sum())


def _shape_hashes(words) -> np.ndarray:
    """A hash of each word's classes with runs of one class drawn together."""
    if not len(words.begin):
        return np.empty(0, dtype=np.uint64)
    where, place, at = words.letters()
    kind = _CLASS[words.data[where]]
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | (place == 0)
    nth = np.cumsum(change)
    nth -= np.repeat(nth[at], words.lengths)
    weight = powers(int(nth.max()) + 1)
    return mix(np.add.reduceat(np.where(change, kind, np.uint64(0)) * weight[nth], at))


class LatentModel:
    """Latent-semantic projection and the labelled vectors of the sample."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
                 dimensions: int = DIMENSIONS):
        n = max(1, len(counts))
        df = np.zeros(TERMS)
        for ids, _ in counts:
            df[ids] += 1
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32)
        gram = np.zeros((TERMS, TERMS))
        for at in range(0, len(counts), 512):
            block = self.weigh(counts[at:at + 512]).astype(np.float64)
            gram += block.T @ block
        _, vectors = np.linalg.eigh(gram)
        self.projection = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions], dtype=np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.vectors = self.embed(counts)
        kept = np.abs(self.vectors).sum(axis=1) > 0
        self.vectors, self.labels = self.vectors[kept], self.labels[kept]

    def weigh(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit rows of (1 + ln count) * idf."""
        out = np.zeros((len(counts), TERMS), dtype=np.float32)
        for row, (ids, n) in enumerate(counts):
            out[row, ids] = (1 + np.log(n)) * self.idf[ids]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def embed(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit latent vectors; a zero row where no term is known."""
        out = np.zeros((len(counts), self.projection.shape[1]), dtype=np.float32)
        for at in range(0, len(counts), 512):
            out[at:at + 512] = self.weigh(counts[at:at + 512]) @ self.projection
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 1e-6, out / np.where(norm > 1e-6, norm, 1), 0)

    def scores(self, texts: list[str | None], neighbours: int = NEIGHBOURS,
               power: float = POWER) -> np.ndarray:
        """Votes of the nearest labelled vectors, 0 to 1; the labels' mean for
        a text without terms or when there is no model."""
        out = np.full(len(texts), self.prior)
        k = min(neighbours, len(self.vectors))
        vectors = self.embed(term_counts(texts))
        known = np.flatnonzero(np.abs(vectors).sum(axis=1) > 0)
        if not k or not len(known):
            return out
        cosines = vectors[known] @ self.vectors.T
        best = np.argpartition(cosines, -k, axis=1)[:, -k:] if k < len(self.vectors) else \
            np.broadcast_to(np.arange(k), (len(known), k))
        weight = np.maximum(np.take_along_axis(cosines, best, axis=1), 0).astype(np.float64) ** power
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        out[known] = np.where(total > 0, vote, self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", train_rows: int = TRAIN_ROWS,
        dimensions: int = DIMENSIONS) -> LatentModel:
    """A model from the labelled documents that are not held out.

    The sample is bounded by ``train_rows`` labels (by hash of the key, the
    same for any partitioning). Repeated labels of a key count as their mean,
    repeated documents of a key as one; null keys, labels and texts teach
    nothing. Only the sample's term counts reach the driver. Without labels
    the model scores every text 0.5.
    """
    known = (labels.where(F.col(label).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("_label")))
    known = bounded_sample(known, F.col("_key"), train_rows)

    @F.arrow_udf("struct<ids:array<int>,n:array<int>>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [{"ids": i.tolist(), "n": n.tolist()} for part in chunks(texts)
                    for i, n in term_counts(part)]
            yield pa.array(rows, pa.struct([("ids", pa.list_(pa.int32())),
                                            ("n", pa.list_(pa.int32()))]))

    rows = (docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"),
                                                       F.col(text).alias("_text"))
            .join(F.broadcast(known), "_key")
            .groupBy("_key").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
            .select("_key", "_label", terms("_text").alias("_terms")).toArrow())
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_key", "ascending")]))
    counts = [(np.array(r["ids"], dtype=np.int64), np.array(r["n"], dtype=np.int64))
              for r in rows.column("_terms").to_pylist()]
    return LatentModel(counts, np.array(rows.column("_label").to_pylist(), dtype=np.float64),
                       dimensions)


def score(docs: DataFrame, model: LatentModel, text: str = "text", out: str = "quality_score",
          neighbours: int = NEIGHBOURS, power: float = POWER) -> DataFrame:
    """``docs`` with a double ``out`` from 0 to 1, higher where label 1 is
    likelier. Only the text is read. An empty or null text, or one without a
    known term, gets the labels' mean. All other columns stay; a column already
    named ``out`` is replaced. The model (``train_rows`` short vectors and one
    projection) is broadcast."""
    shared = Shared(docs.sparkSession, model)

    @F.arrow_udf("double")
    def votes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.build(lambda value: value)
        for texts in batches:
            parts = [m.scores(part, neighbours, power) for part in chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())
        give_back()
    return docs.withColumn(out, votes(F.col(text)))
