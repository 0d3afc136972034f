"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of terms of two kinds: its words, hashed into ``WORD_TERMS``
buckets, and signs of its form (trigrams of character classes, and how far its
words, neighbouring words and lines repeat). Each kind is weighted by inverse
document frequency and scaled to length one, so neither drowns the other, and
both together are projected on the leading right singular vectors of the
labelled sample (latent semantic analysis by truncated singular value
decomposition). Every document is compared with all labelled vectors by exact
blocked cosine products, and the labels of the nearest are averaged with their
similarities as weights.

The sample is at most ``max_labelled`` rows, the first by md5 of doc_id. What
the driver collects of it is sparse and bounded by ``max_labelled`` x the number
of terms, what it broadcasts by (``max_labelled`` + terms) x ``rank`` numbers.
Labels, lang, source and doc_id are never terms.

Cases: a null text is empty; an empty text has no neighbours and scores the
sample's share of label 1; with no labelled rows every score is 1, so nothing
is rejected; of several labels of a doc_id the least counts, of several texts
one; repeated rows get equal scores; ties in similarity (to six digits) go to the earlier row of the
sample; long texts are counted in chunks; further columns, whatever their names,
are kept by ``accepted``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fieldmark.llm.common import map_batches

MAX_LABELLED, RANK, NEIGHBOURS, THRESHOLD = 4096, 64, 15, 0.7
#: Buckets of words; documents scored at once.
WORD_TERMS, ROWS = 4096, 256
#: Bytes whose trigrams are counted at once.
CHUNK = 1 << 20


def _classes() -> np.ndarray:
    """Character classes: letters (all of non-ASCII too), capitals, digits, blanks, line ends, punctuation, brackets and bars, other."""
    out = np.full(256, 7, np.int64)
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:'\"()-", b"|<>{}[]=/\\_")):
        out[list(members)] = k
    out[128:] = 0
    return out


CLASSES = _classes()
FORM_TERMS = 8**3 + 3
N_TERMS = FORM_TERMS + WORD_TERMS


def terms_of(text: bytes) -> np.ndarray:
    """Square roots of the shares of each term among those of its kind in a text."""
    out = np.zeros(N_TERMS, np.float32)
    if not text:
        return out
    codes = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(codes) - 2), CHUNK):
        c = CLASSES[codes[at : at + CHUNK + 2]]
        out[:512] += np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=512)
    out[:512] /= max(1, len(codes) - 2)
    words, lines = text.split(), text.split(b"\n")
    counts = Counter(words)
    buckets = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_TERMS for w in counts), np.int64, len(counts))
    np.add.at(out, FORM_TERMS + buckets, np.fromiter(counts.values(), np.float32, len(counts)) / max(1, len(words)))
    out[512] = len(counts) / max(1, len(words))
    out[513] = sum(map(bytes.__eq__, words[1:], words)) / max(1, len(words))
    out[514] = 1 - len(set(lines)) / len(lines)
    return np.sqrt(out)


def held_out_rows() -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sparse(terms: np.ndarray) -> bytes:
    """A term vector as the places and values of what is not zero."""
    at = np.flatnonzero(terms)
    return at.astype("<u2").tobytes() + terms[at].astype("<f4").tobytes()


def dense(packed: bytes) -> np.ndarray:
    out, n = np.zeros(N_TERMS, np.float32), len(packed) // 6
    out[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)
    return out


class Model:
    """The projection and the labelled vectors."""

    def __init__(self, sample: list[bytes], labels: np.ndarray, rank: int) -> None:
        def blocks() -> Iterator[np.ndarray]:  # the sample stays packed, so that the driver holds a block of it at most
            for at in range(0, len(sample), ROWS):
                yield np.array([dense(x) for x in sample[at : at + ROWS]])

        self.labels = labels
        seen = sum(np.count_nonzero(x, axis=0) for x in blocks())
        self.idf = (np.log((1 + len(sample)) / (1 + seen)) + 1).astype(np.float32)
        # leading right singular vectors by subspace iteration
        k = min(rank + 32, len(sample), N_TERMS)
        basis = np.random.default_rng(0).normal(size=(N_TERMS, k)).astype(np.float32)
        for _ in range(8):
            basis = np.linalg.qr(sum(x.T @ (x @ basis) for x in map(self.weighted, blocks())))[0]
        turn = np.linalg.svd(np.concatenate([x @ basis for x in map(self.weighted, blocks())]).astype(np.float64), full_matrices=False)[2]
        self.axes = (basis @ turn[:rank].T).astype(np.float32)
        self.known = np.concatenate([self.project(x) for x in blocks()])

    def weighted(self, terms: np.ndarray) -> np.ndarray:
        x = terms * self.idf
        for kind in (slice(FORM_TERMS), slice(FORM_TERMS, None)):
            part = x[:, kind]
            part /= np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part))[:, None], 1e-12)
        return x

    def project(self, terms: np.ndarray) -> np.ndarray:
        x = (self.weighted(terms) @ self.axes).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray, neighbours: int) -> np.ndarray:
        k = min(neighbours, len(self.labels))
        near = np.round(self.project(terms) @ self.known.T, 6)
        order = np.round(near * 1e6).astype(np.int64) * len(self.labels) - np.arange(len(self.labels))
        nearest = np.argpartition(-order, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, nearest, 1), 0)
        total = weight.sum(1)
        votes = (weight * self.labels[nearest]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, votes, self.labels.mean()), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK) -> Model | None:
    """Learn from labelled rows of ``docs`` that are not held out; None if there are none."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out_rows())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("quality"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sample = known.withColumn("order", order).orderBy("order", "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sparse(terms_of(t.as_py() or b"")) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("quality"), pa.array(terms, pa.binary())], ["order", "quality", "terms"])

    rows = map_batches(texts.select("order", "quality", "text"), run, "order string, quality double, terms binary")
    rows = rows.groupBy("order").agg(F.min("terms").alias("terms"), F.first("quality").alias("quality")).orderBy("order").collect()  # at most max_labelled
    if not rows:
        return None
    return Model([bytes(r.terms) for r in rows], np.array([r.quality for r in rows]), rank)


def scored(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row and column of ``docs`` with ``score`` and ``predicted``; a column of ``docs`` with such a name is replaced."""
    model = fit(docs, labels, max_labelled, rank)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score", "predicted")
    schema = StructType([*rest.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            if known is None or not b.num_rows:
                score = np.ones(b.num_rows)
            else:
                texts = b.column("text").cast(pa.string()).cast(pa.large_binary())
                parts = [texts.slice(at, ROWS) for at in range(0, len(texts), ROWS)]
                score = np.concatenate([known.scores(np.array([terms_of(t.as_py() or b"") for t in part]), neighbours) for part in parts])
            made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "score", "predicted"])

    return map_batches(rest, run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    nested = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(nested, labels).where("predicted = 1").select("row.*")
