"""Operator 9: quality by nearest-neighbour voting over latent-semantic vectors.

A text is described by counts of hashed features: its words (lower case), n-grams of its character
classes with runs collapsed (how words, marks, capitals and lines follow each other) and steps of a
few whole-text measures (length, share of distinct words, of the commonest word, of repeated lines,
of letters).
Weighted by log count and inverse document frequency, projected on the leading singular vectors of
the labelled sample and normalised, these are its latent-semantic vector. The labelled vectors are
broadcast; every document's cosines with all of them are computed in blocks, and the labels of the
NEIGHBOURS nearest vote with weights that grow with the cosine.

Labels come only from the training folds: at most LABELLED rows, picked by a hash of doc_id; these,
their vectors and the projection are all that is broadcast.

Defined cases: null counts as empty; an empty text has its own features and is scored like any other;
rows that repeat a doc_id are scored alike; without usable labels every score is 0.5; other columns
of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .toxicity import held_out, training_rows
from .words import BLANKS, MARKS, Words, mix, slices

#: NEIGHBOURS, LATENT and SHARPNESS are among those of the fewest errors in cross-validation over the training folds of sf0.01 and sf0.1.
LABELLED, NEIGHBOURS, CUT = 4_000, 25, 0.3
#: Features of form, and of words.
FORM, WORDS = 2_048, 2_048
FEATURES, LATENT, SHARPNESS = FORM + WORDS, 64, 16
#: Texts whose counts are held at once.
ROWS = 512
#: Character classes: letters, capitals, digits, blank, line end; every other ASCII character is its own.
CLASSES = np.arange(256, dtype=np.uint64)
for _b in range(256):
    _c = chr(_b)
    CLASSES[_b] = 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c in "\r\n" else 4 if _c.isspace() else _b


def _count(owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner * FEATURES + feature, minlength=n * FEATURES).reshape(n, FEATURES)


def _repeats(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the commonest) of each text."""
    distinct, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(keys):
        order = np.lexsort((keys, owner))
        o, k = owner[order], keys[order]
        new = np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(k)))
        np.add.at(distinct, o[first], 1)
        np.maximum.at(most, o[first], size)
    return distinct, most


def counted_features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES counts for each text."""
    words = Words(column, BLANKS)
    n = len(words.offsets) - 1
    out = np.zeros((n, FEATURES), dtype=np.int64)
    sizes = np.diff(words.offsets)
    owner = np.repeat(np.arange(n), sizes)
    kind = CLASSES[words.bytes]
    if len(kind):
        new = np.append(True, (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1]))
        kind, owner_k = kind[new], owner[new]
        for k in (2, 3, 4):
            if len(kind) >= k:
                key = np.full(len(kind) - k + 1, np.uint64(k))
                for j in range(k):
                    key = key * np.uint64(257) + kind[j : len(kind) - k + 1 + j]
                inside = owner_k[: len(key)] == owner_k[k - 1 :]
                out += _count(owner_k[: len(key)][inside], (mix(key[inside]) % np.uint64(FORM)).astype(np.int64), n)
    count = np.diff(words.first)
    distinct, most = _repeats(np.repeat(np.arange(n), count), words.hash, n)
    lines = np.zeros(n)
    ends = np.flatnonzero(words.bytes == 10)
    np.add.at(lines, owner[ends], 1)
    letters = np.zeros(n)
    np.add.at(letters, owner, (CLASSES[words.bytes] <= 2).astype(float))
    capitals = np.zeros(n)
    np.add.at(capitals, owner, (CLASSES[words.bytes] == 2).astype(float))
    some = np.maximum(count, 1)
    measures = [
        np.minimum(np.log2(count + 1), 15), 10 * distinct / some, 20 * most / some, np.minimum(10 * distinct / np.sqrt(some) / 3, 15), 12 * letters / np.maximum(sizes, 1),
        20 * capitals / np.maximum(sizes, 1), np.minimum(sizes / some, 20), np.minimum(np.log2(lines + 1) * 2, 20), np.minimum(40 * lines / some, 20),
    ]
    for i, m in enumerate(measures):  # a measure's step and both neighbours, so that near values share features
        for d, weight in ((-1, 2), (0, 6), (1, 2)):
            key = mix(np.full(n, np.uint64(10_000 + 1000 * i)) + (np.floor(m).astype(np.int64) + d + 2).astype(np.uint64))
            out[np.arange(n), (key % np.uint64(FORM)).astype(np.int64)] += weight
    plain = Words(column, MARKS, lower=True)
    if len(plain.hash):
        out += _count(np.repeat(np.arange(n), np.diff(plain.first)), FORM + (plain.hash % np.uint64(WORDS)).astype(np.int64), n)
    return out


@dataclass
class Neighbours:
    """Labelled latent-semantic vectors and what turns counts into such vectors."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        z, out = self.latent(counts), np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(z), block):
            cosine = z[at : at + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS + 1e-9
            out[at : at + block] = (vote * self.labels[near]).sum(axis=1) / vote.sum(axis=1)
        return out


def fit(counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> Neighbours:
    """The leading singular vectors of the labelled sample by random projection and power steps."""
    if not len(labels):
        return Neighbours(np.ones(FEATURES, np.float32), np.zeros((FEATURES, LATENT), np.float32), np.zeros((0, LATENT), np.float32), labels.astype(float))
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = np.log1p(counts).astype(np.float32) * weight
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    q = np.random.default_rng(seed).standard_normal((FEATURES, LATENT + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model = Neighbours(weight, np.ascontiguousarray((q @ v[:LATENT].T).astype(np.float32)), np.zeros((0, LATENT), np.float32), labels.astype(float))
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", rows=ROWS):
            counts = counted_features(piece.column("text")).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array([c.tobytes() for c in counts], pa.binary())], ["doc_id", "y", "counts"])


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, label: str = "quality") -> Neighbours:
    """Neighbours from at most `most` labelled rows of the training folds."""
    rows = training_rows(docs, labels, label, most).select("doc_id", "y", "text").mapInArrow(_labelled, "doc_id long, y int, counts binary").toArrow()
    rows = rows.sort_by("doc_id")
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint32).reshape(-1, FEATURES)
    return fit(counts, rows["y"].to_numpy())


def scored_texts(docs: DataFrame, model: Neighbours) -> DataFrame:
    """docs(text, ...) without text, with score."""
    own = [c for c in docs.columns if c.lower() not in {"text", "score"}]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", rows=ROWS):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in own), pa.array(shared.value.score(counted_features(piece.column("text"))))], [*own, "score"])

    return docs.select(*own, F.col("text").cast("string").alias("text")).mapInArrow(run, fields + "score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = scored_texts(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
