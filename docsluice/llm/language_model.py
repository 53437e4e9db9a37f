"""Operator 3: masked pseudo-likelihood scores of documents.

A bidirectional window network predicts every word from the word before and the word after it; a
document's score is the sum of the log-probabilities of its words, each given both sides.

Words fall into classes: the commonest words of the corpus each make one, all others go by their
length and a hash of their last letters. The network reads the classes on both sides (embeddings,
one hidden layer) and gives a distribution over the class in the middle; within its class a word
has its smoothed share of the counts in all other documents, so that a text does not vouch for
itself. The counts are a table with a row for each word (by its 64-bit hash), which grows with the
vocabulary; the words of each run of texts, with the texts that hold them, are joined to it. A common
word is alone in its class and needs no row.

Counts cover every word of every document: each task counts the words, and then the triples of
classes, of its own rows, and Spark adds them up. The network is trained in numpy on all triples:
its examples are the (left, right) pairs with the counts of what stands between them. It sees
contexts by class only, and its size does not grow. The score of a pair of sides is then a row of
a small table.

Defined cases: the texts that are scored are those that were learnt from; null counts as empty; a text without words has score 0 and no mean; beginnings and
ends of texts have a class of their own; repeated rows are scored alike, and each counts as another
document to the other; an empty table gives an empty result; other columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import kept, table
from .words import MARKS, Words, binary_runs, mix, slices

#: Slots of the filter that passes over most words that are not common.
BUCKETS = 1 << 16
#: Class 0 is the edge of a text; then the commonest words, then the classes of the others.
COMMON, OTHERS = 63, 64
CLASSES = 1 + COMMON + OTHERS
EMBEDDING, HIDDEN = 24, 48
EPOCHS, BATCH, RATE, SEED = 12, 1024, 4e-3, 11
#: Added to the count of each word of a class, and of one that stands for all unseen words.
SMOOTHING = 0.5
#: Log-shares are multiples of 1 / EXACT: their sums are exact and do not depend on the order of rows.
EXACT = 1 << 30


def classified(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the texts (letters and digits, lower case), and the class that each has if it is not common."""
    words = Words(column, MARKS, lower=True)
    size = np.minimum((words.end - words.start) // 3, 3)
    tail = np.zeros(len(words.hash), np.uint64)
    for j in (1, 2):
        at = np.maximum(words.end - j, words.start)
        tail = tail * np.uint64(257) + (words.bytes[at] if len(at) else np.zeros(0, np.uint8))
    return words, 1 + COMMON + size * (OTHERS // 4) + (mix(tail) % np.uint64(OTHERS // 4)).astype(np.int64)


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


@dataclass
class WordClasses:
    """The common words: slots that hold one (others 0), and their hashes in order; the i-th has class i + 1."""

    common: np.ndarray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def of(self, hashes: np.ndarray, other: np.ndarray) -> np.ndarray:
        kind = other.copy()
        maybe = np.flatnonzero(self.common[slot(hashes)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            kind[maybe[same]] = 1 + at[same]
        return kind


@dataclass
class WindowNetwork:
    """log-probabilities of the middle class for all pairs of sides, and each class's counts with their smoothing."""

    classes: WordClasses
    middle: np.ndarray
    mass: np.ndarray

    def parts(self, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words of the texts, their classes, and the sum of the classes' log-probabilities in each text."""
        words, other = classified(column)
        kind = self.classes.of(words.hash, other)
        left, right = sides(kind, words.first)
        sums = np.concatenate([[0.0], np.cumsum(self.middle[left * CLASSES + right, kind], dtype=np.float64)])
        return words, kind, sums[words.first[1:]] - sums[words.first[:-1]]

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the classes' log-probabilities, words) of each text; shares in the classes come by the join."""
        words, _, sums = self.parts(column)
        return sums, np.diff(words.first)


@dataclass
class LanguageModel(WindowNetwork):
    """The network, and counts(hash, n) of all words that are not common, over the corpus that it learnt from.

    Texts that are scored are part of that corpus: their own counts are taken off.
    """

    counts: DataFrame

    def network(self) -> WindowNetwork:
        return WindowNetwork(self.classes, self.middle, self.mass)


def sides(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and after each word; 0 at the edges of its text."""
    left, right = np.zeros_like(kind), np.zeros_like(kind)
    left[1:], right[:-1] = kind[:-1], kind[1:]
    begins = first[:-1][np.diff(first) > 0]
    left[begins] = 0
    right[first[1:][np.diff(first) > 0] - 1] = 0
    return left, right


def train(counts: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """log p(middle | left, right) from counts[left, right, middle], by mini-batches of (left, right) pairs."""
    rng = np.random.default_rng(SEED)
    flat = counts.reshape(-1, CLASSES).astype(np.float32)
    total = flat.sum(axis=1)
    used = np.flatnonzero(total)
    share = total / max(total.sum(), 1)
    p = {
        "left": rng.standard_normal((CLASSES, EMBEDDING)) * 0.3, "right": rng.standard_normal((CLASSES, EMBEDDING)) * 0.3,
        "w1": rng.standard_normal((2 * EMBEDDING, HIDDEN)) / np.sqrt(2 * EMBEDDING), "b1": np.zeros(HIDDEN),
        "w2": rng.standard_normal((HIDDEN, CLASSES)) / np.sqrt(HIDDEN), "b2": np.log(flat.sum(axis=0) + 1) - np.log(flat.sum() + CLASSES),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0

    def forward(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([p["left"][pairs // CLASSES], p["right"][pairs % CLASSES]], axis=1)
        h = np.tanh(x @ p["w1"] + p["b1"])
        z = h @ p["w2"] + p["b2"]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    for _ in range(epochs if len(used) else 0):
        order = rng.permutation(used)
        for at in range(0, len(order), BATCH):
            pairs = order[at : at + BATCH]
            x, h, logp = forward(pairs)
            weight = share[pairs] / share[pairs].sum()
            target = flat[pairs] / total[pairs, None]
            dz = (np.exp(logp) - target) * weight[:, None]
            dh = dz @ p["w2"].T * (1 - h * h)
            dx = dh @ p["w1"].T
            grad = {"w2": h.T @ dz, "b2": dz.sum(axis=0), "w1": x.T @ dh, "b1": dh.sum(axis=0), "left": np.zeros_like(p["left"]), "right": np.zeros_like(p["right"])}
            np.add.at(grad["left"], pairs // CLASSES, dx[:, :EMBEDDING])
            np.add.at(grad["right"], pairs % CLASSES, dx[:, EMBEDDING:])
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= np.float32(RATE) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return np.concatenate([forward(np.arange(a, min(a + 4096, CLASSES**2)))[2] for a in range(0, CLASSES**2, 4096)]).astype(np.float32)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            words, other = classified(piece.column("text"))
            hashes, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(other[at]), pa.array(n.astype(np.int64))], ["hash", "kind", "n"])


def _count_triples(classes: WordClasses):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int32)
        for batch in batches:
            for piece in slices(batch, "text"):
                words, other = classified(piece.column("text"))
                kind = classes.of(words.hash, other)
                left, right = sides(kind, words.first)
                triple, n = np.unique((left * CLASSES + right) * CLASSES + kind, return_counts=True)
                counts[triple] += n.astype(np.int32)
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["triple", "n"])

    return run


def learn(docs: DataFrame) -> LanguageModel:
    """Counts of words over all of docs(text), and the network trained on all triples of their classes."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    counted = texts.mapInArrow(_count_words, "hash long, kind long, n long").groupBy("hash", "kind")
    vocabulary = kept(counted.agg(F.sum("n").alias("n")))
    top = vocabulary.orderBy(F.desc("n"), "hash").limit(COMMON).collect()
    hashes = np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
    common = np.zeros(BUCKETS, np.int64)
    common[slot(hashes)] = 1
    classes = WordClasses(common, hashes)
    # what is left of each class when the common words have classes of their own
    rare = vocabulary.where(~F.col("hash").isin([r["hash"] for r in top])) if top else vocabulary
    rows = rare.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    mass = np.full(CLASSES, SMOOTHING)
    mass[rows["kind"].to_numpy()] += rows["n"].to_numpy() + SMOOTHING * rows["words"].to_numpy()
    rows = texts.mapInArrow(_count_triples(classes), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    triples = np.zeros(CLASSES**3, np.float32)
    triples[rows["triple"].to_numpy()] = rows["n"].to_numpy()
    return LanguageModel(classes, train(triples.reshape(CLASSES, CLASSES, CLASSES)), mass, rare.select("hash", "n"))


def scored_texts(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs(text, ...) without text, with n_words, log_likelihood and mean_log_likelihood.

    Each text makes one row with its own columns and what the network gives it. Each run of texts
    makes one row for each of its distinct words that is not common, with the texts that hold it and
    how often; these meet the counts, and all rows of a text are added up.
    """
    added = {"n_words", "log_likelihood", "mean_log_likelihood"}
    own = [c for c in docs.columns if c.lower() not in {"text", *added}]
    types = [docs.schema[c].dataType.simpleString() for c in own]
    carried = "".join(f"_own{i} {t}, " for i, t in enumerate(types)) + "_row long, _sum double, _n long"
    names = [*(f"_own{i}" for i in range(len(own))), "_row", "_sum", "_n"]
    shared = docs.sparkSession.sparkContext.broadcast(model.network())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, "text", rows=4_096):
                words, kind, sums = shared.value.parts(piece.column("text"))
                n, base, size = np.diff(words.first), at_row, piece.num_rows
                rows = base + np.arange(size)
                at_row += size
                # the texts' own rows meet no count; they are dealt out by a number of their own
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in own), pa.array(rows), pa.array(sums), pa.array(n), pa.array(mix(rows.astype(np.uint64)).view(np.int64)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], [*names, "_hash", "_kind", "_base", "_held"])
                rest = np.flatnonzero(kind > COMMON)
                if not len(rest):
                    continue
                of = np.repeat(np.arange(size), n)[rest]
                in_class = np.bincount(of * CLASSES + kind[rest], minlength=size * CLASSES)
                order = np.lexsort((of, words.hash[rest]))
                rest, of = rest[order], of[order]
                hashes = words.hash[rest]
                new_word = np.r_[True, hashes[1:] != hashes[:-1]]
                begins = np.flatnonzero(new_word | np.r_[True, of[1:] != of[:-1]])
                times, text = np.diff(np.r_[begins, len(rest)]), of[begins]
                held = np.stack([text, times, in_class[text * CLASSES + kind[rest[begins]]]], axis=1).astype(np.uint32)
                firsts = np.flatnonzero(new_word[begins])
                word, k = begins[firsts], len(firsts)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, piece.column(c).type) for c in own), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()), pa.array(hashes[word].view(np.int64)), pa.array(kind[rest[word]].astype(np.int32)), pa.array(np.full(k, base)), binary_runs(held.reshape(-1), 3 * np.append(firsts, len(held)))], [*names, "_hash", "_kind", "_base", "_held"])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = shared.value.mass
        for batch in batches:
            mine = batch.column("_row").is_valid()
            texts, met = batch.filter(mine).select(names), batch.filter(pc.invert(mine))
            if texts.num_rows:
                yield texts.append_column("_share", pa.nulls(texts.num_rows, pa.float64()))
            if not met.num_rows:
                continue
            column = met.column("_held")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            held = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, 3).astype(np.int64)
            size = np.diff(offsets) // 12
            n = np.repeat(pc.fill_null(met.column("n"), 0).to_numpy(), size)
            # the text's own words are taken off both counts; a word that no other text holds has the share of an unseen one
            share = np.log((np.maximum(n - held[:, 1], 0) + SMOOTHING) / np.maximum(np.repeat(mass[met.column("_kind").to_numpy()], size) - held[:, 2], SMOOTHING))
            rows, place = np.unique(np.repeat(met.column("_base").to_numpy(), size) + held[:, 0], return_inverse=True)
            total = np.bincount(place, held[:, 1] * np.round(share * EXACT) / EXACT)
            k = len(rows)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, texts.column(c).type) for c in names[: len(own)]), pa.array(rows), pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()), pa.array(total)], [*names, "_share"])

    words = docs.select(*own, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{carried}, _hash long, _kind int, _base long, _held binary")
    met = words.join(model.counts, F.col("_hash") == F.col("hash"), "left").drop("hash", "_hash").mapInArrow(shares, f"{carried}, _share double")
    mine = [F.first(f"_own{i}", ignorenulls=True).alias(f"_own{i}") for i in range(len(own))]
    of_text = met.groupBy("_row").agg(*mine, F.max("_n").alias("n_words"), (F.sum("_sum") + F.coalesce(F.sum("_share"), F.lit(0.0))).alias("log_likelihood"))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return of_text.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(own)), "n_words", "log_likelihood", mean.alias("mean_log_likelihood"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored_texts(docs, learn(docs))
