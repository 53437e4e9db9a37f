"""Operator 10: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded (lower case, look-alike letters, digits and signs that stand for letters, invisible
characters dropped) and cut into words. Lexicon entries are beginnings of words with weights. One
pass of the automaton finds all entries and exception phrases; a word counts by its heaviest entry,
unless it lies in an exception phrase. The sum is normalised by the text's length and a logistic
curve turns it into a score.

The lexicon's weights and the curve are learnt from labelled rows of the training folds: at most
LABELLED of them, picked by a hash of doc_id. An entry needs a significant likelihood ratio; its
weight is the log ratio of its rates among toxic and other words less its standard error; the curve
is fitted on labelled rows that the lexicon has not seen. A small base lexicon stands where labels
say nothing.

Defined cases: null counts as empty; an empty text has the curve's value at zero; rows that repeat a
doc_id are scored alike, and teach as one of them; a doc_id with both labels teaches nothing; without usable labels the base
lexicon and a fixed curve are used; other columns of the input pass through, but for those that are
named as one of the added.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .words import slices

#: Labelled rows that are used at most, and toxic texts that an entry needs.
LABELLED, SUPPORT = 12_000, 3
LEAST_WEIGHT, CUT = 1.0, 0.5
#: The log-likelihood ratio that an entry needs (6.6: one in a hundred by chance). This, LEAST_WEIGHT and SUPPORT
#: have the fewest errors of 48 settings in cross-validation over the four training folds of sf0.01 and sf0.1.
EVIDENCE = 6.6
PREFIXES = range(3, 9)
BASE = {w: 4.0 for w in ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "dumbass", "asshole", "bastard", "bitch", "retard")}
EXCEPTIONS = ("worthless currency", "stupid question i know", "sore loser rule", "pathetic fallacy", "trash can", "trash bin", "trash collection", "clown fish", "pond scum")
#: Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвнαοερτυικνѵɡ", "aeopcyxijsdhlkmtbhaoeptuiknvg", strict=True))
DIGITS = dict(zip("013457", "oieast", strict=True))
SIGNS = dict(zip("@$!", "asi", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = str.maketrans({**LOOKALIKES, **{k: None for k in INVISIBLE}, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_DIGITS = str.maketrans(DIGITS)
_SIGN = re.compile(r"[@$!](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str) -> list[str]:
    """The words of the folded text; digits stand for letters only in words that have letters."""
    text = text.lower().translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    words = _WORD.findall(text)
    return [w if w.isalpha() or w.isdigit() else w.translate(_DIGITS) for w in words]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.0, 0.5)
    _automaton: ahocorasick.Automaton = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                a.add_word(" " + entry, (len(entry), weight))
            for phrase in self.exceptions:
                words = " ".join(folded_words(phrase))
                a.add_word(f" {words} ", (-len(words) - 2, 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str) -> tuple[float, int, int]:
        """(weight of all hits, hits, words)."""
        words = folded_words(text)
        if not words or not len(self.automaton):
            return 0.0, 0, len(words)
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(line):
            if size < 0:
                excused.append((end + size + 1, end))
            else:
                start = end - size
                if weight > best.get(start, 0.0):
                    best[start] = weight
        begins, ends = merged(excused)
        hits = [w for start, w in best.items() if not begins or not (k := bisect_right(begins, start)) or start >= ends[k - 1]]
        return float(sum(hits)), len(hits), len(words)

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + features(weight, words) @ np.array([b, c]), -30, 30)))


def merged(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the ranges' union, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted(ranges):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weight a hundred words (a text of under 20 words counts as 20), and the weight itself, both on a log scale."""
    rate = 100 * weight / np.maximum(words, 20)
    return np.stack([np.log1p(rate), np.log1p(weight)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge and weights that are not negative."""
    design = np.column_stack([np.ones(len(x)), x])
    free = [0, 1, 2]
    beta = np.zeros(3)
    while True:
        d, b = design[:, free], np.zeros(len(free))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
            gradient = d.T @ (y - p) - 1e-2 * b
            hessian = (d * (p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(len(free))
            step = np.linalg.solve(hessian, gradient)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
        beta[:] = 0
        beta[free] = b
        bad = [i for i in free if i and beta[i] < 0]
        if not bad:
            return tuple(float(v) for v in beta)
        free = [i for i in free if i not in bad]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y, pick) of at most about `most` labelled documents outside the held-out fold; pick is uniform in [0, 1000).

    Of the rows that repeat a doc_id one is taken, of the least text, so the bound holds for rows too.
    """
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(label)), F.lit(1_000_000))
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_high")).where("y = _high").drop("_high")
    n = usable.count()
    chosen = usable.where(pick < 1_000_000 * most / max(n, most)).withColumn("pick", F.pmod(pick, F.lit(1000)))
    # about `most` rows of three numbers
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y", "pick").agg(F.min("text").alias("text")).select("doc_id", "text", "y", "pick")


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n: float, m: float) -> np.ndarray:
    """Twice the log-likelihood ratio that a of n and b of m texts have different rates; 0 where a's is not the greater."""
    rate = (a + b) / (n + m)

    def part(k: np.ndarray, total: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (total * rate)), 0) + np.where(k < total, (total - k) * np.log((total - k) / (total * np.maximum(1 - rate, 1e-12))), 0)

    return np.where(a / n > b / m, 2 * (part(a, n) + part(b, m)), 0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each beginning of a word occurs in texts of either label, and in how many of them."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            own: Counter[str] = Counter()
            words = Counter(folded_words(text))
            for w, n in words.items():
                for k in PREFIXES:
                    if len(w) < k:
                        break
                    own[w[:k]] += n
            own[""] = words.total()
            for f, n in own.items():
                row = seen.setdefault(f, [0, 0, 0, 0])
                row[y] += n
                row[2 + y] += 1
    if seen:
        counts = np.array(list(seen.values()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array(counts[:, i]) for i in range(4))], ["entry", "other", "toxic", "other_texts", "toxic_texts"])


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, label: str = "toxic") -> Lexicon:
    """A lexicon and its curve from the labelled rows of the training folds."""
    rows = training_rows(docs, labels, label, most)
    counts = rows.where("pick < 667").mapInArrow(_counts, "entry string, other long, toxic long, other_texts long, toxic_texts long").groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("other", "toxic", "other_texts", "toxic_texts")))
    counts = counts.where(f"entry = '' or (toxic_texts >= {SUPPORT} and toxic > other / 20)").toPandas()
    totals = counts[counts.entry == ""]
    weights: dict[str, float] = {}
    if len(totals) and totals.toxic.iloc[0] > 0 and totals.other.iloc[0] > 0:
        own = counts[counts.entry != ""]
        t, o = own.toxic.to_numpy(float), own.other.to_numpy(float)
        ratio = np.log((t + 0.5) / totals.toxic.iloc[0]) - np.log((o + 0.5) / totals.other.iloc[0])
        texts_t, texts_o = own.toxic_texts.to_numpy(float), own.other_texts.to_numpy(float)
        bound = ratio - np.sqrt(1 / (texts_t + 0.5) + 1 / (texts_o + 0.5))
        bound[likelihood_ratio(texts_t, texts_o, float(totals.toxic_texts.iloc[0]), float(totals.other_texts.iloc[0])) < EVIDENCE] = 0
        order = sorted(((len(e), e, b) for e, b in zip(own.entry, bound) if b >= LEAST_WEIGHT), key=lambda x: x[:2])
        for _, e, b in order:  # a longer entry is kept where it says more than its own beginnings
            if all(b > weights[e[:k]] + 0.5 for k in PREFIXES if e[:k] in weights):
                weights[e] = float(b)
    lexicon = Lexicon({**BASE, **weights})
    measured = measured_texts(rows.where("pick >= 667").select("y", "text"), lexicon).select("y", "weight", "words").toPandas()
    if len(measured) >= 50 and 0 < measured.y.sum() < len(measured):
        lexicon.curve = fit_curve(features(measured.weight.to_numpy(), measured.words.to_numpy()), measured.y.to_numpy(float))
    return lexicon


def measured_texts(docs: DataFrame, lexicon: Lexicon, keep_text: bool = False) -> DataFrame:
    """docs(text, ...) with score, weight, hits and words, and without text unless it is to be kept."""
    added = {"score": "double", "weight": "double", "hits": "long", "words": "long"}
    own = [c for c in docs.columns if c.lower() not in {"text", *added}]
    kept = [*own, "text"] if keep_text else own
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own) + ("text string, " if keep_text else "") + ", ".join(f"{k} {v}" for k, v in added.items())
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = [lex.measure(t or "") for t in piece.column("text").to_pylist()]
                weight, hits, words = (np.array(c) for c in zip(*rows))
                score = lex.score(weight, words)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(score), pa.array(weight), pa.array(hits, pa.int64()), pa.array(words, pa.int64())], [*kept, *added])

    return docs.select(*own, F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return measured_texts(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "hits", "words")
