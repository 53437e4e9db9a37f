"""Operator 4: byte-level BPE encoding and decoding by batched merge rounds.

A batch's texts are split at the special tokens and by the pre-tokenizer's pattern. Its words that
are not yet known are laid in one flat array of symbols; each round looks up every neighbouring
pair by binary search over the sorted pair keys, takes the lowest rank within each word, and merges
all its occurrences in that word from left to right, until no word has a pair left. Encoded words
are kept in a bounded table for the batches that follow.

Words of more than LONG_WORD bytes (base64, scripts without blanks) would take a round for each rank
that occurs in them. Theirs is a flat array with links to the neighbours, whose pairs are grouped by
rank: a round takes the lowest rank of all these words, merges its pairs, and looks up only the pairs
beside the merged ones, so that it costs what it merges.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; very
long texts and words are encoded whole; other columns of the input pass through.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table
from .words import binary_runs, ranges, slices

#: Words whose ids a task keeps at hand.
KNOWN_WORDS = 200_000
LONG_WORD = 256
SHIFT = np.int64(1 << 20)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Codec:
    """The vocabulary and merges of a tokenizer file, as arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        vocabulary: dict[str, int] = model["vocab"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.byte_ids = np.array([vocabulary[c] for c in characters], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] for a, _ in merges], dtype=np.int64) * SHIFT + np.array([vocabulary[b] for _, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.results = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items() if t not in self.special}
        self.pieces |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(pattern)
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        if self.marks is None or not any(t in text for t in self.special):
            return self.split.findall(text)
        out: list[str] = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self.split.findall(part)
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of ranks for one that is no pair."""
        key = left * SHIFT + right
        spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[spot] == key, self.ranks[spot], len(self.results))

    def merge_long(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of long words, by rounds that each take one rank's pairs in all of them."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(b) for b in raw])
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[np.append(0, ends[:-1])] = n
        gone = np.zeros(n, dtype=bool)
        rank = np.full(n + 1, len(self.results))  # the last stands for no neighbour
        pairs = np.flatnonzero(after < n)
        rank[pairs] = self.pair_ranks(symbols[pairs], symbols[pairs + 1])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(spots: np.ndarray) -> None:
            spots = spots[rank[spots] < len(self.results)]
            spots = spots[np.argsort(rank[spots], kind="stable")]
            own = rank[spots]
            for part in np.split(spots, np.flatnonzero(own[1:] != own[:-1]) + 1) if len(spots) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(pairs)
        while ranks:
            r = heapq.heappop(ranks)
            parts = waiting.pop(r)
            spots = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            spots = spots[rank[spots] == r]
            if not len(spots):
                continue
            # of overlapping occurrences every other one, from the left
            new_run = np.append(True, after[spots[:-1]] != spots[1:])
            nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))
            spots = spots[nth % 2 == 0]
            right = after[spots]
            symbols[spots] = self.results[r]
            gone[right] = True
            rank[right] = len(self.results)
            after[spots] = after[right]
            follow = after[spots]
            inner = follow < n
            before[follow[inner]] = spots[inner]
            touched = np.concatenate([spots, before[spots]])
            touched = np.unique(touched[touched < n])
            rank[touched] = len(self.results)
            touched = touched[after[touched] < n]
            rank[touched] = self.pair_ranks(symbols[touched], symbols[after[touched]])
            wait(touched)
        left = np.cumsum(~gone)[ends - 1]
        symbols = symbols[~gone]
        return [tuple(part.tolist()) for part in np.split(symbols, left[:-1])]

    def merge(self, words: list[str]) -> None:
        """Learn the ids of these words by rounds of merges over all of them at once."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw])
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_owner = [], []
        worst = np.int64(len(self.results))
        while len(symbols):
            n = len(symbols)
            rank = np.full(n, worst)
            if n > 1:
                rank[:-1] = np.where(owner[:-1] == owner[1:], self.pair_ranks(symbols[:-1], symbols[1:]), worst)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, n))
            rest = np.repeat(least < worst, size)
            if not rest.all():
                done_symbols.append(symbols[~rest])
                done_owner.append(owner[~rest])
                symbols, owner, rank = symbols[rest], owner[rest], rank[rest]
                least, size = least[least < worst], size[least < worst]
                if not len(symbols):
                    break
            take = rank == np.repeat(least, size)
            # of overlapping occurrences every other one, from the left
            spots = np.flatnonzero(take)
            new_run = np.append(True, np.diff(spots) > 1)
            nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))
            spots = spots[nth % 2 == 0]
            symbols[spots] = self.results[rank[spots]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[spots + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if done_symbols:
            symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            symbols = symbols[order].tolist()
            bounds = np.searchsorted(owner[order], np.arange(len(raw) + 1)).tolist()
            for i, w in enumerate(words):
                self.known[w] = tuple(symbols[bounds[i] : bounds[i + 1]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        split = [self.words(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        self.known.update({t: (i,) for t, i in self.special.items()})
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.known))
        long = [w for w in new if len(w) * 4 > LONG_WORD and len(w.encode()) > LONG_WORD]
        if len(long) < len(new):
            aside = set(long)
            self.merge([w for w in new if w not in aside])
        self.known.update(zip(long, self.merge_long(long)) if long else ())
        known = self.known
        ids: list[int] = []
        bounds = [0]
        for ws in split:
            for w in ws:
                ids += known[w]
            bounds.append(len(ids))
        for w in long:  # not kept: they are rare and large
            del known[w]
        return np.array(ids, dtype=np.uint32), np.array(bounds)

    @functools.cached_property
    def _flat_pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = max(self.pieces) + 1
        sizes = np.array([len(self.pieces.get(i, b"")) for i in range(top)])
        return np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(top)), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        flat, starts, sizes = self._flat_pieces
        whole = flat[ranges(starts[ids], sizes[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[bounds].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(text, ...) with token_ids (little-endian unsigned 32-bit numbers as binary), n_tokens and decoded."""
    own = [c for c in docs.columns if c.lower() not in {"text", "token_ids", "n_tokens", "decoded"}]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, bounds = tool.encode([t or "" for t in piece.column("text").to_pylist()])
                decoded = tool.decode(ids, bounds)
                columns = [*(piece.column(c) for c in own), piece.column("text"), binary_runs(ids, bounds), pa.array(np.diff(bounds)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*own, "text", "token_ids", "n_tokens", "decoded"])

    return docs.select(*own, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{fields}text string, token_ids binary, n_tokens long, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode(docs, *default_tokenizer()).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
