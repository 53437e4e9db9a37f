"""Operator 2: removal of repeated passages with suffix automata of reference shards.

A window is 50 consecutive words of one document. A word goes if a window over it also starts in a
document with a smaller doc_id, judged on the input.

Two documents that share a window share its anchor: the least of the window's 10-word hashes, which
depends on the window's words alone. Anchors that occur in one document only are set aside, so text
that nobody repeats is never shuffled. Anchors with the same set of documents make one shard. A
shard holds the runs of words around its anchors; its task walks the runs by doc_id, streams each
through the suffix automaton of the runs of smaller documents for its matching statistics, reports
the maximal spans of 50 or more matched words, and then adds the run to the automaton.

Runs are cut into pieces of at most PIECE_WORDS words that overlap by 49, so every window lies in a
piece and no row grows with its document. A shard of more than SHARD_WORDS words is split: hashes of
its windows show which pieces are the first to hold a repeated window, and only these are its
references, in blocks of about SHARD_WORDS; each reference block is handed to every block of the
pieces to be streamed. So one automaton is bounded, however long the documents are.

Defined cases: null text counts as empty; documents of fewer than 50 words lose nothing; a row with
a null doc_id loses nothing and takes nothing from others; rows that repeat a doc_id are not
smaller than each other; other columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import in_groups, kept, table
from .ngram_join import group_bounds
from .words import BLANKS, Words, binary_runs, grams, ranges, slices

WINDOW, GRAM = 50, 10
SHARD_WORDS = 100_000
PIECE_WORDS = 8_192


def window_anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, anchor) of every window of the texts."""
    counts = np.maximum(np.diff(words.first) - WINDOW + 1, 0)
    at = ranges(words.first[:-1], counts)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    values = grams(words.hash, GRAM)
    best, width = np.arange(len(values)), 1
    span = WINDOW - GRAM + 1

    def pick(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    while width * 2 <= span:
        best = pick(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = pick(best[: len(values) - span + 1], best[span - width : len(values) - width + 1])
    return at, np.repeat(np.arange(len(counts)), counts), values[best[at]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's distinct anchors, with the number of its windows that have each."""
    for batch in batches:
        for piece in slices(batch, "text"):
            _, owner, anchor = window_anchors(Words(piece.column("text"), BLANKS))
            order = np.lexsort((anchor, owner))
            owner, anchor = owner[order], anchor[order]
            if len(owner):
                new = np.ones(len(owner), dtype=bool)
                new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
                n = np.diff(np.append(np.flatnonzero(new), len(new)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(owner[new])) for c in ("doc_id", "text_key")), pa.array(anchor[new].view(np.int64)), pa.array(n)], ["doc_id", "text_key", "anchor", "windows"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of words around a document's shared anchors, a row for each piece of a run and shard."""
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words(piece.column("text"), BLANKS)
            at, owner, anchor = window_anchors(words)
            lists = piece.column("shards")
            flat, where = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            known = flat.field("anchor").to_numpy().view(np.uint64)
            shard_of, parts_of = flat.field("shard").to_numpy(), flat.field("parts").to_numpy()
            bounds = np.searchsorted(owner, np.arange(piece.num_rows + 1))
            rows, shards, parts, starts, ends = [], [], [], [], []
            for r in range(piece.num_rows):
                mine = known[where[r] : where[r + 1]]
                order = np.argsort(mine)
                mine, its, cut = mine[order], shard_of[where[r] : where[r + 1]][order], parts_of[where[r] : where[r + 1]][order]
                own, first = anchor[bounds[r] : bounds[r + 1]], at[bounds[r] : bounds[r + 1]]
                if not len(own) or not len(mine):
                    continue
                spot = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                hit = mine[spot] == own
                shard, part, first = its[spot[hit]], cut[spot[hit]], first[hit]
                if not len(first):
                    continue
                order = np.lexsort((first, shard))
                shard, part, first = shard[order], part[order], first[order]
                new = np.ones(len(first), dtype=bool)
                new[1:] = (shard[1:] != shard[:-1]) | (first[1:] > first[:-1] + WINDOW)
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(first)) - 1
                rows += [r] * len(begin)
                shards += shard[begin].tolist()
                parts += part[begin].tolist()
                starts += first[begin].tolist()
                ends += (first[stop] + WINDOW).tolist()
            if not rows:
                continue
            begin, stop = np.array(starts), np.array(ends)
            step = PIECE_WORDS - WINDOW + 1
            count = np.maximum(1, -(-(stop - begin - WINDOW + 1) // step))
            nth = ranges(np.zeros(len(count), np.int64), count)
            begin, end, rows, shards, parts = np.repeat(begin, count) + nth * step, np.repeat(stop, count), np.repeat(rows, count), np.repeat(shards, count), np.repeat(parts, count)
            stop = np.minimum(begin + PIECE_WORDS, end)
            for at in range(0, len(rows), 64):  # a batch of output rows stays small
                r, a, b = rows[at : at + 64], begin[at : at + 64], stop[at : at + 64]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[at : at + 64], pa.int64()), pa.array(parts[at : at + 64], pa.int32()), piece.column("doc_id").take(take), piece.column("text_key").take(take), pa.array((a - words.first[r]).astype(np.int32)), pa.array((b - a).astype(np.int64)), binary_runs(words.hash[ranges(a, b - a)], np.concatenate([[0], np.cumsum(b - a)]))],
                    ["shard", "parts", "doc_id", "text_key", "start", "n", "words"],
                )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of each piece's windows."""
    for batch in batches:
        shard, doc, start = (batch.column(c).to_numpy() for c in ("shard", "doc_id", "start"))
        for i, raw in enumerate(batch.column("words")):
            hashes = np.unique(grams(np.frombuffer(raw.as_buffer(), np.uint64), WINDOW)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), shard[i])), pa.array(hashes), pa.array(np.full(len(hashes), doc[i])), pa.array(np.full(len(hashes), start[i]))], ["shard", "window", "doc_id", "start"])


class SuffixAutomaton:
    """Of several sequences; each state stands for a class of their subsequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[int]) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = following[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            now = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in following[p]:
                following[p][c] = now
                p = link[p]
            if p != -1:
                q = following[p][c]
                link[now] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = now

    def spans(self, sequence: list[int], least: int) -> tuple[list[tuple[int, int]], bool]:
        """Maximal spans covered by matches of `least` or more; whether the whole sequence matches."""
        following, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = matched = 0
        for i, c in enumerate(sequence):
            to = following[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = following[state].get(c)
            if to is None:
                continue
            state = to
            matched += 1
            if matched >= least:
                begin = i + 1 - matched
                while out and out[-1][1] >= begin:
                    begin = min(begin, out.pop()[0])
                out.append((begin, i + 1))
        return out, bool(sequence) and matched == len(sequence)


def _match(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    shard, block, part, doc, key, start, role = (rows.column(c).to_numpy() for c in ("shard", "block", "part", "doc_id", "text_key", "start", "role"))
    column = rows.column("words").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    values = np.frombuffer(column.buffers()[2], np.uint64)[offsets[0] : offsets[-1]]
    small = np.unique(values, return_inverse=True)[1]
    offsets = offsets - offsets[0]
    found: list[tuple[int, int, int]] = []
    bounds = group_bounds(shard, block, part)
    for a, b in zip(bounds[:-1], bounds[1:]):
        automaton = SuffixAutomaton()
        at = a
        while at < b:
            to = at
            while to < b and doc[to] == doc[at]:
                to += 1
            runs = [small[offsets[r] : offsets[r + 1]].tolist() for r in range(at, to)]
            whole = [False] * len(runs)
            if at > a:
                for k, run in enumerate(runs):
                    spans, whole[k] = automaton.spans(run, WINDOW)
                    if role[at + k] != 1:
                        found += [(at + k, start[at + k] + x, start[at + k] + y) for x, y in spans]
            if to < b:
                for k, run in enumerate(runs):
                    if role[at + k] != 2 and not whole[k]:
                        automaton.add(run)
            at = to
    if found:
        r, x, y = (np.array(v) for v in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(key[r]), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["doc_id", "text_key", "begin", "end"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, begin, end): words [begin, end) that a smaller document holds too.

    docs(doc_id, text_key, text), doc_id not null; spans of different shards may overlap.
    """
    anchors = docs.select("doc_id", "text_key", "text").mapInArrow(_anchors, "doc_id long, text_key long, anchor long, windows long")
    sets = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("all"), F.sum("windows").alias("windows"))
    sets = sets.where("lo < hi").select("anchor", "n", "windows", F.xxhash64("n", "lo", "hi", "all").alias("shard"))
    # a run of windows has 49 words more; each of the shard's documents has a run at least
    sizes = sets.groupBy("shard").agg(F.ceil((F.sum("windows") + (WINDOW - 1) * F.max("n")) / SHARD_WORDS).cast("int").alias("parts"))
    sets = sets.join(sizes, "shard").select("anchor", "shard", "parts")
    # a row gets the anchors of its own text, each once, however many rows have its doc_id
    listed = anchors.join(sets, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("anchor", "shard", "parts")).alias("shards"))
    runs = kept(docs.join(listed, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "shards").mapInArrow(_runs, "shard long, parts int, doc_id long, text_key long, start int, n long, words binary"))
    columns = ["shard", "block", "part", "role", "doc_id", "text_key", "start", "words"]
    plain = runs.where("parts = 1").withColumns({"block": F.lit(0), "part": F.lit(0), "role": F.lit(0)}).select(columns)
    wide = runs.where("parts > 1")
    if not wide.isEmpty():
        windows = wide.select("shard", "doc_id", "start", "words").mapInArrow(_windows, "shard long, window long, doc_id long, start int").groupBy("shard", "window")
        first = windows.agg(F.min(F.struct("doc_id", "start")).alias("lo"), F.max("doc_id").alias("hi")).where("lo.doc_id < hi").select("shard", "lo.*").distinct()
        reference = kept(wide.join(first, ["shard", "doc_id", "start"], "left_semi"))
        blocks = reference.groupBy("shard").agg(F.ceil(F.sum("n") / SHARD_WORDS).cast("int").alias("blocks"))
        holders = reference.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(1)).select(columns)
        streamed = wide.join(blocks, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key", "start"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(2)).select(columns)
        plain = plain.union(holders).union(streamed)
    return in_groups(plain, ["shard", "block", "part"], ["doc_id"], _match, "doc_id long, text_key long, begin int, end int")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words(piece.column("text"), BLANKS)
            count = np.diff(words.first)
            removed = np.zeros(len(count), np.int64)
            spans = piece.column("spans").to_pylist()
            texts = piece.column("text").to_pylist()
            merged: list[list[dict]] = []
            for r, its in enumerate(spans):
                union: list[list[int]] = []
                for x, y in sorted((s["begin"], s["end"]) for s in its or ()):
                    if union and x <= union[-1][1]:
                        union[-1][1] = max(union[-1][1], y)
                    else:
                        union.append([x, y])
                merged.append([{"begin": x, "end": y} for x, y in union])
                if union:
                    removed[r] = sum(y - x for x, y in union)
                    raw, base, f = texts[r].encode(), words.offsets[r], words.first[r]
                    parts, at = [], 0
                    for x, y in [*union, [int(count[r]), int(count[r])]]:
                        if x > at:
                            parts.append(raw[words.start[f + at] - base : words.end[f + x - 1] - base])
                        at = y
                    texts[r] = b" ".join(parts).decode()
            out = piece.drop_columns(["text", "spans"])
            for name, column in (("text", pa.array(texts, pa.string())), ("n_words", pa.array(count.astype(np.int64))), ("n_removed", pa.array(removed)), ("removed", pa.array(merged, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))))):
                out = out.append_column(name, column)
            yield out


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with the repeated words cut from text, and n_words, n_removed, removed.

    A text that loses nothing stays as it is, white space included; the runs of words left of any other are
    joined by one space. removed lists the word spans that went. Names of other columns must not
    be among text_key, spans, n_words, n_removed and removed; those are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in {"text", "text_key", "spans", "n_words", "n_removed", "removed"}]
    keyed = docs.select(*own, F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    subject = keyed.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", "text")
    spans = repeated_spans(subject).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = keyed.join(spans, ["doc_id", "text_key"], "left").select(*own, "text", "spans")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return joined.mapInArrow(_cut, f"{fields}, text string, n_words long, n_removed long, removed array<struct<begin: int, end: int>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS k, array_to_string(ws[i:i + 2], ' ') AS head FROM w, UNNEST(range(1, len(ws) - 48)) AS u(i)),
first_ AS (SELECT k, head, min(doc_id) AS least FROM win GROUP BY ALL),
gone AS (SELECT DISTINCT win.doc_id, j FROM win JOIN first_ USING (k, head), UNNEST(range(i, i + 50)) AS v(j) WHERE least < win.doc_id),
cut AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda x, i: NOT list_contains(js, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)
"""
