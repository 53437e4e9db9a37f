"""Operator 11: ranked lexical search over inverted treaps.

Documents are read once; what is written is their length and, for the terms of the queries, their
occurrences. Runs of documents are shards. In a shard every term has a treap: postings in order of
doc_id, and a heap of impacts, so that a node's impact is the largest of all that stands below it. A
query descends the treaps of all its terms together. A range of documents has one node for each
term, the largest of that term's postings in the range; the sum of their impacts bounds the score of
every document there. Ranges that cannot enter the top are left out; an open one is split at the
document of its weightiest node, which gets its exact score from the nodes that hold it. Best bounds
come first; a first search of some documents gives each query a floor, and a task raises it from
shard to shard. The tops of all shards are by a window that Spark cuts to the top
within each task first.

The queries (a given table, each against all documents) are dealt with in blocks of bounded size;
only a block's terms and weights are sent to the tasks. Whole documents are counted: N, L and df
come from all of them. A hot term is in every shard, so its postings never meet in one place.

Defined cases: a null text has no terms; a document without terms is not counted in N and never
found; a query without terms (or with only unknown ones) finds nothing; queries that repeat an
item_id are answered each, with the same item_id; documents that repeat a doc_id are ranked each;
those without doc_id come last among equal scores; empty tables give an empty result; further
columns are ignored. Sums are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import kept, table
from .words import ranges, slices

TOP = 10
#: Bytes of query texts in a block.
BLOCK_BYTES = 4_000_000
#: Postings of a shard; terms of queries that are answered together; ranges that a query looks at in a round, at first and at most.
SHARD, TOGETHER, FIRST, FRONT = 2_000_000, 1_000, 32, 16_384
#: One of so many documents is searched first; the last of its top is a floor for all.
PROBE = 16
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Every other ASCII character parts terms; A to Z become a to z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """Occurrences of every term of a UTF-8 text of any length."""
    if len(text) <= PIECE:
        return Counter(text.translate(FOLD).split())
    out: Counter = Counter()
    at, held = 0, b""
    while at < len(text):  # the last term of a piece may go on in the next
        piece = held + text[at : at + PIECE].translate(FOLD)
        at += PIECE
        cut = len(piece) if at >= len(text) else piece.rfind(b" ") + 1
        out.update(piece[:cut].split())
        held = piece[cut:]
    return out


def counted(vocabulary: list[bytes]):
    """doc_id, n (terms with repeats), and number and occurrences of those terms that queries hold."""
    numbers = {t: i for i, t in enumerate(vocabulary)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                lengths, ends, terms, often = [], [0], [], []
                for text in piece.column("text").cast(pa.large_binary()):
                    found = terms_of(text.as_py() or b"")
                    lengths.append(sum(found.values()))
                    for t in found.keys() & numbers.keys():
                        terms.append(numbers[t])
                        often.append(found[t])
                    ends.append(len(terms))
                of_each = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lengths, pa.int64()), of_each(terms, pa.int32()), of_each(often, pa.int64())], ["doc_id", "n", "terms", "often"])

    return work


def impacts(often: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What one occurrence of the term in a query adds, before the term's weight."""
    m = 100 - 75 + (75 * n * docs) // length
    return (1_000_000_000 * often) // (1000 * often + 8 * m)


def nearest_greater(values: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest greater one to its left and right in its list, -1 and len where there is none.

    Of equal values the left one counts as greater. Places are skipped along those already known, so
    rounds are about the logarithm of the longest distance.
    """
    n = len(values)
    out = []
    for step in (-1, 1):
        at = np.arange(n) + step
        open_ = np.arange(n)
        while len(open_):
            to = at[open_]
            inside = (to >= 0) & (to < n)
            open_, to = open_[inside], to[inside]
            less = (values[to] < values[open_]) if step < 0 else (values[to] <= values[open_])
            less &= lists[to] == lists[open_]
            open_, to = open_[less], to[less]
            at[open_] = at[to]
        out.append(at)
    left, right = out
    left[(left >= 0) & (lists[np.maximum(left, 0)] != lists)] = -1
    right[(right < n) & (lists[np.minimum(right, n - 1)] != lists)] = n
    return left, right


class Treaps:
    """One treap for each term: nodes are postings in order of (term, document); root, left and right by heap of impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((doc, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        n = len(term)
        before, after = nearest_greater(self.impact, term)
        worth = lambda at: np.where((at >= 0) & (at < n), self.impact[np.clip(at, 0, max(n - 1, 0))], -1)
        # the parent is the lesser of both; of equal ones the right one is
        parent = np.where((before >= 0) & ((after >= n) | (worth(before) < worth(after))), before, np.where(after < n, after, -1))
        node = np.arange(n)
        lower, upper, top = (parent >= 0) & (node < parent), (parent >= 0) & (node > parent), parent < 0
        #: document, left and right child
        self.nodes = np.full((n, 3), -1, np.int32)
        self.nodes[:, 0] = self.doc
        self.nodes[parent[lower], 1] = node[lower]
        self.nodes[parent[upper], 2] = node[upper]
        self.root = np.full(terms, -1)
        self.root[term[top]] = node[top]

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each node down to the weightiest one below it whose document is in low:high, -1 if there is none."""
        node = node.copy()
        todo = np.flatnonzero(node >= 0)
        low, high, at = low[todo], high[todo], node[todo]
        while len(todo):
            row = self.nodes.take(at, axis=0)
            under = row[:, 0] < low
            out = under | (row[:, 0] >= high)
            todo, row, under = todo[out], row[out], under[out]
            at = np.where(under, row[:, 2], row[:, 1])
            node[todo] = at
            on = at >= 0
            todo, at, low, high = todo[on], at[on], low[out][on], high[out][on]
        return node

    def split(self, node: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For nodes whose documents are in low:high, the nodes of low:cut, of cut, and of what follows it."""
        row = self.nodes.take(node, axis=0)
        before, after = row[:, 0] < cut, row[:, 0] > cut
        left, here, right = np.where(before, node, -1), np.where(before | after, -1, node), np.where(after, node, -1)
        side = np.flatnonzero(~before)
        left[side] = self.within(row[side, 1], low[side], cut[side])
        side = np.flatnonzero(~after)
        right[side] = self.within(row[side, 2], cut[side] + 1, high[side])
        side = np.flatnonzero(before | after)
        here[side] = self.within(np.where(before[side], row[side, 2], row[side, 1]), cut[side], cut[side] + 1)
        return left, here, right

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of each query's k best with a score of its floor at least, best first; of equal scores the smaller documents.

        A query is its terms and their weights; several are answered together. The open ranges are
        low:high, with a bound; first points to their nodes, one for each term that occurs in the
        range, and to what these add at most.
        """
        terms, weight = (np.concatenate(x) for x in zip(*queries))
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        node = self.root[terms]
        there = node >= 0
        node, weight, of = node[there], weight[there], of[there]
        worth = weight * self.impact[node]
        query, first = np.unique(of, return_index=True)
        first = np.append(first, len(of))
        low, high = np.zeros(len(query), np.int64), np.full(len(query), docs)
        bound = np.add.reduceat(worth, first[:-1]) if len(query) else low
        last, take, floor = np.full(len(queries), -1), FIRST, floor.copy()
        best_of, best_doc, best = (np.zeros(0, np.int64) for _ in range(3))
        while len(low):
            # where a top is full, an equal score enters only before the last of it
            now = np.flatnonzero((bound >= floor[query]) & ((last[query] < 0) | (bound > floor[query]) | (low < last[query])))
            if not len(now):
                break
            take, rest = min(2 * take, FRONT), now[:0]
            if len(now) > take:  # each query's best bounds first, until its floor is high
                order = now[np.lexsort((-bound[now], query[now]))]
                chosen = in_group(query[order]) < take
                now, rest = np.sort(order[chosen]), np.sort(order[~chosen])
            size = np.diff(first)
            own, others = ranges(first[now], size[now]), ranges(first[rest], size[rest])
            at_node, at_weight, at_worth = node[own], weight[own], worth[own]
            edge = np.cumsum(size[now]) - size[now]
            owner = np.repeat(np.arange(len(now)), size[now])
            heaviest = np.maximum.reduceat(at_worth, edge)
            split = np.maximum.reduceat(np.where(at_worth == heaviest[owner], self.doc[at_node], -1), edge)
            left, here, right = self.split(at_node, split[owner], low[now][owner], high[now][owner])
            score = np.add.reduceat(np.where(here >= 0, at_weight * self.impact[here], 0), edge)
            good = score >= floor[query[now]]
            if good.any():
                best_of, best_doc, best = np.concatenate([best_of, query[now][good]]), np.concatenate([best_doc, split[good]]), np.concatenate([best, score[good]])
                order = np.lexsort((best_doc, -best, best_of))
                order = order[in_group(best_of[order]) < k]
                best_of, best_doc, best = best_of[order], best_doc[order], best[order]
                full = in_group(best_of) == k - 1
                floor[best_of[full]], last[best_of[full]] = np.maximum(floor[best_of[full]], best[full]), best_doc[full]
            a, b = left >= 0, right >= 0
            new_node, new_weight = np.concatenate([left[a], right[b]]), np.concatenate([at_weight[a], at_weight[b]])
            new_worth = new_weight * self.impact[new_node]
            new_size = np.concatenate([np.bincount(owner[a], minlength=len(now)), np.bincount(owner[b], minlength=len(now))])
            sums = np.concatenate([[0], np.cumsum(new_worth)])
            ends = np.cumsum(new_size)
            new_bound, new_query = sums[ends] - sums[ends - new_size], np.tile(query[now], 2)
            new_low, new_high = np.concatenate([low[now], split + 1]), np.concatenate([split, high[now]])
            open_ = (new_size > 0) & (new_bound >= floor[new_query])
            inside = np.repeat(open_, new_size)
            node, weight, worth = (np.concatenate([x[others], y[inside]]) for x, y in ((node, new_node), (weight, new_weight), (worth, new_worth)))
            low, high, bound, query = (np.concatenate([x[rest], y[open_]]) for x, y in ((low, new_low), (high, new_high), (bound, new_bound), (query, new_query)))
            first = np.concatenate([[0], np.cumsum(np.concatenate([size[rest], new_size[open_]]))])
        return best_of, best_doc, best


def in_group(groups: np.ndarray) -> np.ndarray:
    """The place of each value among its equal neighbours, from 0."""
    n = len(groups)
    new = np.ones(n, bool)
    new[1:] = groups[1:] != groups[:-1]
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def searched(queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int, known: dict[int, int]):
    """The k best documents of each shard for each query (number, terms, repeats); known: scores that k documents reach."""
    own = [(number, terms, weights[terms] * repeats) for number, terms, repeats in queries]
    numbers = np.array([number for number, _, _ in own], np.int64)
    at = np.cumsum([len(terms) for _, terms, _ in own]) // TOGETHER
    groups = [np.flatnonzero(at == x) for x in np.unique(at)]

    def search(rows: pa.Table, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, n = rows.column("doc_id"), rows.column("n").to_numpy()
        order = np.lexsort((np.arange(len(n)), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.int8)))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        lists = rows.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        counts = lists.value_lengths().to_numpy()
        term = lists.flatten().to_numpy().astype(np.int64)
        often = rows.column("often").combine_chunks()
        often = (often.chunk(0) if isinstance(often, pa.ChunkedArray) else often).flatten().to_numpy()
        owner = np.repeat(np.arange(len(n)), counts)
        treaps = Treaps(term, place[owner], impacts(often, n[owner], docs, length), len(weights))
        for some in groups:
            query, doc, score = treaps.tops([own[i][1:] for i in some], len(n), k, floors[some])
            yield pa.RecordBatch.from_arrays([pa.array(numbers[some[query]]), ids.take(pa.array(order[doc])).combine_chunks().cast(pa.int64()), pa.array(score)], ["query", "doc_id", "score"])
            full = in_group(query) == k - 1
            floors[some[query[full]]] = np.maximum(floors[some[query[full]]], score[full])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        floors = np.array([known.get(number, 1) for number, _, _ in own], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= SHARD:
                yield from search(pa.Table.from_batches(waiting), floors)
                waiting, size = [], 0
        if waiting:
            yield from search(pa.Table.from_batches(waiting), floors)

    return work


def blocks_of(items: DataFrame, text: str) -> Iterator[list[tuple]]:
    """(number, text) of the queries in blocks of about BLOCK_BYTES, read one block at a time."""
    rows = ((r["number"], (r[text] or "").encode()) for r in items.select("number", text).toLocalIterator(prefetchPartitions=False))
    while block := list(islice(rows, 1)):
        size = len(block[0][1])
        while size < BLOCK_BYTES and (more := list(islice(rows, 1))):
            block += more
            size += len(more[0][1])
        yield block


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items(item_id, text) the k documents of docs(doc_id, text) that score highest."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = kept(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number")))
    found = None
    for block in blocks_of(items, "text"):
        queries = [(number, terms_of(text)) for number, text in block]
        vocabulary = sorted({t for _, terms in queries for t in terms})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        rows = kept(texts.mapInArrow(counted(vocabulary), "doc_id long, n long, terms array<int>, often array<long>"))
        total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
        if not total["docs"]:
            continue
        weights = np.full(len(vocabulary), 0, np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # as many as the block has terms
            weights[r["t"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["count"] + 1)))
        plain = [(number, np.array([numbers[t] for t in terms], np.int64), np.array(list(terms.values()), np.int64)) for number, terms in queries]
        full = rows.where("size(terms) > 0")
        search = lambda some, floors: some.mapInArrow(searched(plain, weights, total["docs"], total["length"], k, floors), "query long, doc_id long, score long")
        some = search(full.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(PROBE)) == 0), {})
        floors = {r["query"]: r["score"] for r in best_of(some, k).where(F.col("rank") == k).toLocalIterator()}  # one number for each of the block's queries
        tops = search(full, floors)
        found = tops if found is None else found.union(tops)
    if found is None:
        return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return best_of(found, k).join(items.select("item_id", F.col("number").alias("query")), "query").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms} AS ts FROM documents),
q AS (SELECT row_number() OVER () AS b, item_id, {_terms} AS ts FROM benchmark),
wanted AS (SELECT b, item_id, t, count(*) AS reps FROM (SELECT b, item_id, unnest(ts) AS t FROM q) GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) SEMI JOIN wanted USING (t) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
hit AS (SELECT b, item_id, r, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM tf JOIN w USING (t) JOIN wanted USING (t), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rk FROM hit WHERE score > 0)
SELECT item_id, rk::INTEGER AS rank, doc_id, score FROM ranked WHERE rk <= 10
"""
