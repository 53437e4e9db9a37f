"""Operator 1: n-gram Jaccard join with Bayesian pruning of MinHash candidates.

Texts whose words (letters and digits, lower case) are equal form one class and are compared once.
Representatives that share a band of MinHash values are candidates. Their values are compared a
few at a time; a pair is dropped as soon as the posterior probability that its similarity reaches
the threshold (uniform prior, one Bernoulli trial a value) falls below the tolerance. What survives
is verified exactly on the whole shingle sets.

Groups of any size are cut into blocks of bounded size and compared block against block; blocks
whose sizes of sets are too far apart for the threshold are not. A block pair returns one row a text
(its number of links and a spanning link), never its list of pairs. A text is cut into shingles once;
what is copied for the block pairs is its set.

Defined cases: a text without words (null, empty, only marks) has no shingles, forms a class of its
own and has no links; a text of fewer words than a shingle has one shingle of all its words; rows
that repeat a doc_id are rows like any others, with equal or different texts; a null doc_id is kept,
has its links like any other row, and never names a class unless the whole class has none; an empty
table gives an empty result; further columns of the input are ignored, or kept by one_of_each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import connected, in_groups, kept, table
from .words import MARKS, Words, binary, binary_runs, grams, mix, ranges, slices, text_keys

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: A pair of similarity 0.8 shares none of 25 bands of 5 values with probability 5e-5.
BANDS, ROWS, VALUES = 25, 5, 128
STEP = 16
#: Texts of a block in the comparison of MinHash values, and in the exact one.
ROUGH_BLOCK, EXACT_BLOCK, EXACT_SHINGLES = 512, 512, 400_000
#: What tells rows apart without their texts: no doc_id, doc_id (0 for none), hash of the text.
ROW = ["no_id", "row_id", "text_hash"]

_numbers = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
FLIPS, FACTORS = _numbers[:VALUES].astype(np.uint32), _numbers[VALUES:].astype(np.uint32) | np.uint32(1)
BAND_SALT = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """The least number of equal values among n that leaves P(similarity >= threshold) at the tolerance."""
    below = 0.0
    for m in range(n + 1):  # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m) under a uniform prior
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, one text after the other, and the bounds of each text."""
    counts = np.diff(words.first)
    runs = np.maximum(counts - k + 1, 0)
    all_grams = grams(words.hash, k)
    owner = np.repeat(np.arange(len(counts)), runs)
    values = all_grams[ranges(words.first[:-1], runs)] if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        values = np.concatenate([values, text_keys(words)[short]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def minhash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """VALUES minima of every set (a row of 0xFFFFFFFF for an empty one)."""
    out = np.full((len(bounds) - 1, VALUES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        small = (values >> np.uint64(32)).astype(np.uint32)
        for i in range(VALUES):
            out[full, i] = np.minimum.reduceat((small ^ FLIPS[i]) * FACTORS[i], bounds[full])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words(piece.column("text"), MARKS, lower=True)
            values, bounds = shingle_sets(words)
            node = text_keys(words).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(piece.column(c) for c in ROW), pa.array(node), pa.array(np.diff(bounds)), binary(minhash(values, bounds))], ["doc_id", *ROW, "node", "size", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = signatures(batch.column("sig"))
        node = batch.column("node").to_numpy()
        keys = np.empty((len(node), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            key = np.full(len(node), BAND_SALT[b])
            for r in range(b * ROWS, b * ROWS + ROWS):
                key = mix(key ^ sig[:, r].astype(np.uint64))
            keys[:, b] = key
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(node, BANDS))], ["bucket", "node"])


def signatures(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    if not len(column):
        return np.zeros((0, VALUES), np.uint32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32).reshape(-1, VALUES)


def in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks of its group that its own block is in (columns left, right, side).

    A group of one block makes no copies; a larger one makes as many copies of a row as it has blocks.
    """
    return (
        rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")})
        .drop("other", blocks)
    )


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbouring rows begins, and the number of rows."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def pair_runs(bounds: np.ndarray, left: np.ndarray, right: np.ndarray, side: np.ndarray, limit: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare, in runs of about `limit`: all of a block with itself, or those across two blocks."""
    n = len(side)
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)
    own = left == right
    cut = np.repeat(bounds[:-1] + np.add.reduceat((side == left).astype(np.int64), bounds[:-1]), size)  # rows are sorted by side
    first = np.where(own, np.arange(n) + 1, cut)
    count = np.where(own | (side == left), end - first, 0)
    done = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + limit, side="right")))
        c = count[at:to]
        if c.any():
            yield np.repeat(np.arange(at, to), c), ranges(first[at:to], c)
        at = to


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior never falls below the tolerance as more values are compared."""
    equal = np.zeros(len(i), dtype=np.int32)
    for at in range(0, VALUES, STEP):
        if not len(i):
            break
        equal += (sig[i, at : at + STEP] == sig[j, at : at + STEP]).sum(axis=1, dtype=np.int32)
        stay = equal >= least_matches(threshold, tolerance, at + STEP)
        i, j, equal = i[stay], j[stay], equal[stay]
    return i, j


def spread(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least label of all rows that the links (i, j) connect."""
    while True:
        low = np.minimum(labels[i], labels[j])
        new = labels.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == labels).all():
            return labels
        labels = new


def rough_links(threshold: float, tolerance: float):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, left, right, side, node = (rows.column(c).to_numpy() for c in ("bucket", "left", "right", "side", "node"))
        sig = signatures(rows.column("sig"))
        bounds = group_bounds(bucket, left, right)
        for i, j in pair_runs(bounds, left, right, side):
            i, j = survivors(sig, i, j, threshold, tolerance)
            if len(i):
                touched = np.unique(np.concatenate([i, j]))
                i, j = np.searchsorted(touched, i), np.searchsorted(touched, j)
                labels = spread(node[touched], i, j)
                moved = np.unique(np.stack([node[touched], labels], axis=1)[labels != node[touched]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(moved[:, 0]), pa.array(moved[:, 1])], ["a", "b"])

    return work


def shared_counts(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, by products of 0/1 matrices."""
    n = len(starts)
    owner = np.repeat(np.arange(n), ends - starts)
    flat = values[ranges(starts, ends - starts)]
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count[column] > 1  # a shingle of one set alone is in no intersection
    owner, column = owner[often], column[often]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    new = np.ones(len(column), dtype=bool)
    new[1:] = column[1:] != column[:-1]
    dense = np.cumsum(new) - 1
    for at in range(0, int(dense[-1]) + 1 if len(dense) else 0, 4096):
        a, b = np.searchsorted(dense, (at, at + 4096))
        part = np.zeros((n, 4096), dtype=np.float32)
        part[owner[a:b], dense[a:b] - at] = 1
        out += part @ part.T
    return out


def exact_links(threshold: float):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        root, left, right, side, node, copies = (rows.column(c).to_numpy() for c in ("root", "left", "right", "side", "node", "copies"))
        column = rows.column("shingles").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
        values = np.frombuffer(column.buffers()[2], np.uint64)
        bounds = group_bounds(root, left, right)
        for a, b in zip(bounds[:-1], bounds[1:]):
            keep = a + np.unique(node[a:b], return_index=True)[1]  # a row that is there twice counts once
            keep = keep[np.argsort(side[keep], kind="stable")]
            starts, ends = offsets[keep], offsets[keep + 1]
            size = ends - starts
            if len(keep) < 2:
                continue
            if len(keep) <= 6:
                shared = np.zeros((len(keep), len(keep)))
                for x in range(len(keep)):
                    for y in range(x + 1, len(keep)):
                        one, two = values[starts[x] : ends[x]], values[starts[y] : ends[y]]
                        if min(len(one), len(two)) >= threshold * max(len(one), len(two)):
                            at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                            shared[x, y] = shared[y, x] = (two[at] == one).sum()
            else:
                shared = shared_counts(values, starts, ends)
            linked = shared + 1e-9 >= threshold * (size[:, None] + size[None, :] - shared)
            if left[a] != right[a]:
                linked &= side[keep][:, None] != side[keep][None, :]
            np.fill_diagonal(linked, False)
            linked &= shared > 0
            count = linked @ copies[keep]
            has = np.flatnonzero(count)
            if len(has):
                i, j = np.nonzero(linked)
                labels = spread(node[keep], i, j)
                yield pa.RecordBatch.from_arrays([pa.array(node[keep][has]), pa.array(labels[has]), pa.array(count[has])], ["node", "low", "links"])

    return work


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        for piece in slices(batch, "text"):
            words = Words(piece.column("text"), MARKS, lower=True)
            values, bounds = shingle_sets(words)
            node = piece.column("node").to_numpy()
            # a row that is there again follows its first one; a text of another node has the same hash by chance
            stay = (text_keys(words).view(np.int64) == node) & (node != np.append(node[:1] + 1 if last is None else last, node[:-1]))
            last = node[-1]
            out = piece.select(["root", "side", "others", "node", "copies"]).append_column("shingles", binary_runs(values, bounds))
            yield out.filter(pa.array(stay))


def set_blocks(found: DataFrame, threshold: float) -> DataFrame:
    """found(root, size, node, ...) with side, its own block, and others, the blocks that it is compared with.

    Sizes fall into classes; sets of classes that are not neighbours cannot reach the threshold.
    """
    width = 1.01 * max(-math.log(threshold), 1e-3) if threshold > 0 else 1e9
    found = found.withColumn("kind", F.floor(F.log("size") / width).cast("int"))
    blocks = found.groupBy("root", "kind").agg(F.greatest(F.ceil(F.count("*") / EXACT_BLOCK), F.ceil(F.sum("size") / EXACT_SHINGLES)).cast("int").alias("blocks"))
    of_root = blocks.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"))  # as many as classes of sizes
    number = lambda kind, block: kind.cast("long") * (1 << 32) + block
    near = F.filter(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1), lambda k: F.map_contains_key("blocks", k))
    others = F.flatten(F.transform(near, lambda k: F.transform(F.sequence(F.lit(0), F.col("blocks")[k] - 1), lambda b: number(k, b))))
    own = number(F.col("kind"), F.pmod(F.xxhash64("node"), F.col("blocks")[F.col("kind")]))
    return found.join(of_root, "root").withColumns({"side": own, "others": others}).drop("kind", "blocks")


def linked_texts(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, groups) of the join over docs(doc_id, text).

    rows: doc_id, node (the class of equal texts; 0 without words), and ROW. texts: a row for each
    class with node, copies, doc_id and row (the first of its rows), links (rows of other classes at
    the threshold). groups: node, root.
    """
    docs = row_keys(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *ROW)
    base = kept(docs.mapInArrow(_sketch, "doc_id long, no_id boolean, row_id long, text_hash long, node long, size long, sig binary"))
    texts = base.where("node <> 0").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min(F.struct(*ROW)).alias("row"), F.max("size").alias("size"), F.max("sig").alias("sig"))
    texts = kept(texts)
    bands = texts.select("node", "sig").mapInArrow(_bands, "bucket long, node long")
    # buckets with the same members are compared once
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).where("n > 1")
    buckets = buckets.groupBy("n", "lo", "hi", "all").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / ROUGH_BLOCK).alias("blocks"))
    members = bands.join(buckets, "bucket").join(texts.select("node", "sig"), "node")
    rough = in_groups(in_blocks(members, "bucket", "blocks"), ["bucket", "left", "right"], ["side"], rough_links(threshold, tolerance), "a long, b long")
    near = connected(rough)
    found = set_blocks(near.join(texts.select("node", "copies", "size", "row.*"), "node"), threshold)
    whole = docs.drop("doc_id").join(found, ROW).select("root", "side", "others", "node", "copies", "text")
    sets = whole.mapInArrow(_shingles, "root long, side long, others array<long>, node long, copies long, shingles binary")
    pairs = sets.withColumn("other", F.explode("others")).withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")}).drop("others", "other")
    exact = kept(in_groups(pairs, ["root", "left", "right"], ["side"], exact_links(threshold), "node long, low long, links long"))
    groups = connected(exact.select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    counted = texts.select("node", "copies", "doc_id", "row").join(links, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return base.select("doc_id", "node", *ROW), counted, groups


def ngram_jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, class_id, n_links, n_copies.

    class_id is the smallest doc_id that the text reaches over equal texts and links of at least
    `threshold`; n_links counts the other rows that it is linked with, n_copies of them equal.
    """
    rows, texts, groups = linked_texts(docs, threshold, tolerance)
    joined = texts.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = joined.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = joined.join(classes, "root").select("node", "class_id", "links", "copies")
    return (
        rows.join(known, "node", "left")
        .select("doc_id", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("n_copies"))
    )


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with ROW, by which a row is found again without its text."""
    return docs.withColumns({"no_id": F.col("doc_id").isNull(), "row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "text_hash": F.xxhash64(F.col("text").cast("string"))})


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose group keeps another one: of each group one row stays.

    It is a row of the smallest doc_id, rows without one coming last; of several such rows, one of
    the text with the least hash. Texts without words stay, all of them. Columns of docs that are
    named as ROW are replaced.
    """
    rows, texts, groups = linked_texts(docs, threshold)
    first = texts.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias("row")).select("row.*", F.lit(False).alias("_all"))
    wordless = rows.where("node = 0").select(*ROW).distinct().withColumn("_all", F.lit(True))
    stay = first.union(wordless).groupBy(*ROW).agg(F.max("_all").alias("_all"))
    turn = F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(0)))
    return row_keys(docs).join(stay, ROW).withColumn("_turn", turn).where("_all or _turn = 1").select(docs.columns)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and what they reach: for small tables.
OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+') AS ws FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS s FROM w, UNNEST(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE k >= 0.8 * (x.n + y.n - k)),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a, min(doc_id) AS class_id FROM reach JOIN w ON r = b GROUP BY a),
same AS (SELECT x.r, count(*) - 1 AS n FROM (SELECT r, array_to_string(ws, ' ') AS t FROM w WHERE len(ws) > 0) x JOIN (SELECT array_to_string(ws, ' ') AS t FROM w) y USING (t) GROUP BY x.r)
SELECT doc_id, class_id, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(same.n, 0)::BIGINT AS n_copies
FROM w JOIN class ON a = w.r LEFT JOIN (SELECT a AS r, count(*) AS n FROM link GROUP BY a) l ON l.r = w.r LEFT JOIN same ON same.r = w.r
"""
