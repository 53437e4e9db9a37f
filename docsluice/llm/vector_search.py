"""Operator 8: approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted in numpy on at most FIT_ROWS vectors picked by a hash: every node's vectors are
clustered into BRANCHES children until a leaf stands for about LEAF_ROWS rows of the table. Where
the sample is too small for that, leaves that hold more than DEEP_ROWS rows are split on: each gets
a subtree fitted on up to SUB_ROWS of its own rows, in Spark, a task for each leaf. Every row of the
table is then assigned to a leaf. A query walks the tree best-bin-first: a priority queue holds the
branches by their bound, the best is opened, and leaves come out in the order in which they are to
be visited.

How many rows' worth of leaves a query visits is calibrated: for CALIBRATION queries the exact
neighbours are found in blocks over all rows, and the visit is widened until the share of those
neighbours that lie in visited leaves reaches RECALL. A visit never ends before it holds K rows
besides the query's own.

A query first visits the nearest leaves, about the square root of their number; its K-th best score
there is a floor below which the other leaves' rows need not come back. Rows and visits meet by leaf.
Leaves of more than BLOCK_ROWS rows are cut into blocks by a hash, so
a vector that a third of all rows share fills many blocks and no single task. In a block, a matrix
product finds the rows that can be among a query's best K; their scores are then inner products of
the original components, summed in order in double precision. A window over the blocks' bests gives
the K nearest, ties to the smaller vec_id.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part,
nor do null ids. Vectors of different lengths are searched apart, each query among those of its own
length. Rows that repeat a vec_id and its vector are candidates each; together they are one query,
whose own row is one of them. A vec_id with several vectors is as many queries. A query with fewer
candidates than K gets all that its visit finds (all, if the table is small); further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import in_groups, kept, table
from .ngram_join import group_bounds
from .words import binary

K, QUERY_EVERY, RECALL = 20, 20, 0.95
FIT_ROWS, BRANCHES, LEAF_ROWS, CALIBRATION, BLOCK_ROWS = 16_384, 8, 1_024, 64, 4_096
#: A leaf above DEEP_ROWS rows is split by a subtree fitted on SUB_ROWS of them at most, into leaves of SUB_LEAF of those at least.
DEEP_ROWS, SUB_ROWS, SUB_LEAF = 16_384, 4_096, 64
#: Visits of a leaf above about this number, as the calibration's walks foretell it, are dealt over several tasks.
VISITS = 50_000


@dataclass
class Tree:
    """Nodes with their centres; children[i] is empty for a leaf; leaf[i] numbers the leaves."""

    centre: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    size: np.ndarray
    node: np.ndarray | None = None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(x), dtype=np.int64)
        todo = [0] if len(x) else []
        while todo:
            n = todo.pop()
            if self.children[n]:
                rows = np.flatnonzero(node == n)
                if len(rows):
                    c = np.array(self.children[n])
                    distance = (self.centre[c] ** 2).sum(axis=1) - 2 * x[rows] @ self.centre[c].T
                    node[rows] = c[distance.argmin(axis=1)]
                    todo += self.children[n]
        return self.leaf[node]

    def visit(self, q: np.ndarray, rows: float) -> list[int]:
        """Leaves in best-bin-first order by inner product, until they hold so many fitted rows."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        held = 0.0
        while queue and (held < rows or not out):
            _, n = heapq.heappop(queue)
            if self.children[n]:
                for c, s in zip(self.children[n], (self.centre[self.children[n]] @ q).tolist()):
                    heapq.heappush(queue, (-s, c))
            else:
                out.append(int(self.leaf[n]))
                held += max(self.size[n], 1)
        return out

    def near(self, leaves: list[int]) -> int:
        """How many of a walk's leaves are visited first: about the square root of their number, and such that they hold K rows and the query's."""
        held = np.cumsum([self.size[self.node[leaf]] for leaf in leaves])
        return max(int(np.ceil(np.sqrt(len(leaves)))), int(np.searchsorted(held, K + 1)) + 1)

    def numbered(self) -> None:
        """Numbers the leaves anew."""
        ends = [i for i, c in enumerate(self.children) if not c]
        self.leaf = np.full(len(self.children), -1)
        self.leaf[ends] = np.arange(len(ends))
        self.node = np.array(ends)


def fit(x: np.ndarray, leaf_rows: float, seed: int = 5) -> Tree:
    """A tree over the rows of x whose leaves hold at most `leaf_rows` of them, unless these are equal."""
    rng = np.random.default_rng(seed)
    centre = [x.mean(axis=0) if len(x) else np.zeros(1)]
    children: list[list[int]] = [[]]
    size = [len(x)]
    todo = [(0, np.arange(len(x)))]
    while todo:
        n, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        own = x[rows]
        distinct = np.unique(own[rng.permutation(len(own))[:1024]], axis=0)
        if len(distinct) < 2:
            continue
        k = min(BRANCHES, len(distinct), int(np.ceil(len(rows) / leaf_rows)))
        means = distinct[rng.permutation(len(distinct))[:k]]
        for _ in range(12):
            near = ((means**2).sum(axis=1) - 2 * own @ means.T).argmin(axis=1)
            means = np.stack([own[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(k)])
        near = ((means**2).sum(axis=1) - 2 * own @ means.T).argmin(axis=1)
        if (near == near[0]).all():
            continue
        for j in range(k):
            if (near == j).any():
                centre.append(means[j])
                children.append([])
                size.append(int((near == j).sum()))
                children[n].append(len(centre) - 1)
                todo.append((len(centre) - 1, rows[near == j]))
    tree = Tree(np.stack(centre), children, np.zeros(0, np.int64), np.array(size))
    tree.numbered()
    return tree


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of eight-byte floats as a matrix."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.chunk(0) if raw.num_chunks else pa.array([], pa.binary())
    if not len(raw):
        return np.zeros((0, 1))
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(len(raw), -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, each the sum of its components' products in their order."""
    out = np.zeros(len(q))
    for j in range(x.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, width, v, n): the vectors that take part, as binary doubles; n rows are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size)) + 0.0  # one zero only
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(np.full(len(x), int(size), np.int32)), binary(x)], ["vec_id", "width", "v"])

    doubles = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).where("vec_id is not null and v is not null")
    vectors = some.where(~bad & F.exists("v", lambda c: c != 0)).mapInArrow(run, "vec_id long, width int, v binary")
    return vectors.groupBy("vec_id", "width", "v").agg(F.count("*").alias("n"))


def _best(q: np.ndarray, query_id: np.ndarray, x: np.ndarray, ids: np.ndarray, n: np.ndarray, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score, times) of rows that are among the K best of each query and reach its floor, its own row left out; ids ascend.

    A query's rows come in order, ties by the smaller id; times counts equal rows.
    """
    rough = q @ x.T
    at, row = np.nonzero(query_id[:, None] == ids[None, :])
    own = (q[at] == x[row]).all(axis=1)
    at, row = at[own], row[own]
    single = n[row] == 1
    rough[at[single], row[single]] = -np.inf
    k = min(K, len(ids))
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
    # the product's terms are summed in any order, so what is short of the K-th by rounding is looked at too
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    i, j = np.nonzero((rough >= (np.maximum(least, floor) - slack)[:, None]) & (rough > -np.inf))
    score = products(q[i], x[j])
    times = n[j].copy()
    mine = np.zeros(len(q), np.int64) - 1
    mine[at] = row
    times[mine[i] == j] -= 1
    order = np.lexsort((j, -score, i))
    i, j, score, times = i[order], j[order], score[order], times[order]
    done = np.cumsum(times) - times
    first = np.searchsorted(i, i)
    keep = done - done[first] < K
    return i[keep], j[keep], score[keep], np.minimum(times[keep], K)


def _meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    leaf, block, part, role, ids, n = (rows.column(c).to_numpy() for c in ("leaf", "block", "part", "role", "vec_id", "n"))
    x, floor = matrix(rows.column("v")), rows.column("floor").to_numpy()
    bounds = group_bounds(leaf, block, part)
    for a, b in zip(bounds[:-1], bounds[1:]):
        cut = a + int((role[a:b] == 0).sum())  # the leaf's rows come before its visits, ids ascend
        if a < cut < b:
            for at in range(cut, b, 256):
                to = min(at + 256, b)
                i, j, score, times = _best(x[at:to], ids[at:to], x[a:cut], ids[a:cut], n[a:cut], floor[at:to])
                # a visit's n is its query's number
                yield pa.RecordBatch.from_arrays([pa.array(n[at:to][i]), pa.array(ids[at:to][i]), pa.array(ids[a:cut][j]), pa.array(score), pa.array(times.astype(np.int32))], ["query", "query_id", "vec_id", "score", "times"])


def nearest(rows: DataFrame, every: int = QUERY_EVERY, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the K nearest rows of every `every`-th vec_id."""
    vectors = kept(usable(rows))
    widths = vectors.groupBy("width").count().orderBy("width").collect()  # a row for each length of vectors
    parts = [_nearest(vectors.where(F.col("width") == w["width"]).drop("width"), w["count"], every, recall) for w in widths]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.union, parts)


def _nearest(vectors: DataFrame, n: int, every: int, recall: float) -> DataFrame:
    spark = vectors.sparkSession
    pick = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
    sample = vectors.where(pick < 1_000_000 * FIT_ROWS / max(n, FIT_ROWS)).select("vec_id", "v").toArrow().sort_by("vec_id")
    if not sample.num_rows:
        sample = vectors.select("vec_id", "v").limit(1).toArrow()
    tree = fit(matrix(sample["v"]), max(8, LEAF_ROWS * sample.num_rows / n))
    placed = kept(_placed(vectors, tree))
    full = _held(placed, tree)
    if (full > DEEP_ROWS).any():
        _deepened(placed, tree, full)
        placed = kept(_placed(vectors, tree))
        full = _held(placed, tree)
    tree.size = np.where(tree.leaf >= 0, full[np.maximum(tree.leaf, 0)], tree.size)
    shared = spark.sparkContext.broadcast(tree)

    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("n"))
    trial = queries.orderBy("n", "vec_id").limit(CALIBRATION).select("vec_id", "v").toArrow()
    rows_wanted = max(_calibrated(placed, tree, trial, recall) if trial.num_rows else 0, K + 1)
    walked = np.bincount([leaf for q in matrix(trial["v"]) for leaf in tree.visit(q, rows_wanted)], minlength=len(full)) if trial.num_rows else np.zeros(len(full))
    parts = np.maximum(1, np.ceil((walked + 1) / (trial.num_rows + 1) * queries.count() / VISITS))

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("v"))
                for at in range(0, len(x), 64):
                    leaves = [shared.value.visit(q, rows_wanted) for q in x[at : at + 64]]
                    near = [shared.value.near(ls) for ls in leaves]
                    leaves = [ls[:k] if first else ls[k:] for ls, k in zip(leaves, near)]
                    take = pa.array(np.repeat(np.arange(at, at + len(leaves)), [len(ls) for ls in leaves]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([leaf for ls in leaves for leaf in ls], pa.int64()), *(batch.column(c).take(take) for c in ("vec_id", "v", "n", "floor"))], ["leaf", "vec_id", "v", "n", "floor"])

        return run

    # leaf sizes: a row a leaf, bounded by the fitted samples
    blocks = F.broadcast(spark.createDataFrame(pa.table({"leaf": np.arange(len(full)), "blocks": np.maximum(1, -(-full // BLOCK_ROWS)).astype(np.int32), "parts": parts.astype(np.int32)})))
    columns = ["leaf", "block", "part", "role", "vec_id", "v", "n", "floor"]
    held = placed.join(blocks, "leaf").withColumns({"block": F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "role": F.lit(0), "floor": F.lit(0.0)}).select(columns)
    order = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    turn = F.row_number().over(order)

    def met(asking: DataFrame, first: bool) -> DataFrame:
        asked = asking.mapInArrow(visits(first), "leaf long, vec_id long, v binary, n long, floor double").join(blocks, "leaf").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "part": F.pmod("n", "parts").cast("int"), "role": F.lit(1)}).select(columns)
        found = in_groups(held.union(asked), ["leaf", "block", "part"], ["role", "vec_id"], _meet, "query long, query_id long, vec_id long, score double, times int")
        return found.withColumn("turn", turn).where(F.col("turn") <= K)  # of equal rows one, with their number

    near = kept(met(queries.withColumn("floor", F.lit(float("-inf"))), True))
    floors = near.where(F.col("turn") == K).select(F.col("query").alias("n"), F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    far = met(queries.join(floors, ["n", "vec_id"], "left").fillna({"floor": float("-inf")}).select("vec_id", "v", "n", "floor"), False)
    best = near.union(far).drop("turn").withColumn("turn", turn).where(F.col("turn") <= K)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return each.withColumn("rank", turn).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def _placed(vectors: DataFrame, tree: Tree) -> DataFrame:
    """The vectors with their leaf."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(shared.value.assign(matrix(batch.column("v")))), batch.column("v"), batch.column("n")], ["vec_id", "leaf", "v", "n"])

    return vectors.mapInArrow(assign, "vec_id long, leaf long, v binary, n long")


def _held(placed: DataFrame, tree: Tree) -> np.ndarray:
    """How many vectors each leaf holds: a number a leaf, bounded by the fitted samples."""
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n")).toArrow()
    full = np.zeros(int(tree.leaf.max()) + 1, dtype=np.int64)
    full[counts["leaf"].to_numpy()] = counts["n"].to_numpy()
    return full


def _deepened(placed: DataFrame, tree: Tree, full: np.ndarray) -> None:
    """Splits the leaves of more than DEEP_ROWS rows; each one's subtree is fitted in a task, on a sample of its rows."""
    large = np.flatnonzero(full > DEEP_ROWS)
    wanted = placed.sparkSession.createDataFrame(pa.table({"leaf": large, "rows": full[large]}))

    def subtree(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        sub = fit(matrix(rows["v"]), max(SUB_LEAF, LEAF_ROWS * rows.num_rows / rows["rows"][0].as_py()))
        parent = np.full(len(sub.children), -1)
        for i, c in enumerate(sub.children):
            parent[c] = i
        return pa.table({"leaf": np.full(len(parent), rows["leaf"][0].as_py()), "node": np.arange(len(parent)), "parent": parent, "centre": binary(sub.centre)})

    sample = placed.join(F.broadcast(wanted), "leaf").where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 1_000_000 * SUB_ROWS / F.col("rows"))
    grown = sample.select("leaf", "rows", "vec_id", "v").groupBy("leaf").applyInArrow(subtree, "leaf long, node long, parent long, centre binary").toArrow()
    node_of = {int(leaf): i for i, leaf in enumerate(tree.leaf) if leaf >= 0}
    centres, sizes = [tree.centre], [tree.size]
    for leaf in np.unique(grown["leaf"].to_numpy()):
        part = grown.filter(pc.equal(grown["leaf"], int(leaf))).sort_by("node")
        top, base = node_of[int(leaf)], len(tree.children) - 1  # the subtree's root is the leaf itself
        tree.children += [[] for _ in range(part.num_rows - 1)]
        for i, p in zip(part["node"].to_pylist()[1:], part["parent"].to_pylist()[1:]):
            tree.children[top if p == 0 else base + p].append(base + i)
        centres.append(matrix(part["centre"])[1:])
        sizes.append(np.zeros(part.num_rows - 1, tree.size.dtype))
    tree.centre, tree.size = np.concatenate(centres), np.concatenate(sizes)
    tree.numbered()


def _calibrated(placed: DataFrame, tree: Tree, trial: pa.Table, recall: float) -> float:
    """How many rows a visit must hold so that the trial queries' exact neighbours are found at the recall."""
    query_id, q = trial["vec_id"].to_numpy(), matrix(trial["v"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("vec_id")
            i, j, score, _ = _best(q, query_id, matrix(batch.column("v")), batch.column("vec_id").to_numpy(), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(i), batch.column("vec_id").take(pa.array(j)), pa.array(score), batch.column("leaf").take(pa.array(j))], ["query", "vec_id", "score", "leaf"])

    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    true = placed.mapInArrow(exact, "query long, vec_id long, score double, leaf long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query", "leaf").toPandas()
    needed = []
    size = dict(zip(tree.leaf.tolist(), tree.size.tolist()))
    for i, leaves in true.groupby("query").leaf:
        walk = tree.visit(q[i], np.inf)
        before = np.cumsum([0, *(size[leaf] for leaf in walk)])
        place = {leaf: p for p, leaf in enumerate(walk)}
        needed += [before[place[leaf]] + 1 for leaf in leaves]  # the visit goes on while it holds fewer rows
    if not needed:
        return 0.0
    return float(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
