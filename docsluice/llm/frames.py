"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

import atexit
import contextlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files that only a written table needed go with the end of its job.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def at_exit(spark: SparkSession, folder: str) -> None:
    """Deletes a folder when the program ends, for what a result that is still to be read needs until then."""
    context = spark.sparkContext
    path, conf = context._jvm.org.apache.hadoop.fs.Path(folder), context._jsc.hadoopConfiguration()

    def delete() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            path.getFileSystem(conf).delete(path, True)

    atexit.register(delete)


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that shared_folder holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sheltered(docs: DataFrame, read: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but those that an operator reads under names of no other's, and the columns as they were.

    Selecting the second from what the operator returns gives the input's columns back, whatever
    columns the operator adds or replaces.
    """
    names = [c if c in read else f"_own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def kept(df: DataFrame) -> DataFrame:
    """The rows in files of the shared folder: cuts the lineage and survives a lost executor.

    Where no folder is set, the session gets one of its own: the files of a frame go when nothing
    refers to it any more, and the folder goes when the program ends.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        at_exit(spark, spark.sparkContext.getCheckpointDir())
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:  # the frame takes the setting over when it is made
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEAN_UP, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """df with idx, each row's place in its group from 0 by `order`, and total, the rows of the group.

    The rows are sorted over all tasks; a place is the number of the group's rows in earlier
    partitions plus the place in the own one, so a group of any size is spread over many tasks, and
    rows that are equal in all of `order` are too. A group's columns must not be null.
    """
    spark = df.sparkSession
    marked = kept(df.withColumn("_row", F.monotonically_increasing_id()))
    dealt = marked.repartitionByRange(partitions(spark), *groups, *order, "_row").sortWithinPartitions(*groups, *order, "_row").drop("_row")
    dealt = kept(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*groups, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total"))
    return dealt.join(runs, [*groups, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def in_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch] | None], schema: str, last: int = 8_000_000) -> DataFrame:
    """work(rows of whole groups) over runs of groups, each group in one piece and in order.

    The rows are dealt out by the keys, sorted, and read as Arrow batches; a run closes at the
    first end of a group after `last` bytes, so that many small groups share one call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def last_group(batch: pa.RecordBatch) -> int:
            """The row at which the batch's last group begins."""
            other = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                values = batch.column(k).to_numpy(zero_copy_only=False)
                other |= values != values[-1]
            return int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0

        def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
            return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)

        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting and size >= last:
                if not same(waiting[-1], batch):
                    yield from work(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                elif (cut := last_group(waiting[-1])) > 0:
                    yield from work(pa.Table.from_batches([*waiting[:-1], waiting[-1].slice(0, cut)]))
                    waiting = [waiting[-1].slice(cut)]
                    size = waiting[0].nbytes
            waiting.append(batch)
            size += batch.nbytes
        if waiting:
            yield from work(pa.Table.from_batches(waiting))

    dealt = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node that it reaches.

    Large-star and small-star steps in turn; each keeps at most as many rows as it got. A node with
    very many neighbours is met by a join against one row a node; those rows are written first, so
    that both sides of the join are plain shuffles and Spark can split the node's rows over tasks.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        least = kept(now.select(F.col("a").alias("n"), F.col("b").alias("m")).union(now.select("b", "a")).groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("m")))
        # larger neighbours of every node go to the node's smallest neighbour
        large = now.join(least, now["b"] == least["n"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # smaller neighbours of every node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = kept(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
