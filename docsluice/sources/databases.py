"""Tables of databases: read by ranges of a key that hold about as many rows each, appended by first writer.

The database counts its own rows; what comes to the driver is a count for each of at most BUCKETS
ranges, asked again within ranges that hold too many. A task then reads one range, so a table of any
size, and of any gaps between its keys, is read in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PART = 500_000
BUCKETS = 1_000


def _asked(spark: SparkSession, url: str, query: str, options: dict[str, str]) -> list:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load().collect()  # at most BUCKETS rows


def key_ranges(spark: SparkSession, url: str, table: str, key: str, rows: int = ROWS_PER_PART, **options: str) -> list[tuple[int, int]]:
    """(least, most) of an integer key, both included, in order: ranges of at most `rows` rows, or one key that has more.

    Neighbouring ranges are merged as long as they hold no more than `rows` together. Nulls lie in none.
    """
    low, high = _asked(spark, url, f"SELECT MIN({key}) AS a, MAX({key}) AS b FROM {table}", options)[0]
    found: list[tuple[int, int, int]] = []
    open_ranges = [] if low is None else [(int(low), int(high))]
    while open_ranges:
        start, end = open_ranges.pop()
        width = -(-(end - start + 1) // BUCKETS)
        # a bucket is named by its least key, which keeps the quotient an integer in every dialect
        query = f"SELECT {key} - MOD({key} - ({start}), {width}) AS a, COUNT(*) AS n FROM {table} WHERE {key} BETWEEN {start} AND {end} GROUP BY {key} - MOD({key} - ({start}), {width})"
        for a, n in _asked(spark, url, query, options):
            last = min(int(a) + width - 1, end)
            if n > rows and last > a:
                open_ranges.append((int(a), last))
            else:
                found.append((int(a), last, int(n)))
    merged: list[list[int]] = []
    for a, b, n in sorted(found):
        if merged and merged[-1][2] + n <= rows:
            merged[-1][1:] = [b, merged[-1][2] + n]
        else:
            merged.append([a, b, n])
    return [(a, b) for a, b, _ in merged]


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, rows: int = ROWS_PER_PART, **options: str) -> DataFrame:
    """A database's table, one partition for each range of its integer key; without a key, or if it is empty, one partition.

    Ranges are fixed when the frame is made; the first one also takes smaller keys and nulls, the last one
    larger keys, and each takes the gap up to the next one, so rows that come in between are read as well.
    """
    ranges = key_ranges(spark, url, table, key, rows, **options) if key else []
    if len(ranges) < 2:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    starts = [a for a, _ in ranges[1:]]
    parts = [f"{key} < {starts[0]} OR {key} IS NULL", *(f"{key} >= {a} AND {key} < {b}" for a, b in zip(starts, starts[1:])), f"{key} >= {starts[-1]}"]
    return spark.read.jdbc(url, table, predicates=parts, properties=options)


def append_new(rows: DataFrame, url: str, table: str, key: str, connections: int = 8, **options: str) -> None:
    """Rows whose key the table does not have yet; of several rows of one key the least. Rows without a key are left out.

    A retried task may write its rows again, so the table's key must be unique there: the database then
    refuses the second copy as a whole, as each task writes in one transaction.
    """
    there = rows.sparkSession.read.format("jdbc").options(url=url, query=f"SELECT {key} AS k FROM {table}", **options).load().toDF("_key")
    own = [c for c in rows.columns if c != key]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*own)).alias("_row")).select(key, "_row.*")
    new = one.join(there, F.col(key) == F.col("_key"), "left_anti").select(*rows.columns)
    new.coalesce(connections).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
