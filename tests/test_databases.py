"""Tables of a database: balanced ranges, whole reads, appends by first writer. The database is the one that comes with Spark."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsluice.sources import databases

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def url(spark):
    url = "jdbc:derby:memory:reviews;create=true"
    # two crowds of keys with a wide gap, one key that many rows share, some rows without a key
    ids = spark.range(0, 3000).select("id").union(spark.range(10**12, 10**12 + 500)).union(spark.range(700).select(F.lit(-5).cast("long"))).union(spark.range(20).select(F.lit(None).cast("long")))
    ids.select(F.col("id").alias("K"), F.concat(F.lit("r"), F.coalesce("id", F.lit(0))).alias("V")).write.jdbc(url, "analyses", properties=DRIVER)
    return url


def test_ranges_are_balanced(spark, url):
    ranges = databases.key_ranges(spark, url, "analyses", "K", rows=400, **DRIVER)
    assert all(a <= b < c for (a, b), (c, _) in zip(ranges, ranges[1:])) and (-5, -5) in ranges
    keys = [-5] * 700 + list(range(3000)) + list(range(10**12, 10**12 + 500))
    held = [sum(a <= k <= b for k in keys) for a, b in ranges]
    assert sum(held) == len(keys) and sorted(held)[-1] == 700 and sorted(held)[-2] <= 400 and len(held) <= 14


def test_whole_table_is_read(spark, url):
    want = sorted(map(tuple, databases.read_table(spark, url, "analyses", **DRIVER).fillna(-1).collect()))
    got = databases.read_table(spark, url, "analyses", "K", rows=400, **DRIVER)
    assert got.rdd.getNumPartitions() > 8 and sorted(map(tuple, got.fillna(-1).collect())) == want and len(want) == 4220
    sizes = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes <= 720  # the key that 700 rows share, and the rows without one
    assert databases.read_table(spark, url, "analyses", "K", **DRIVER).rdd.getNumPartitions() == 1


def test_first_writer_wins(spark, url):
    schema = "ID long, V string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    make().write.jdbc(url, "published", properties=DRIVER)
    assert databases.key_ranges(spark, url, "published", "ID", **DRIVER) == []
    databases.append_new(make((1, "b"), (1, "a"), (2, None), (None, "x")), url, "published", "ID", **DRIVER)
    databases.append_new(make((1, "late"), (3, "c")), url, "published", "ID", **DRIVER)
    assert sorted(map(tuple, databases.read_table(spark, url, "published", "ID", **DRIVER).collect())) == [(1, "a"), (2, None), (3, "c")]
