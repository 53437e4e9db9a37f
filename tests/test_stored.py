"""Stored tables, retention as a job, and the bucketed layout."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docsluice.functions.scalars import compatibility_key
from docsluice.operators import lifecycle
from docsluice.sources.tables import Conflict, StoredTables, bucketed_reports
from docsluice.streaming import retention

T0 = datetime(2024, 1, 1)
ANALYSES = "analysis_id long, state string, document_id long, expires_at timestamp, published_at timestamp, public_slug string"


def day(n):
    return T0 + timedelta(days=n)


def made(spark, root):
    tables = StoredTables(spark, str(root))
    tables.create("analyses", spark.createDataFrame([(i, ["completed", "running", None][i % 3], i % 10, day(i % 4), None, None) for i in range(60)], ANALYSES), "analysis_id", 4)
    tables.create("documents", spark.createDataFrame([(i, day(0)) for i in range(12)], "document_id long, created_at timestamp"), "document_id", 4)
    tables.create("resolutions", spark.createDataFrame([(i, day(i)) for i in range(6)], "resolution_id long, expires_at timestamp"), "resolution_id", 2)
    return tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def contents(tables):
    return {t: rows(tables.read(t)) for t in retention.TABLES}


def test_readers_see_one_state(spark, tmp_path):
    tables = made(spark, tmp_path)
    before = tables.read("analyses")
    chosen = spark.createDataFrame([(3,), (6,)], "analysis_id long")
    publish = lambda now: lambda t: {"analyses": lifecycle.published(t["analyses"], chosen, F.lit(now))}
    old = tables.state()
    tables.rewrite(publish(day(9)), keys={"analyses": F.col("analysis_id").isin(3, 6)})
    assert before.where("published_at is not null").count() == 0  # opened before, reads what was there then
    after = tables.read("analyses")
    assert {r.analysis_id: r.published_at for r in after.where("published_at is not null").collect()} == {3: day(9), 6: day(9)}
    assert after.count() == 60
    new = tables.state()
    same = [p for p, f in new["tables"]["analyses"]["folders"].items() if old["tables"]["analyses"]["folders"][p] == f]
    assert same and len(same) >= 2  # parts without the chosen rows were not written again
    with pytest.raises(ValueError, match="rows of others"):
        tables.rewrite(lambda t: {"analyses": t["analyses"].withColumn("analysis_id", F.col("analysis_id") + 1)}, keys={"analyses": F.col("analysis_id") == 3})
    with pytest.raises(RuntimeError):
        tables.rewrite(lambda t: (_ for _ in ()).throw(RuntimeError("crash")))
    assert tables.state() == new


def test_the_first_publication_wins(spark, tmp_path):
    tables, other = made(spark, tmp_path), StoredTables(spark, str(tmp_path))
    chosen = spark.createDataFrame([(3,)], "analysis_id long")
    tried = []

    def slow(t):
        """While this rewrite is under way another one publishes the same analysis."""
        if not tried:
            other.rewrite(lambda o: {"analyses": lifecycle.published(o["analyses"], chosen, F.lit(day(5)))})
        tried.append(1)
        return {"analyses": lifecycle.published(t["analyses"], chosen, F.lit(day(6)))}

    tables.rewrite(slow)
    assert len(tried) == 2 and tables.read("analyses").where("analysis_id = 3").first().published_at == day(5)
    with pytest.raises(Conflict):
        tables._committed(tables.version(), {})
    count = tables.read("analyses").count()
    assert tables.clean() > 0 and tables.read("analyses").count() == count and tables.clean() == 0


def test_retention_once_for_each_batch(spark, tmp_path):
    tables = made(spark, tmp_path / "t")
    now = F.lit(day(3))
    want = [rows(x) for x in lifecycle.retention(*(tables.read(t) for t in retention.TABLES), now)]
    real = tables._committed
    tables._committed = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    before = contents(tables)
    with pytest.raises(RuntimeError):
        retention.cleaned(tables, "job", 0, now)
    assert contents(tables) == before  # all tables were staged, none was changed
    tables._committed = real
    counts = retention.cleaned(tables, "job", 0, now)
    assert list(contents(tables).values()) == want and counts == {t: len(before[t]) - len(w) for t, w in zip(retention.TABLES, want)}
    version = tables.version()
    assert retention.cleaned(tables, "job", 0, F.lit(day(99))) is None and tables.version() == version
    assert list(contents(tables).values()) == want


def test_retention_as_a_stream(spark, tmp_path):
    tables = made(spark, tmp_path / "t")
    ticks = tmp_path / "ticks"
    schema = "at timestamp"
    for k in (1, 3):
        spark.createDataFrame([(day(k),)], schema).coalesce(1).write.parquet(str(ticks / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{ticks}/*")
    want = [rows(x) for x in lifecycle.retention(*(tables.read(t) for t in retention.TABLES), F.lit(day(3)))]
    retention.retention_job(source, tables, str(tmp_path / "check")).awaitTermination()
    assert list(contents(tables).values()) == want and tables.state()["notes"] == {"retention": 1}
    retention.retention_job(source, tables, str(tmp_path / "check")).awaitTermination()
    assert tables.state()["notes"] == {"retention": 1}


def test_reuse_over_buckets_has_no_exchange(spark):
    when = F.timestamp_seconds(F.col("id"))
    reports = spark.range(4000).select(F.col("id").alias("analysis_id"), F.lit("completed").alias("state"), (F.col("id") % 50).cast("string").alias("owner"), when.alias("updated_at"), F.timestamp_seconds(F.col("id") + 10**9).alias("expires_at"), when.alias("published_at"), F.sha1(F.col("id").cast("string")).alias("public_slug"), (F.col("id") % 40).alias("setting"), F.when(F.col("id") % 8 == 0, "10.1/x").alias("doi"), *(F.lit(None).cast("string").alias(c) for c in ("arxiv_id", "pmid", "pmcid")))
    requests = spark.range(300).select(F.col("id").alias("request_id"), (F.col("id") % 60).cast("string").alias("caller"), (F.col("id") % 45).alias("setting"))
    key = compatibility_key(["setting"])
    bucketed_reports(reports, "reports_by_key", key, 4)
    bucketed_reports(requests.withColumn("public_slug", F.lit(None).cast("string")), "requests_by_key", key, 4)
    now = F.timestamp_seconds(F.lit(5))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = lifecycle.reusable(spark.table("requests_by_key"), spark.table("reports_by_key"), None, now)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") >= 3
        assert rows(got) == rows(lifecycle.reusable(requests, reports, ["setting"], now))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_slug_lookup_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "slugs")
    rows_ = spark.range(200_000).select("id", F.sha1(F.col("id").cast("string")).alias("public_slug"))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 4096)
    rows_.coalesce(1).write.option("parquet.bloom.filter.enabled#public_slug", "true").option("parquet.bloom.filter.expected.ndv#public_slug", "20000").option("parquet.block.size", 1_000_000).option("parquet.enable.dictionary", "false").parquet(path)

    def scanned(slug):
        df = spark.read.parquet(path).where(F.col("public_slug") == slug)
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        if "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
            while plan.children().size():
                plan = plan.children().head()
        return found, plan.metrics().apply("numOutputRows").value()

    import hashlib

    found, n = scanned(hashlib.sha1(b"77777").hexdigest())
    assert [r.id for r in found] == [77777] and 0 < n < 100_000
    found, n = scanned(hashlib.sha1(b"none").hexdigest())
    assert found == [] and n < 100_000
