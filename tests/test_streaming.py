"""The stream functions over files that arrive one after the other."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docsluice.streaming import progress

DATA = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def event_files(spark, path):
    e = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").alias("owner"), "value", "event_id")
    days = [r[0] for r in e.select(F.to_date("at")).distinct().orderBy(F.to_date("at")).collect()]
    for k, day in enumerate(days[:6]):
        e.where(F.to_date("at") == day).coalesce(1).write.parquet(f"{path}/{k}")
    return days[:6]


def test_windows_of_a_stream(spark, tmp_path):
    days = event_files(spark, tmp_path)
    schema = "at timestamp, kind string, owner long, value double, event_id long"
    whole = spark.read.schema(schema).parquet(f"{tmp_path}/*")
    source = progress.event_stream(spark, f"{tmp_path}/*", schema, 1)
    got = run(progress.counts_by_day(source), "daily").toPandas()
    want = progress.counts_by_day(whole).toPandas()
    closed = want[want.day < pd.Timestamp(days[-1])]
    assert sorted(map(tuple, got[["day", "kind", "n"]].values.tolist())) == sorted(map(tuple, closed[["day", "kind", "n"]].values.tolist()))
    assert run(progress.sessions(source), "runs").count() > 0
    doubled = whole.union(whole).coalesce(1)
    doubled.write.parquet(str(tmp_path / "again"))
    assert run(progress.distinct_events(progress.event_stream(spark, str(tmp_path / "again"), schema), ["event_id"]), "once").count() == whole.count()


def test_states_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "queued", 0), (1, "2024-01-01 00:01:00", "running", 42), (1, "2024-01-01 00:02:00", "running", 40), (2, "2024-01-01 00:00:30", "running", 10)]
    later = [(1, "2024-01-01 00:03:00", "completed", 100), (1, "2024-01-01 00:04:00", "running", 50), (3, "2024-01-01 04:00:00", "queued", 0)]
    last = [(3, "2024-01-01 04:00:10", "running", 1)]
    for k, part in enumerate((rows, later, last)):
        spark.createDataFrame(part, "analysis_id long, at string, state string, progress int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / str(k)))
    source = progress.event_stream(spark, f"{tmp_path}/*", "analysis_id long, at timestamp, state string, progress int", 1)
    out = run(progress.analysis_states(source), "states", "update").toPandas()
    one = out[out.analysis_id == 1]
    assert one.iloc[-1].state == "completed" and one.progress.is_monotonic_increasing and one.iloc[0].progress == 42
    assert "failed" in set(out[out.analysis_id == 2].state)
