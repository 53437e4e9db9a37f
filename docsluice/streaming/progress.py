"""Progress events as streams: event time is `at`, late events are held back by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What may follow what; an analysis that has ended stays so.
ENDED = ("completed", "failed", "cancelled")
STATE_RANK = {"queued": 0, "running": 1, "completed": 2, "failed": 2, "cancelled": 2}


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of events below a path, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts_by_day(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling days: events and their mean value by kind."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "kind", "n", "value")


def rolling_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Sliding 24 hours, each hour: events of an owner (what a daily quota counts)."""
    return events.withWatermark("at", late).groupBy(F.window("at", "24 hours", "1 hour").alias("w"), "owner").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "owner", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of an owner's events without a longer pause."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "owner").agg(F.count("*").alias("n")).select("owner", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def analysis_states(events: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """(analysis_id, state, progress, at) after each batch of events(analysis_id, at, state, progress).

    Progress never falls and nothing follows an end; an analysis without events for the timeout
    after the watermark has failed.
    """
    late_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            name, progress, at = state.get
            state.remove()
            if name not in ENDED:
                yield pd.DataFrame({"analysis_id": [key[0]], "state": ["failed"], "progress": [progress], "at": [pd.Timestamp(at, unit="us")]})
            return
        name, progress, at = state.get if state.exists else ("queued", 0, 0)
        for rows in batches:
            for r in rows.sort_values("at").itertuples():
                if name not in ENDED:
                    name = r.state if STATE_RANK[r.state] >= STATE_RANK[name] else name
                    progress = max(progress, int(r.progress))
                    at = max(at, int(r.at.value // 1000))
        state.update((name, progress, at))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + late_ms)
        yield pd.DataFrame({"analysis_id": [key[0]], "state": [name], "progress": [progress], "at": [pd.Timestamp(at, unit="us")]})

    return events.withWatermark("at", "0 seconds").groupBy("analysis_id").applyInPandasWithState(advance, "analysis_id long, state string, progress int, at timestamp", "state string, progress int, at long", "update", GroupStateTimeout.EventTimeTimeout)
