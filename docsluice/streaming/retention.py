"""Retention as a job: a stream of ended analyses that works off what is there and stops.

Each batch rewrites analyses, documents and resolutions together (one commit of the stored tables), so a
crash leaves the state before or after it. The commit keeps the number of its batch: a batch that is
delivered again finds it and does nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import lifecycle
from ..sources.tables import StoredTables

TABLES = ("analyses", "documents", "resolutions")


def cleaned(tables: StoredTables, job: str, batch: int, now: Column, hours: int = lifecycle.DOCUMENT_HOURS) -> dict[str, int] | None:
    """What a batch dropped of each table; null where the batch was done before."""
    counts: dict[str, int] = {}
    if tables.state()["notes"].get(job, -1) >= batch:
        return None

    def change(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if tables.state()["notes"].get(job, -1) >= batch:
            return {}
        counts.update(dict(map(tuple, lifecycle.cleanup_counts(*(frames[t] for t in TABLES), now, hours).collect())))
        kept = lifecycle.retention(*(frames[t] for t in TABLES), now, hours)
        return {t: rows for t, rows in zip(TABLES, kept) if counts[t]}

    tables.rewrite(change, note=(job, batch))
    return counts


def retention_job(ticks: DataFrame, tables: StoredTables, checkpoint: str, job: str = "retention", at: str = "at") -> StreamingQuery:
    """Runs the clean-up for what a stream of ticks brings, as of each batch's latest tick; ends when all is done."""

    def batch(rows: DataFrame, number: int) -> None:
        last: datetime | None = rows.agg(F.max(at)).first()[0]
        if last is not None:
            cleaned(tables, job, number, F.lit(last))

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
