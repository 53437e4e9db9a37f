"""Progress of analyses as state: stages close, progress never falls, and what has ended goes by its time to live.

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # where a query is to end (availableNow)
    progress_states(events).writeStream.outputMode("update")...

Events carry their place (pos) in their analysis. What comes out does not depend on the order in which
they arrive, in one batch or in several: an event that changes what was said of others brings these
again, and the last row of an (analysis_id, pos) holds. Those rows are the ones that
lifecycle.closed_stages and lifecycle.module_progress give for all events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What may follow what; an analysis that has ended stays so.
ENDED = ("completed", "failed", "cancelled")
STATE_RANK = {"queued": 0, "running": 1, "completed": 2, "failed": 2, "cancelled": 2}
MODULE_ENDS = ("completed", "failed", "skipped")
OUT = "analysis_id long, pos long, kind string, state string, progress int, analysis_state string"


class Progress(StatefulProcessor):
    """Per analysis: its state (value), its events by place (map), the places of modules' ends (list), and a timer."""

    def __init__(self, modules: int, low: int, span: int, timeout_ms: int, ttl_ms: int):
        self.modules, self.low, self.span, self.timeout_ms, self.ttl_ms = modules, low, span, timeout_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "state string, last long, timer long", self.ttl_ms)
        self.events = handle.getMapState("events", "pos long", "kind string, state string, shown string, progress int", self.ttl_ms)
        self.ends = handle.getListState("ends", "pos long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, last, timer = self.life.get() if self.life.exists() else ("queued", -1, None)
        known = {k[0]: tuple(v) for k, v in self.events.iterator()}
        ends = [e[0] for e in self.ends.get()] if self.ends.exists() else []
        new_ends = []
        for r in rows:
            if r["kind"] == "analysis":  # a word about the whole
                if state not in ENDED and STATE_RANK.get(r["state"], -1) >= STATE_RANK[state]:
                    state = r["state"]
                continue
            if r["pos"] not in known:  # an event that is delivered again says nothing new
                known[r["pos"]] = (r["kind"], r["state"], None, None)
                if r["kind"] == "module" and r["state"] in MODULE_ENDS:
                    new_ends.append(r["pos"])
                if r["kind"] == "stage":
                    last = max(last, r["pos"])
        ends += new_ends
        done, out = 0, []
        for pos in sorted(known):
            kind, own, shown, progress = known[pos]
            done += pos in ends
            now = "completed" if kind == "stage" and own == "running" and pos < last else own
            new = self.low + round(min(done, self.modules) / self.modules * self.span)
            if (now, new) != (shown, progress):
                self.events.updateValue((pos,), (kind, own, now, new))
                out.append(Row(analysis_id=key[0], pos=pos, kind=kind, state=now, progress=new, analysis_state=state))
        if new_ends:
            self.ends.appendList([(p,) for p in new_ends])
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None if state in ENDED else timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        if timer is not None:
            self.handle.registerTimer(timer)
        self.life.update((state, last, timer))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """An analysis without any event for the timeout has failed."""
        if self.life.exists():
            state, last, _ = self.life.get()
            if state not in ENDED:
                self.life.update(("failed", last, None))
                yield Row(analysis_id=key[0], pos=None, kind="analysis", state="failed", progress=None, analysis_state="failed")

    def close(self) -> None:
        pass


def progress_states(events: DataFrame, modules: int = 5, low: int = 35, span: int = 33, timeout_ms: int = 3_600_000, ttl_ms: int = 86_400_000) -> DataFrame:
    """events(analysis_id, pos, kind, state) as a stream to their rows with closed stages and progress, as updates.

    Events of kind 'analysis' tell the state of the whole; it never goes back, and nothing follows
    an end. State that no event has touched for ttl_ms is dropped.
    """
    processor = Progress(modules, low, span, timeout_ms, ttl_ms)
    return events.select("analysis_id", "pos", "kind", "state").groupBy("analysis_id").transformWithState(statefulProcessor=processor, outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")
