"""Progress as state over several batches against the batch functions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from docsluice.operators import lifecycle
from docsluice.streaming import states

SCHEMA = "analysis_id long, pos long, kind string, state string"


@pytest.fixture
def rocksdb(spark):
    """Batches without data would go on for ever, as timers of the clock may always fire."""
    names = {"spark.sql.streaming.stateStore.providerClass": states.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def run(spark, folder, **settings):
    """All new files of a folder, a file a batch; the rows that came out, in order."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    batches = []
    q = states.progress_states(source, **settings).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(lambda df, n: batches.append([tuple(r) for r in df.collect()])).start()
    q.awaitTermination()
    return batches


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def made(r):
    rows = []
    for a in range(6):
        for pos in range(r.randrange(4, 25)):
            kind = r.choice(["stage", "module", "module", "note"])
            rows.append((a, pos, kind, r.choice(["running", "completed"]) if kind == "stage" else r.choice(["running", "completed", "failed", "skipped"])))
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_states_equal_batch_functions(rocksdb, tmp_path, shuffled):
    r = random.Random(4)
    rows = made(r)
    order = rows[:]
    if shuffled:
        r.shuffle(order)
    else:
        order.sort(key=lambda x: x[1])
    parts = [order[k : k + 40] for k in range(0, len(order), 40)]
    for k, part in enumerate(parts + [order[:5]]):  # some are delivered again
        put(rocksdb, tmp_path, f"{k:03d}", part)
    batches = run(rocksdb, tmp_path)
    assert len([b for b in batches if b]) >= 2
    last = {}
    for b in batches:
        for a, pos, kind, state, progress, _ in b:
            if not shuffled and (a, pos) in last:
                assert progress == last[a, pos][2]  # in order, progress of a row stands once it is told
            last[a, pos] = (kind, state, progress)
    events = rocksdb.createDataFrame(rows, SCHEMA)
    closed = {(x.analysis_id, x.pos): x.state for x in lifecycle.closed_stages(events).collect()}
    progress = {(x.analysis_id, x.pos): x.progress for x in lifecycle.module_progress(events).collect()}
    assert {k: v[1] for k, v in last.items()} == closed
    assert {k: v[2] for k, v in last.items()} == progress


def test_ends_stay_and_silence_fails(rocksdb, tmp_path):
    put(rocksdb, tmp_path, "0", [(1, -1, "analysis", "running"), (1, 0, "stage", "running"), (2, -1, "analysis", "running"), (2, 0, "stage", "running")])
    put(rocksdb, tmp_path, "1", [(1, -2, "analysis", "completed"), (1, -3, "analysis", "running"), (1, 1, "stage", "completed")])
    first = [x for b in run(rocksdb, tmp_path, timeout_ms=2_000) for x in b]
    assert [x[5] for x in first if x[0] == 1][-1] == "completed"
    time.sleep(2.5)
    put(rocksdb, tmp_path, "2", [(1, 2, "note", "x"), (3, 0, "stage", "running")])
    put(rocksdb, tmp_path, "3", [(3, 1, "stage", "running")])
    later = [x for b in run(rocksdb, tmp_path, timeout_ms=2_000) for x in b]
    assert (2, None, "analysis", "failed", None, "failed") in first + later
    assert {x[5] for x in later if x[0] == 1} == {"completed"}


def test_state_goes_by_its_time_to_live(rocksdb, tmp_path):
    put(rocksdb, tmp_path, "0", [(1, 0, "stage", "running"), (1, 5, "module", "completed")])
    run(rocksdb, tmp_path, ttl_ms=1_000)
    time.sleep(1.5)
    put(rocksdb, tmp_path, "1", [(1, 0, "stage", "running")])
    again = [x for b in run(rocksdb, tmp_path, ttl_ms=1_000) for x in b if x[1] is not None]
    assert again == [(1, 0, "stage", "running", 35, "queued")]  # as if it were new: nothing is left of the first events
