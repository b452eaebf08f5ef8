"""What the fourth round's finding was about."""

import itertools
import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import lifecycle
from pyspark.sql import functions as F

SCHEMA = "task_id long, at long, event_id long, status string"


def test_many_tasks_share_few_states(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id AS task_id", "timestamp_seconds(1700000000 + id) AS ts", "id AS event_id", "'queued' AS status")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.lifecycle_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 minute")
    with lifecycle._state_store(spark):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("noop").start()
        query.awaitTermination()
    states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 256 <= max(states) <= 1024
    assert [lifecycle.groups_for(n) for n in (0, 100_000, 36_000_000)] == [256, 256, 2197]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_states_of_groups_and_of_tasks_give_the_same_rows(spark, tmp_path, zone):
    r, k, events = random.Random(4), itertools.count(), []
    for task in [*range(28), 2**60 + 1, -(2**60) - 1]:
        at = 1_700_000_000_000_000 + r.randint(0, 2000) * 1_000_000
        for _ in range(r.randint(1, 9)):
            events.append((task, at, next(k), r.choices(["queued", "running", "failed", "completed", "cancelled", "paused"], [2, 4, 4, 1, 1, 1])[0]))
            at += r.choice([1, 5_000_000, 60_000_001, 300_000_000, 900_000_000])
    events.sort(key=lambda e: e[1])
    last = events[-1][1] // 1000 * 1000 - 200_000_000  # the last watermark: one event on it, one a microsecond behind
    events[-1:-1] = [(100, last, next(k), "queued"), (101, last + 1, next(k), "queued")]
    size = -(-len(events) // 4)
    for i in range(4):
        block = events[i * size : (i + 1) * size]
        r.shuffle(block)
        spark.createDataFrame(block, SCHEMA).select("task_id", F.timestamp_micros("at").alias("ts"), "event_id", "status").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    kinds, got = spark.read.parquet(f"{tmp_path}/in/0").schema, {}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for groups in (None, 1, 5):
            stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            lifecycle.replay(lifecycle.lifecycle_stream(stream, "200 seconds", 2, 600_000, groups), f"{tmp_path}/{groups}")
            rows = lifecycle.present(spark, f"{tmp_path}/{groups}").withColumn("updated_at", F.unix_micros("updated_at"))
            got[groups] = {x.task_id: x.asDict() for x in rows.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got[1] == got[5] == got[None] and got[1] == folded(events, last)
    assert got[1][100]["status"] == "queued" and 101 not in got[1] and 2**60 + 1 in got[1]


def folded(events, watermark):
    """The same by the rules, over all events at once."""
    out = {}
    for task in {e[0] for e in events}:
        ready = sorted(e[1:] for e in events if e[0] == task and e[1] <= watermark)
        if ready:
            out[task] = {"task_id": task, **dict(zip(lifecycle.FACTS, lifecycle.fold(lifecycle.BLANK, ready, watermark, 2, 600_000_000), strict=True))}
            out[task]["updated_at"] = out[task].pop("at")
    return out


def test_a_group_forgets_the_events_of_ended_tasks_and_says_when_it_has_work():
    import pandas as pd

    group = lifecycle.Group()
    group.add(pd.DataFrame([(1, 5_000_000, 3, "completed"), (1, 9_000_000, 4, "running"), (2, 7_000_000, 5, "queued")], columns=["task_id", "at", "event_id", "status"]))
    assert group.advance(4_000_000, 3, 10_000_000) == [] and group.again(4_000_000, 10_000_000) == 4999
    group = lifecycle.Group(*group.packed())
    assert group.advance(5_000_000, 3, 10_000_000) == [(1, "completed", 0, 1, 0, 5_000_000, 1, 0, 0)]
    assert group.waiting.num_rows == 1 and group.again(5_000_000, 10_000_000) == 6999
    group = lifecycle.Group(*group.packed())
    assert group.advance(20_000_000, 3, 10_000_000) == [(2, "timeout", 0, 1, 0, 17_000_000, 2, 0, 10_000_000)]
    assert group.again(20_000_000, 10_000_000) is None and group.packed()[1] is None and set(lifecycle.Group(*group.packed()).tasks) == {1, 2}
