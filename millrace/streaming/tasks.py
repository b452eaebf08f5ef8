"""Task lifecycle: the same transitions as a batch query and as a streaming one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled", "timeout")
PROGRESS = {"queued": 0.0, "running": 50.0, "completed": 100.0}


def current_state(events: DataFrame) -> DataFrame:
    """Each task's last event. events: task_id, ts, event_id, status; order is (ts, event_id)."""
    order = F.struct("ts", "event_id")
    return events.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"),
        F.count("*").alias("events"), F.sum((F.col("status") == "failed").cast("long")).alias("failures"),
    )


def queue_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def latest_results(results: DataFrame) -> DataFrame:
    """Each task's newest result. results: task_id, ts, event_id, value."""
    return results.groupBy("task_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("modified"))


def running_stats(events: DataFrame) -> DataFrame:
    """Counts of ended tasks and their mean and greatest duration, of a table or of a stream
    (in complete mode). events: status, duration."""
    done = F.col("status") == "completed"
    return events.where(F.col("status").isin(*TERMINAL)).agg(
        F.count("*").alias("processed"), F.coalesce(F.sum(done.cast("long")), F.lit(0)).alias("completed"),
        F.coalesce(F.sum((F.col("status") == "failed").cast("long")), F.lit(0)).alias("failed"),
        F.avg(F.when(done, F.col("duration"))).alias("avg_duration"), F.max("duration").alias("peak_duration"),
    )


def with_analyses(state: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every task's state with what is stored of its analysis, if anything is."""
    info = analyses.select(F.col("analysis_id").alias("task_id"), "repo_name", "risk_level")
    return state.join(info, "task_id", "left")


def stale(state: DataFrame, now, hours: int = 24) -> DataFrame:
    """Ended tasks that nothing has touched for so many hours before now, a time or a column."""
    now = now if isinstance(now, Column) else F.lit(now)
    old = F.col("updated_at") <= now.cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return state.where(F.col("status").isin(*TERMINAL) & old)


def in_priority_order(queued: DataFrame) -> DataFrame:
    """Clamped priority (1 to 10) first, then age."""
    return queued.withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(10), "priority"))).orderBy("priority", "created_at", "task_id")


def state_stream(events: DataFrame, watermark: str = "1 day", retries: int = 3) -> DataFrame:
    """Streaming state machine: task_id, status, attempts, updated_at after each change.

    A failed task is queued again while retries are left; cancelling only reaches tasks that are
    queued or running; terminal tasks take no further events; a task that hears nothing for the
    watermark's length is given up as timeout and its state is dropped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    silence = _milliseconds(watermark)

    def step(key, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        status, attempts, at = state.get if state.exists else ("new", 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "status": ["timeout"], "attempts": [attempts], "updated_at": [pd.Timestamp(at, unit="us")]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows.itertuples():
            if status in TERMINAL or r.status == "cancelled" and status not in ("new", "queued", "running"):
                continue
            status = r.status
            if status == "running":
                attempts += 1
            if status == "failed" and attempts <= retries:
                status = "queued"
            at = int(pd.Timestamp(r.ts).value // 1000)
        if status in TERMINAL:
            state.remove()
        else:
            state.update((status, attempts, at))
            state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs() + 1) + silence)
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempts": [attempts], "updated_at": [pd.Timestamp(at, unit="us")]})

    rows = events.select("task_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status").withWatermark("ts", watermark)
    return rows.groupBy("task_id").applyInPandasWithState(
        step, "task_id long, status string, attempts int, updated_at timestamp", "status string, attempts int, at long",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


def _milliseconds(delay: str) -> int:
    number, unit = delay.split()
    each = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
    return int(float(number) * each[unit.rstrip("s")])


def write_results(stream: DataFrame, folder: str, checkpoint: str):
    """Writes each micro-batch's terminal tasks to a folder of its own under a Parquet folder, partitioned
    by batch; a batch that is replayed replaces what it wrote."""

    def save(batch: DataFrame, number: int) -> None:
        batch.where(F.col("status").isin(*TERMINAL)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
