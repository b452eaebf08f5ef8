"""Task lifecycles as a stateful stream: events in event-time order, retries, time-outs and running figures.

Each task keeps its status, the time it spent in each status and the events that the watermark
hasn't passed yet, and timers bring it back when it does. So the order in which events arrive within
the watermark's delay changes nothing, and a replay in any number of micro-batches ends as one over
all events at once.

State is kept by groups of tasks (applyInPandasWithState), as each access to a state costs far more than a task's
events do; or by task (transformWithState), where micro-batches are small beside the tasks known.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship
from .tasks import TERMINAL

FACTS = ("status", "attempts", "events", "failures", "at", "step", "running_us", "queued_us")  # of a task; at: its last event's or its end's microsecond
BLANK = ("new", 0, 0, 0, -1, 0, 0, 0)
MOVED = "task_id long, status string, attempts int, events long, failures long, running_us long, queued_us long, at long, step long"
OUTPUT = "task_id long, status string, attempts int, events long, failures long, running_us long, queued_us long, updated_at timestamp, step long"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def fold(task: tuple, ready: Iterable[tuple], watermark_us: int, retries: int, timeout_us: int) -> tuple:
    """A task's FACTS after events (ts, event_id, status) that the watermark has passed, in order, and after the silence since."""
    status, attempts, events, failures, at, step, running, queued = task
    spent = {"running": running, "queued": queued}

    def leave(until: int) -> None:
        """The time in the status that ends."""
        if status in spent and at >= 0 and until > at:
            spent[status] += until - at

    for ts, _, now in ready:
        if status in TERMINAL:
            break
        if 0 <= at and ts - at > timeout_us:
            leave(at + timeout_us)
            status, at, step = "timeout", at + timeout_us, step + 1
            break
        leave(ts)
        events, step = events + 1, step + 1
        attempts += now == "running"
        failures += now == "failed"
        status = "queued" if now == "failed" and attempts <= retries else now
        at = ts
    if status not in TERMINAL and 0 <= at and at + timeout_us < watermark_us:
        leave(at + timeout_us)
        status, at, step = "timeout", at + timeout_us, step + 1
    return status, attempts, events, failures, at, step, spent["running"], spent["queued"]


def _rows(tasks: list[tuple]):
    """The rows (MOVED) of tasks, each a task_id and FACTS."""
    import pandas as pd

    return pd.DataFrame(tasks, columns=["task_id", *FACTS])[["task_id", "status", "attempts", "events", "failures", "running_us", "queued_us", "at", "step"]]


class Lifecycle(StatefulProcessor):
    """Folds the events of one task. retries: how often a failed task is queued again; timeout_ms: silence after which a task is given up."""

    def __init__(self, retries: int, timeout_ms: int) -> None:
        self.retries, self.timeout_us = retries, timeout_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a task, timer and waiting events included: every access to state is a message to the JVM
        self.state = handle.getValueState("state", "status string, attempts int, events long, failures long, at long, step long, running_us long, queued_us long, timer long, pending array<struct<ts: long, event_id: long, status: string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        new: list[tuple] = []
        for batch in rows:
            new += zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["status"].tolist(), strict=True)
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key: tuple, new: list[tuple], watermark_us: int) -> Iterator:
        """Takes the waiting events that the watermark has passed, in order; gives the task's row if anything changed."""
        had = self.state.get()
        *task, timer, pending = had or (*BLANK, -1, [])
        waiting = sorted([*map(tuple, pending), *new])
        ready = [e for e in waiting if e[0] <= watermark_us]
        moved = fold(tuple(task), ready, watermark_us, self.retries, self.timeout_us)
        status, at = moved[0], moved[4]
        rest = [] if status in TERMINAL else waiting[len(ready) :]
        again = self._again(rest, status, at, watermark_us)
        if timer >= 0 and timer != again:
            self.handle.deleteTimer(timer)
        # one that has gone off is there no longer, nor does the next lie before the watermark
        if again >= 0 and timer != again:
            self.handle.registerTimer(again)
        state = (*moved, again, rest)
        if had is None or state != (*had[:9], list(map(tuple, pending))):
            self.state.update(state)
        if moved[5] > task[5]:
            yield _rows([(key[0], *moved)])

    def _again(self, rest: list, status: str, at: int, watermark_us: int) -> int:
        """The next moment, in milliseconds, at which the watermark has something to do for the task; -1 for none."""
        when = [rest[0][0]] if rest else []
        if status not in TERMINAL and at >= 0:
            when.append(at + self.timeout_us + 1)
        return max(-(-min(when) // 1000), watermark_us // 1000 + 1) if when else -1


def _unpacked(packed: bytes | None):
    import pyarrow as pa

    return pa.ipc.open_stream(packed).read_all() if packed else None


def _tuples(table) -> list[tuple]:
    """A table's rows by way of numpy, which takes an eighth of to_pylist's time but makes numbers beside nulls floats."""
    return list(zip(*(c.to_pylist() if c.null_count else c.to_numpy().tolist() for c in table.columns), strict=True))


def _packed(table) -> bytes | None:
    """An Arrow stream of a table, which the state holds as one value; nothing for no rows."""
    import pyarrow as pa

    if not table.num_rows:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class Group:
    """Tasks that share a state: the FACTS of each, and the events that wait, (task_id, ts, event_id, status)."""

    STATE = "tasks binary, waiting binary"

    def __init__(self, tasks: bytes | None = None, waiting: bytes | None = None) -> None:
        import pyarrow as pa

        whole = pa.int64()
        self.kept = pa.schema([("task_id", whole), *((c, pa.string() if c == "status" else whole) for c in FACTS)])
        self.tasks = {f[0]: f[1:] for f in _tuples(_unpacked(tasks))} if tasks else {}
        events = pa.schema([("task_id", whole), ("ts", whole), ("event_id", whole), ("status", pa.string())])
        self.waiting = _unpacked(waiting) if waiting else events.empty_table()

    def add(self, rows) -> None:
        """Takes new events as waiting. rows: pandas, with task_id, at (microseconds), event_id and status."""
        import pyarrow as pa

        new = [pa.Array.from_pandas(rows[c], type=f.type) for c, f in zip(("task_id", "at", "event_id", "status"), self.waiting.schema, strict=True)]
        self.waiting = pa.concat_tables([self.waiting, pa.table(new, schema=self.waiting.schema)])

    def advance(self, watermark_us: int, retries: int, timeout_us: int) -> list[tuple]:
        """Takes the waiting events that the watermark has passed, in order; gives the tasks that have moved on, each a task_id and FACTS."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        passed = pc.less_equal(self.waiting["ts"], watermark_us)
        ready = self.waiting.filter(passed).sort_by([(c, "ascending") for c in self.waiting.column_names])
        events: dict[int, list] = {t: [] for t, f in self.tasks.items() if f[0] not in TERMINAL and 0 <= f[4] < watermark_us - timeout_us}
        of, waited = ready["task_id"].to_numpy(), _tuples(ready.drop_columns("task_id"))
        starts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1)).tolist()
        for start, end in pairwise([*starts, len(waited)]):
            events[int(of[start])] = waited[start:end]
        moved = []
        for t, es in events.items():
            before = self.tasks.get(t, BLANK)
            self.tasks[t] = now = fold(before, es, watermark_us, retries, timeout_us)
            if now[5] > before[5]:
                moved.append((t, *now))
        ended = pa.array([t for t, f in self.tasks.items() if f[0] in TERMINAL], pa.int64())
        rest = self.waiting.filter(pc.invert(passed))
        self.waiting = rest.filter(pc.invert(pc.is_in(rest["task_id"], ended)))
        return moved

    def again(self, watermark_us: int, timeout_us: int) -> int | None:
        """The millisecond beyond which the watermark has something to do for any of the tasks."""
        import pyarrow.compute as pc

        when = [f[4] + timeout_us + 1 for f in self.tasks.values() if f[0] not in TERMINAL and f[4] >= 0]
        if self.waiting.num_rows:
            when.append(pc.min(self.waiting["ts"]).as_py())
        return max(-(-min(when) // 1000) - 1, watermark_us // 1000, 1) if when else None

    def packed(self) -> tuple[bytes | None, bytes | None]:
        import pyarrow as pa

        columns = zip(*((t, *f) for t, f in self.tasks.items()), strict=True) if self.tasks else [()] * len(self.kept)
        return _packed(pa.table([pa.array(v, f.type) for v, f in zip(columns, self.kept, strict=True)], schema=self.kept)), _packed(self.waiting)


def _grouped(rows: DataFrame, groups: int, retries: int, timeout_ms: int) -> DataFrame:
    timeout_us = timeout_ms * 1000

    def advance(key, batches: Iterator, state) -> Iterator:
        group = Group(*(state.get if state.exists else ()))
        if not state.hasTimedOut:
            for batch in batches:
                group.add(batch)
        watermark_us = state.getCurrentWatermarkMs() * 1000
        moved = group.advance(watermark_us, retries, timeout_us)
        state.update(group.packed())
        again = group.again(watermark_us, timeout_us)
        if again is not None:
            state.setTimeoutTimestamp(again)
        if moved:
            yield _rows(moved)

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("task_id"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandasWithState(advance, MOVED, Group.STATE, "update", "EventTimeTimeout")


def groups_for(events: int) -> int:
    """Groups for so many events in all, some 16,000 each: few enough to cost little, and none grows with the table."""
    return max(256, events // 16_384)


@contextmanager
def _state_store(spark: SparkSession):
    """State with several variables and timers needs the store on disk; the session's own setting returns when the query has begun."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def lifecycle_stream(events: DataFrame, delay: str = "10 minutes", retries: int = 3, timeout_ms: int = 86_400_000, groups: int | None = 1024) -> DataFrame:
    """The stream of every task's row (OUTPUT) after each time that it moves on; step tells a task's rows apart, the last is its present.

    events: task_id, ts, event_id, status; order is (ts, event_id). A failed task is queued
    again while it has run no more than `retries` times; a terminal task takes no further event; one
    that hears nothing for timeout_ms is given up. Events that come later than the watermark's
    delay are dropped, those it hasn't passed yet wait. groups: in how many states tasks are kept,
    each rewritten by a micro-batch that has events of any of its tasks; None: one for each task. A
    checkpoint goes on with the groups that it began with only.
    """
    ship(events.sparkSession)
    at = F.col("ts").cast("timestamp")
    rows = events.select(F.col("task_id").cast("long"), at.alias("ts"), F.unix_micros(at).alias("at"), F.col("event_id").cast("long"), "status").where("task_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", delay)
    if groups is None:
        moved = rows.groupBy("task_id").transformWithStateInPandas(Lifecycle(retries, timeout_ms), MOVED, "Update", "EventTime")
    else:
        moved = _grouped(rows, groups, retries, timeout_ms)
    return moved.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "updated_at")


def replay(stream: DataFrame, folder: str) -> None:
    """Runs a lifecycle stream over what there is now; each micro-batch writes a folder of its own, which a repeated one replaces."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with _state_store(spark):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()


def present(spark: SparkSession, folder: str) -> DataFrame:
    """Each task's last row of those that replay wrote."""
    rows = spark.read.schema(OUTPUT).parquet(f"{folder}/rows")
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in ("task_id", "batch"))), "step").alias("r")
    return rows.groupBy("task_id").agg(last).select("task_id", "r.*")
