"""Streaming forms of the recurrences and counters. State is event-time and is dropped once it is as new.

``stateful`` runs the same classes as the batch operators over a stream; within a micro-batch a
key's events are put in order of time (a key's events of one micro-batch meet in one task, so the trigger's size bounds them). With a watermark, a key whose state has been idle for the
class's gap loses it by an event-time timeout.
"""

from __future__ import annotations

import pickle
import sys
from collections import deque
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.numbers import micros
from quarry.operators.folds import names


class Trailing:
    """Events of a key in the last ``seconds``."""

    fields = "recent long"

    def __init__(self, seconds: float):
        self.seconds, self.times = seconds, deque()

    def step(self, t: float) -> tuple:
        while self.times and self.times[0] <= t - self.seconds:
            self.times.popleft()
        self.times.append(t)
        return (len(self.times),)

    def gap(self) -> float:
        return self.seconds


class Transition:
    """Changes of a status, some passed over."""

    fields = "previous string, changed boolean"

    def __init__(self, ignored: tuple[str, ...] = ("pending",)):
        self.ignored, self.last = ignored, None

    def step(self, t: float, status: str) -> tuple:
        if status in self.ignored:
            return self.last, False
        before, self.last = self.last, status
        return before, before is not None and before != status

    def gap(self) -> None:
        return None


class Strikes:
    """Numbers a key's matches; from ``limit`` on they escalate."""

    fields = "strike long, escalates boolean"

    def __init__(self, limit: int):
        self.limit, self.count = limit, 0

    def step(self, t: float) -> tuple:
        self.count += 1
        return self.count, self.count >= self.limit

    def gap(self) -> None:
        return None


def stateful(events: DataFrame, keys: list[str], make, values: list[str] = (), ts: str = "ts", tie: str = "event_id", watermark: str | None = None) -> DataFrame:
    """events with the fields of a recurrence, in append mode."""
    fields, values = (make.func if isinstance(make, partial) else make).fields, list(values)
    columns, out = events.columns, names(fields)
    timed = watermark is not None and make().gap() is not None
    rows = events.withColumn("_at", micros(F.col(ts)))
    if timed:
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step = pickle.loads(state.get[0]) if state.exists else make()
        batch = pd.concat(list(frames)).sort_values(["_at", tie], kind="stable")
        made = [step.step(row[0] / 1e6, *row[1:]) for row in zip(*[batch[c].tolist() for c in ("_at", *values)], strict=True)]
        for name, column in zip(out, zip(*made, strict=True), strict=True):
            batch[name] = pd.Series(list(column), index=batch.index, dtype=object)
        state.update((cloudpickle.dumps(step),))
        if timed:
            at = int(batch["_at"].iloc[-1] / 1000 + step.gap() * 1000) + 1
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield batch[[*columns, *out]]

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", " + fields
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def window_counts(events: DataFrame, length: str, keys: list[str] = (), ts: str = "ts", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts; events later than ``late`` are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *keys).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def upsert_latest(stream: DataFrame, log, row_id: str, checkpoint: str):
    """Writes each micro-batch's newest row per key as new versions of a ChangeLog; returns the running query."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            log.put(rows.withColumnRenamed(row_id, "_row_id"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark, path: str, files: int = 1) -> DataFrame:
    """A Parquet table as a stream. The path is a pattern, as a table of one file is no folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


#: Bytes of a table that one state store takes, when a table at hand is replayed.
STATE_BYTES = 32 << 20


def replay_session(spark: SparkSession, path: str) -> SparkSession:
    """A session beside the caller's, whose shuffle partitions (a state store each, as long as the stream lives) fit the table's
    size: 8 at least, and no more than the caller's."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, -(-size // STATE_BYTES)))
    out.conf.set("spark.sql.shuffle.partitions", str(stores))
    return out


def drained(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream of the data at hand gives, as a Parquet table of the caller's session in a new folder; its checkpoint lies beside it."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    last: list[str] = []

    def replace(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last[:] = [f"{path}/batch={batch}"]

    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
