"""Structured Streaming forms of the change detectors."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from siltstone.operators.store import Table

#: Seconds of quiet after which changes are flushed, hot and cold; of git events; until a project is idle; of heat after activity.
DEBOUNCE_SECONDS, COLD_FACTOR, GIT_SECONDS, IDLE_SECONDS, HOT_SECONDS = 1.5, 5, 0.3, 300, 60
#: How late an event may come.
LATENESS = "10 minutes"


def read_events(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of event files."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _timed(events: DataFrame, time: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATENESS)


def debounce(events: DataFrame, by: list[str], seconds: float = DEBOUNCE_SECONDS, time: str = "ts") -> DataFrame:
    """One row per run of changes: group, first_at, last_at, n_events, paths."""
    w = F.session_window(F.col(time), f"{int(seconds * 1000)} milliseconds")
    return _timed(events, time).groupBy(*by, w.alias("w")).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n_events")).drop("w")


def idle(events: DataFrame, by: list[str], seconds: int = IDLE_SECONDS, time: str = "ts") -> DataFrame:
    """group, fires_at of a timer that each event sets back."""
    w = F.session_window(F.col(time), f"{seconds} seconds")
    return _timed(events, time).groupBy(*by, w.alias("w")).agg(F.max(time).alias("__last")).select(*by, (F.col("__last") + F.make_dt_interval(secs=F.lit(seconds))).alias("fires_at"))


def activity(events: DataFrame, by: list[str], time: str = "ts", segment_seconds: int = 3600) -> DataFrame:
    """group, segment and peak value of fixed segments."""
    w = F.window(F.col(time), f"{segment_seconds} seconds")
    return _timed(events, time).groupBy(*by, w.alias("w")).agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("segment"), "peak", "n")


def rebuild_marks(adds: DataFrame) -> DataFrame:
    """table_name, seq, pending, due: the rebuild cadence as a stateful fold of a stream of runs."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            pending += int(r.added)
            due = bool(r.full) or pending >= max(1000, int(r.total * 0.2))
            out.append((key[0], int(r.seq), pending, due))
            pending = 0 if due else pending
        state.update((pending,))
        yield pd.DataFrame(out, columns=["table_name", "seq", "pending", "due"])

    return adds.groupBy("table_name").applyInPandasWithState(fold, "table_name string, seq long, pending long, due boolean", "pending long", "append", GroupStateTimeout.NoTimeout)


def branch_switches(events: DataFrame) -> DataFrame:
    """project_id, ts, branch, previous for each event on another branch than the project's last one."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            if last is not None and r.branch != last:
                out.append((key[0], r.ts, r.branch, last))
            last = r.branch
        state.update((last,))
        yield pd.DataFrame(out, columns=["project_id", "ts", "branch", "previous"])

    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("project_id").applyInPandasWithState(fold, "project_id string, ts timestamp, branch string, previous string", "branch string", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what is there and stop; ``each`` gets every micro-batch and may be called again for one after a failure."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def into_table(stream: DataFrame, table: Table, checkpoint: str, name: str, part: str = "", key: str | None = None) -> None:
    """Add a stream's micro-batches to a part of a table (merged on ``key`` where one is given) and stop when all that is there was read.

    The manifest that takes a batch in also names it, so a batch that is handed
    over again after a failure is added once.
    """
    mark = f"stream:{name}"

    def each(rows: DataFrame, batch: int) -> None:
        if batch <= (table.latest() or {}).get(mark, -1):
            return
        if key is None:
            table.append(rows, part, **{mark: batch})
        else:
            table.upsert(rows, key, part, **{mark: batch})
        table.tidy()

    run_available(stream, checkpoint, each)


class EventLog:
    """Job and change events as JSON lines in files by time; the oldest files go when there are too many."""

    def __init__(self, spark: SparkSession, root: str, schema: str = "ts long, level string, event string, project_id string, detail string", keep_files: int = 100):
        self.spark, self.root, self.schema, self.keep_files = spark, root.rstrip("/"), schema, keep_files
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self) -> list[str]:
        at = self._jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if f.getPath().getName().endswith(".json")) if self._fs.exists(at) else []

    def write(self, events: list[dict]) -> None:
        """One new file; a reader never sees part of a line, and a stream over the folder gets each file once."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        hidden, shown = (self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}") for n in (f"_{name}", f"{name}.json"))
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in events).encode()))
        finally:
            out.close()
        self._fs.rename(hidden, shown)
        for old in self._files()[: -self.keep_files]:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{old}"), False)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.root) if self._files() else self.spark.createDataFrame([], self.schema)

    def stream(self) -> DataFrame:
        return read_events(self.spark, self.root, self.schema, "json")
