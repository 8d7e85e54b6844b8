"""Index jobs as rows of a versioned table: submitted, admitted, run, cancelled and pruned by the job operators."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maintenance, scheduling
from .store import WHOLE, Table

JOBS = "job_id long, task_no int, project_id string, source_id string, type string, mode string, branch string, status string, queued_at long, started_at long, finished_at long, error string, result string"


def now_ms() -> int:
    return int(time.time() * 1000)


class Jobs:
    """One row for each task of a job: a job of a project has a task for each source."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Table(spark, root)

    def rows(self) -> DataFrame:
        found = self.table.read()
        return self.spark.createDataFrame([], JOBS) if found is None else found

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        if self.table.rewrite(lambda rows: change(rows).select(*rows.columns).coalesce(1), WHOLE) is None:
            self.table.write(change(self.spark.createDataFrame([], JOBS)).coalesce(1))
        self.table.tidy()

    def submit(self, tasks: list[dict], kind: str = "reindex") -> dict:
        """Queue one job; a full queue refuses.  Tells the position and whether an earlier queued job asks for the same."""
        rows = self.rows()
        pending = rows.filter("status = 'queued'").select("job_id").distinct().count()
        if not scheduling.accept(pending):
            raise RuntimeError("the queue is full")
        job_id = (rows.agg(F.max("job_id")).first()[0] or 0) + 1
        at = now_ms()
        made = [(job_id, k, t["project_id"], t.get("source_id"), kind, t.get("mode", "incremental"), t.get("branch"), "queued", at, None, None, None, None) for k, t in enumerate(tasks)]
        new = self.spark.createDataFrame(made, JOBS)
        self._change(lambda old: old.unionByName(new))
        same = maintenance.duplicate_jobs(self.rows().fillna("", ["source_id", "branch"])).filter(F.col("job_id") == job_id)
        return {"job_id": job_id, "status": "queued", "queue_position": pending + 1, "duplicate_of_pending": not same.isEmpty()}

    def set(self, job_id: int, task_no: int | None = None, **fields) -> None:
        hit = (F.col("job_id") == job_id) & (F.lit(True) if task_no is None else F.col("task_no") == task_no)
        self._change(lambda rows: rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)).cast(rows.schema[k].dataType) for k, v in fields.items()}))

    def cancel(self, job_id: int, source_id: str | None = None) -> int:
        """Cancel what of a job is not over; the number of tasks."""
        hit = (F.col("job_id") == job_id) & F.col("status").isin("queued", "running") & (F.lit(True) if source_id is None else F.col("source_id") == source_id)
        n = self.rows().filter(hit).count()
        if n:
            self._change(lambda rows: rows.withColumn("finished_at", F.when(hit, now_ms()).otherwise(F.col("finished_at"))).withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))))
        return n

    def cancel_project(self, project_id: str) -> None:
        live = (F.col("project_id") == project_id) & F.col("status").isin("queued", "running")
        self._change(lambda rows: rows.withColumn("status", F.when(live, "cancelled").otherwise(F.col("status"))))

    def preempt_gc(self, project_id: str | None) -> None:
        self._change(lambda rows: maintenance.preempt_gc(rows, project_id))

    def reconcile(self, projects: DataFrame) -> None:
        """At start: what was live before is over."""
        self._change(lambda rows: maintenance.reconcile_jobs(rows, projects))

    def prune(self) -> None:
        self._change(lambda rows: maintenance.prune_jobs(rows, now_ms()))

    def status(self, job_id: int) -> dict:
        """The job's state, rolled up from its tasks, and the tasks."""
        tasks = [r.asDict() for r in self.rows().filter(F.col("job_id") == job_id).orderBy("task_no").collect()]
        if not tasks:
            raise KeyError(f"unknown job: {job_id}")
        live = {t["status"] for t in tasks} & {"queued", "running"}
        if live:
            state, error = ("running" if "running" in live or len({t["status"] for t in tasks}) > 1 else "queued"), None
        else:
            rolled = maintenance.job_rollup(self.spark.createDataFrame([(t["job_id"], t["task_no"], t["status"], t["error"]) for t in tasks], "job_id long, task_no int, status string, error string")).first()
            state, error = rolled["status"], rolled["error"]
            if state == "done" and any(t["status"] == "interrupted" for t in tasks):
                state = "interrupted"
        current = next((t["project_id"] for t in tasks if t["status"] == "running"), None)
        return {"job_id": job_id, "status": state, "tasks": tasks, "current_project": current, "error": error}

    def admitted(self, projects: DataFrame, slots: int) -> list[tuple[int, str]]:
        """(job_id, decision) of the queued jobs: which start, wait, or fail."""
        heads = self.rows().filter("status in ('queued', 'running')").groupBy("job_id").agg(F.min("project_id").alias("project_id"), F.min("queued_at").alias("queued_at"), F.max("status").alias("status"))
        return sorted((r["job_id"], r["decision"]) for r in scheduling.admit(heads, projects, slots).collect())
