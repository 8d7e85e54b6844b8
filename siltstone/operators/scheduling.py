"""Which queued jobs start, which sources are due for a poll, how long a failed one waits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Poll intervals in seconds, hot and idle; polls at once, over all and of one host; first and longest backoff.
HOT_S, IDLE_S, POLLS, POLLS_OF_HOST, BACKOFF_S, LONGEST_BACKOFF_S = 900, 3600, 2, 1, 30, 600
#: Queued jobs beyond which new ones are refused.
DEPTH = 1000


def admit(jobs: DataFrame, projects: DataFrame, slots: int) -> DataFrame:
    """job_id, decision of the queued jobs: start, wait, or fail where the project is gone.

    A project runs one job at a time; free slots go to projects in the order of
    their oldest queued job.
    """
    queued = jobs.filter("status = 'queued'").join(projects.select("project_id").distinct().withColumn("__known", F.lit(True)), "project_id", "left")
    busy = jobs.filter("status = 'running'").groupBy("project_id").agg(F.count(F.lit(1)).alias("__running"))
    first = F.row_number().over(Window.partitionBy("project_id").orderBy("queued_at", "job_id"))
    ready = queued.filter("__known").join(busy, "project_id", "left_anti").withColumn("__n", first).filter("__n = 1")
    used = busy.agg(F.coalesce(F.sum("__running"), F.lit(0)).alias("__used"))
    # One row per project stands in line; at most ``slots`` of them can start.
    line = ready.orderBy("queued_at", "job_id").limit(slots).select("job_id", "queued_at")
    placed = line.withColumn("__place", F.row_number().over(Window.orderBy("queued_at", "job_id"))).crossJoin(F.broadcast(used))
    start = placed.filter(F.col("__place") <= F.lit(slots) - F.col("__used")).select("job_id", F.lit(True).alias("__start"))
    decision = F.when(F.col("__known").isNull(), "fail").when(F.col("__start"), "start").otherwise("wait")
    return queued.join(start, "job_id", "left").select("job_id", decision.alias("decision"))


def accept(pending: int) -> bool:
    """Whether a queue of this depth takes another job."""
    return pending < DEPTH


def backoff_seconds(failures: Column) -> Column:
    """Doubling from the first wait up to the longest."""
    return F.least(F.lit(BACKOFF_S) * F.pow(F.lit(2), F.greatest(failures - 1, F.lit(0))), F.lit(LONGEST_BACKOFF_S)).cast("long")


def due_polls(sources: DataFrame, now: int) -> DataFrame:
    """source_id, host of the sources to poll now: due by interval and backoff, the longest waiting first, few at once.

    sources: source_id, host, hot, failures, last_poll_at (seconds).
    """
    wait = F.when(F.col("failures") > 0, backoff_seconds(F.col("failures"))).when(F.col("hot"), HOT_S).otherwise(IDLE_S)
    due = sources.withColumn("__since", F.coalesce("last_poll_at", F.lit(0))).filter(F.lit(now) - F.col("__since") >= wait)
    of_host = F.row_number().over(Window.partitionBy("host").orderBy("__since", "source_id"))
    return due.withColumn("__n", of_host).filter(F.col("__n") <= POLLS_OF_HOST).orderBy("__since", "source_id").limit(POLLS).select("source_id", "host")


class Fifo:
    """Builds one after the other, in the order asked for; what waits or is being built is not queued again."""

    def __init__(self, build: Callable[[str, bool], object]):
        self.build, self.waiting, self.forced, self.failed = build, [], set(), {}
        self._running: str | None = None

    def request(self, name: str, force: bool = False) -> bool:
        """Whether the name was queued; a force mark holds for the next build in any case."""
        if force:
            self.forced.add(name)
        if name in self.waiting or name == self._running:
            return False
        self.waiting.append(name)
        return True

    def run(self) -> list[str]:
        """Build all that waits; a failure is noted and the next one is built."""
        done: list[str] = []
        while self.waiting and self._running is None:
            self._running = self.waiting.pop(0)
            force = self._running in self.forced
            self.forced.discard(self._running)
            try:
                self.build(self._running, force)
                done.append(self._running)
            except Exception as e:  # noqa: BLE001
                self.failed[self._running] = str(e)
            finally:
                self._running = None
        return done


def heat(events: DataFrame, now: int, hot_seconds: int = 60) -> DataFrame:
    """project_id, hot: whether a project had an event in the last seconds.  events: project_id, at (seconds)."""
    return events.groupBy("project_id").agg((F.max("at") > now - hot_seconds).alias("hot"))
