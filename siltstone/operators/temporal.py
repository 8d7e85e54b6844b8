"""Operators on event times: sessions, nearest samples, span overlap, cadence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def sessions(events: DataFrame, gap_seconds: int, by: list[str], time: str = "ts") -> DataFrame:
    """group columns, first_at, last_at, n_events: runs of events less than the gap apart."""
    w = F.session_window(F.col(time), f"{gap_seconds} seconds")
    return events.groupBy(*by, w.alias("__w")).agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n_events")).drop("__w")


def idle_triggers(events: DataFrame, idle_seconds: int, by: list[str], time: str = "ts") -> DataFrame:
    """group columns, fires_at: a timer that every event sets back fires ``idle_seconds`` after the last of a run."""
    return sessions(events, idle_seconds, by, time).select(*by, (F.col("last_at") + F.make_dt_interval(secs=F.lit(idle_seconds))).alias("fires_at"))


#: Milliseconds without an event after which changes are flushed, times that for a cold project, of heat after an event, and until a project is idle.
QUIET_MS, COLD_FACTOR, HOT_MS, IDLE_MS = 1500, 5, 60_000, 300_000


def activity_timers(events: DataFrame, by: str, at: str = "at", quiet: int = QUIET_MS, factor: int = COLD_FACTOR, hot: int = HOT_MS, idle: int = IDLE_MS) -> DataFrame:
    """group, kind (hot, cold, flush, idle), at, n_events, first_at of events at milliseconds ``at``; see ``streaming.timers`` for what they mean.

    Events are dealt to time buckets of the longest reach, so a busy project is
    many tasks: only the nearest event of the neighbouring bucket can matter.
    Flushes are numbered by sums within buckets and over the buckets' totals.
    """
    reach = max(quiet * factor, hot, idle)
    ours = [by, "__b"]
    rows = events.groupBy(by, F.col(at).cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("__b", F.floor(F.col("at") / reach).cast("long"))
    order = Window.partitionBy(*ours).orderBy("at")
    edges = rows.groupBy(*ours).agg(F.min("at").alias("__first"), F.max("at").alias("__last"))
    earlier, later = edges.select(by, (F.col("__b") + 1).alias("__b"), F.col("__last").alias("__before")), edges.select(by, (F.col("__b") - 1).alias("__b"), F.col("__first").alias("__after"))
    near = rows.join(earlier, ours, "left").join(later, ours, "left")
    near = near.withColumn("__before", F.coalesce(F.lag("at").over(order), "__before")).withColumn("__after", F.coalesce(F.lead("at").over(order), "__after"))
    warm = F.coalesce(F.col("at") < F.col("__before") + hot, F.lit(False))
    alone = lambda due: F.col("__after").isNull() | (F.col("__after") >= due)
    near = near.withColumn("__warm", warm).withColumn("__due", F.col("at") + F.when(F.col("__warm") | (F.col("n") > 1), quiet).otherwise(quiet * factor))
    near = near.withColumn("__ends", alone(F.col("__due")).cast("long"))
    near = near.withColumn("__no", F.sum("__ends").over(order) - F.col("__ends"))
    totals = near.groupBy(*ours).agg(F.sum("__ends").alias("__t"))
    start = totals.select(*ours, (F.sum("__t").over(Window.partitionBy(by).orderBy("__b")) - F.col("__t")).alias("__start"))
    flushes = near.join(start, ours).groupBy(by, (F.col("__start") + F.col("__no")).alias("__f")).agg(F.max_by("__due", "at").alias("at"), F.sum("n").alias("n_events"), F.min("at").alias("first_at"))
    said = lambda rows, kind, when: rows.select(by, F.lit(kind).alias("kind"), when.alias("at"), F.lit(None).cast("long").alias("n_events"), F.lit(None).cast("long").alias("first_at"))
    out = flushes.select(by, F.lit("flush").alias("kind"), "at", "n_events", "first_at").unionByName(said(near.filter(~F.col("__warm")), "hot", F.col("at")))
    for kind, wait in (("cold", hot), ("idle", idle)):
        out = out.unionByName(said(near.filter(alone(F.col("at") + wait)), kind, F.col("at") + wait))
    return out


#: Rows, and share of a table's rows, whose addition makes a rebuild of its index due.
REBUILD_ROWS, REBUILD_SHARE = 1000, 0.2


def rebuild_marks(adds: DataFrame, by: str = "table_name") -> DataFrame:
    """table_name, seq, pending, due: a table is due when the rows added since the last mark reach max(1000, 20 % of its rows).

    adds: table_name, seq, added, total, full.  A full run marks always.  Rows
    stream through one fold, sorted within partitions by table and run.
    """
    names = [by, "seq", "pending", "due"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pending = None, 0
        for b in batches:
            out: list[list] = [[], [], [], []]
            for table, seq, added, total, full in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pending = (pending if table == last else 0) + added
                last = table
                due = full or pending >= max(REBUILD_ROWS, int(total * REBUILD_SHARE))
                for column, value in zip(out, (table, seq, pending, due), strict=True):
                    column.append(value)
                pending = 0 if due else pending
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    rows = adds.select(F.col(by).cast("string"), *(F.col(c).cast("long") for c in ("seq", "added", "total")), "full")
    return rows.repartition(by).sortWithinPartitions(by, "seq").mapInArrow(fold, f"{by} string, seq long, pending long, due boolean")


def nearest(left: DataFrame, right: DataFrame, within: float, left_id: str, left_at: str = "at", right_at: str = "ts_s") -> DataFrame:
    """Each left row's nearest right row in time, at most ``within`` seconds off; the earliest of equally near ones.

    Both sides are sorted together within time buckets as wide as the reach: the
    nearest row of the own bucket is the last one before or the first one after;
    of a neighbouring bucket only its edge can be nearest, one row.  So no left
    row meets more than four right ones.  left: left_id, at; right: ts_s and the rest.
    """
    bucket = lambda at: F.floor(F.col(at) / within).cast("long")
    columns = [right_at, *(c for c in right.columns if c != right_at)]
    one = right.filter(F.col(right_at).isNotNull()).groupBy(bucket(right_at).alias("__b"), F.col(right_at).alias("__t")).agg(F.min(F.struct(*columns)).alias("__r"))
    kind = one.schema["__r"].dataType
    asked = left.select(F.struct(*left.columns).alias("__l"), bucket(left_at).alias("__b"), F.col(left_at).cast("double").alias("__t"), F.lit(None).cast(kind).alias("__r"))
    both = asked.unionByName(one.select(F.lit(None).cast(asked.schema["__l"].dataType).alias("__l"), "__b", F.col("__t").cast("double").alias("__t"), "__r"))
    order = Window.partitionBy("__b").orderBy("__t", F.col("__l").isNotNull())
    before = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    own = both.select("__l", "__b", "__t", before.alias("__before"), after.alias("__after")).filter(F.col("__l").isNotNull())
    edges = one.groupBy("__b").agg(F.min_by("__r", "__t").alias("__first"), F.max_by("__r", "__t").alias("__last"))
    lower, upper = edges.select((F.col("__b") + 1).alias("__b"), F.col("__last").alias("__below")), edges.select((F.col("__b") - 1).alias("__b"), F.col("__first").alias("__above"))
    met = own.join(lower, "__b", "left").join(upper, "__b", "left")
    near = F.filter(F.array("__before", "__after", "__below", "__above"), lambda r: r.isNotNull() & (F.abs(r[right_at] - F.col("__t")) <= within))
    best = F.get(F.array_sort(F.transform(near, lambda r: F.struct(F.abs(r[right_at] - F.col("__t")).alias("d"), r.alias("r")))), F.lit(0))["r"]
    return met.select("__l", best.alias("__r")).select("__l.*", *(F.col(f"__r.{c}").alias(c) for c in right.columns))


def recent(events: DataFrame, n: int = 100, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest events, as the ring of a status page holds them."""
    return events.orderBy(F.desc(time), F.desc(tie)).limit(n)


def branch_switches(events: DataFrame, by: str = "project_id", time: str = "ts") -> DataFrame:
    """group, time, branch, previous: events on another branch than the group's event before."""
    order = Window.partitionBy(by).orderBy(time)
    return events.select(by, time, "branch", F.lag("branch").over(order).alias("previous")).filter(F.col("branch") != F.col("previous"))


def peak_in_spans(spans: DataFrame, samples: DataFrame, seconds: float = 600.0) -> DataFrame:
    """span_id, n_samples, peak of the samples (at, value) inside each span (span_id, enter_s, exit_s); spans without one too, open ones (no exit) have none.

    A span is dealt to every time bucket that it touches and each bucket's
    samples are folded there, so a long span is spread over tasks.
    """
    bucket = F.floor(F.col("at") / seconds).cast("long")
    touched = F.sequence(F.floor(F.col("enter_s") / seconds).cast("long"), F.floor(F.col("exit_s") / seconds).cast("long"))
    dealt = spans.filter(F.col("exit_s") >= F.col("enter_s")).select("*", F.explode(touched).alias("__b"))
    inside = dealt.join(samples.withColumn("__b", bucket), "__b").filter(F.col("at").between(F.col("enter_s"), F.col("exit_s")))
    found = inside.groupBy("span_id").agg(F.count(F.lit(1)).alias("n_samples"), F.max("value").alias("peak"))
    return spans.select("span_id").join(found, "span_id", "left").select("span_id", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "peak")


class _Open:
    """A span on the stack, with the figures of its running segment."""

    def __init__(self, no: int, parent: int | None, depth: int, name: str | None, at: int):
        self.no, self.parent, self.depth, self.name, self.seq = no, parent, depth, name, 0
        self.begin(at)

    def begin(self, at: int) -> None:
        self.at, self.start, self.end, self.peak, self.own_peak, self.n, self.own_ms = at, None, None, None, None, 0, 0

    def see(self, value: float | None, own: bool) -> None:
        if value is None:
            return
        self.start, self.end, self.n = value if self.n == 0 else self.start, value, self.n + 1
        self.peak = value if self.peak is None else max(self.peak, value)
        if own:
            self.own_peak = value if self.own_peak is None else max(self.own_peak, value)

    def row(self, session: str | None, until: int, final: bool, ended: bool = True) -> tuple:
        return (session, self.no, self.parent, self.depth, self.name, self.seq, final, self.at, until if ended else None, self.start, self.end, self.peak, self.own_peak, self.n, until - self.at, self.own_ms)


_SPANS = "session string, span_no long, parent_no long, depth int, name string, seq int, final boolean, enter_at long, exit_at long, start_value double, end_value double, peak double, own_peak double, n_values long, total_ms long, own_ms long"


def nested_spans(log: DataFrame, segment_ms: int | None = None) -> DataFrame:
    """One row per span of each session's log, or per segment of a span where ``segment_ms`` is given.

    log: session, at (ms), tie, kind (enter, sample or exit; other rows are passed
    over), name, value.  An exit closes the innermost open span, one without an
    open span is passed over.  Each value counts for all open spans (peak), and
    for the innermost one by itself (own_peak); own_ms is the time without inner
    spans.  A sample that comes at least ``segment_ms`` after a segment's begin
    ends it; the next one starts from that value, so its peak is its own.  Spans
    still open have no exit_at, are not final, and are measured up to the
    session's last row.  Rows stream through one fold, sorted within partitions
    by session and time; it holds the open spans only.
    """
    schema = StructType.fromDDL(_SPANS)
    arrow = to_arrow_schema(schema)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, session, last, count = False, None, 0, 0
        stack: list[_Open] = []
        for b in batches:
            out = []
            for key, at, kind, name, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or key != session:
                    out += [s.row(session, last, False, ended=False) for s in stack]
                    begun, session, stack, count = True, key, [], 0
                elif stack:
                    stack[-1].own_ms += at - last
                last = at
                if kind == "enter":
                    count += 1
                    stack.append(_Open(count, stack[-1].no if stack else None, len(stack) + 1, name, at))
                for s in stack:
                    s.see(value, s is stack[-1])
                if kind == "exit" and stack:
                    out.append(stack.pop().row(session, at, True))
                for s in stack if kind == "sample" and segment_ms else ():
                    if at - s.at >= segment_ms:
                        out.append(s.row(session, at, False))
                        s.seq += 1
                        s.begin(at)
                        s.see(value, s is stack[-1])
            yield table(out)
        yield table([s.row(session, last, False, ended=False) for s in stack])

    rows = log.filter(F.col("at").isNotNull() & F.col("kind").isin("enter", "sample", "exit"))
    rows = rows.select(F.col("session").cast("string"), F.col("at").cast("long"), "kind", F.col("name").cast("string"), F.col("value").cast("double"), "tie")
    ordered = rows.repartition("session").sortWithinPartitions("session", "at", "tie")
    return ordered.drop("tie").mapInArrow(fold, schema)


def near_spans(points: DataFrame, spans: DataFrame, within: float, point_id: str) -> DataFrame:
    """(point, span) pairs where the span holds the point or begins or ends within reach of it.

    Both sides are dealt by time buckets: a span goes to every bucket that it or
    its reach touches, a point to its own.  points: id, at; spans: span_id,
    start_s, end_s.
    """
    width = within * 2
    spread = F.sequence(F.floor((F.col("start_s") - within) / width).cast("long"), F.floor((F.col("end_s") + within) / width).cast("long"))
    met = points.withColumn("__b", F.floor(F.col("at") / width).cast("long")).join(spans.withColumn("__b", F.explode(spread)), "__b")
    holds = (F.col("start_s") <= F.col("at")) & (F.col("end_s") >= F.col("at"))
    close = (F.abs(F.col("start_s") - F.col("at")) <= within) | (F.abs(F.col("end_s") - F.col("at")) <= within)
    return met.filter(holds | close).select(point_id, "span_id", holds.alias("holds"))


def peak_by_segment(samples: DataFrame, seconds: int, by: list[str], value: str, time: str = "ts") -> DataFrame:
    """group columns, segment start, peak, total and count of fixed segments."""
    w = F.window(F.col(time), f"{seconds} seconds")
    return samples.groupBy(*by, w.alias("__w")).agg(F.max(value).alias("peak"), F.round(F.sum(value), 6).alias("total"), F.count(F.lit(1)).alias("n")).select(*by, F.col("__w.start").alias("segment"), "peak", "total", "n")


def fetch_decisions(pinned: DataFrame, remotes: DataFrame, state: DataFrame, tags: DataFrame) -> DataFrame:
    """branch, decision, out_of_band for each pinned branch, from its remote sha, the last indexed one and its chunks.

    out_of_band: the commit is new to the index though the last fetch (remotes'
    before_sha, where given) brought nothing, so another fetch had brought it.
    """
    key = ["source_id", "branch"]
    before = F.col("before_sha") if "before_sha" in remotes.columns else F.lit(None).cast("string")
    has = tags.select(*key).distinct().withColumn("__chunks", F.lit(True))
    all_ = pinned.select(*key).join(remotes.select(*key, "sha", before.alias("__before")), key, "left").join(state.select(*key, "last_indexed_sha"), key, "left").join(has, key, "left")
    moved = F.col("sha") != F.col("last_indexed_sha")
    decision = (
        F.when(F.col("sha").isNull(), "warn_no_remote")
        .when(F.col("last_indexed_sha").isNull() & F.col("__chunks"), "baseline")
        .when(F.col("last_indexed_sha").isNull(), "enqueue")
        .when(moved, "enqueue")
        .otherwise("up_to_date")
    )
    return all_.select(*key, decision.alias("decision"), F.coalesce(moved & (F.col("__before") == F.col("sha")), F.lit(False)).alias("out_of_band"))


def first_in_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")
