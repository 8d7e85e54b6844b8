"""Streaming forms against their batch equivalents."""

from pyspark.sql import functions as F

from siltstone.operators import temporal
from siltstone.operators.store import Table
from siltstone.streaming import changes


def collect_stream(stream, tmp_path, mode="append"):
    rows = []
    changes.run_available(stream, f"file://{tmp_path}/ck", lambda df, _: rows.extend(map(tuple, df.collect())), mode)
    return rows


def write_events(spark, tmp_path):
    ts = (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("id") * F.col("id") % 5000 * 7).cast("timestamp")
    rows = spark.range(600).select((F.col("id") % 5).alias("user_id"), ts.alias("ts"), (F.col("id") % 17).cast("double").alias("value"))
    rows.repartition(3).write.parquet(f"{tmp_path}/events")
    return spark.read.parquet(f"{tmp_path}/events")


def test_debounce_and_idle_match_batch(spark, tmp_path):
    events = write_events(spark, tmp_path)
    stream = changes.read_events(spark, f"{tmp_path}/events", events.schema, files_per_trigger=100)
    got = collect_stream(changes.debounce(stream, ["user_id"], 60), tmp_path / "a", "complete")
    want = temporal.sessions(events, 60, ["user_id"]).select("user_id", "first_at", "last_at", "n_events").collect()
    assert sorted(got) == sorted(map(tuple, want))
    stream = changes.read_events(spark, f"{tmp_path}/events", events.schema, files_per_trigger=100)
    got = collect_stream(changes.idle(stream, ["user_id"], 90), tmp_path / "b", "complete")
    assert sorted(got) == sorted(map(tuple, temporal.idle_triggers(events, 90, ["user_id"]).collect()))


def test_rebuild_marks_match_batch(spark, tmp_path):
    adds = spark.range(300).select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("table_name"), F.col("id").alias("seq"), (F.col("id") * 37 % 400).alias("added"), (F.col("id") * 20).alias("total"), (F.col("id") % 50 == 9).alias("full"))
    adds.coalesce(1).write.parquet(f"{tmp_path}/adds")
    stream = changes.read_events(spark, f"{tmp_path}/adds", adds.schema)
    got = collect_stream(changes.rebuild_marks(stream), tmp_path)
    want = temporal.rebuild_marks(adds).select("table_name", "seq", "pending", "due").collect()
    assert sorted(got) == sorted(map(tuple, want))
    assert any(r[3] for r in got)


def test_branch_switches(spark, tmp_path):
    rows = spark.createDataFrame([("p", i, b) for i, b in enumerate("aabba")], "project_id string, s long, branch string").select("project_id", F.col("s").cast("timestamp").alias("ts"), "branch")
    rows.coalesce(1).write.parquet(f"{tmp_path}/e")
    got = collect_stream(changes.branch_switches(changes.read_events(spark, f"{tmp_path}/e", rows.schema)), tmp_path)
    assert [(r[2], r[3]) for r in got] == [("b", "a"), ("a", "b")]


def test_event_log_streams_into_a_table_once(spark, tmp_path):
    log = changes.EventLog(spark, f"file://{tmp_path}/log", keep_files=3)
    assert log.read().count() == 0
    for i in range(5):
        log.write([{"ts": i, "level": "info", "event": "job", "project_id": f"p{i % 2}", "detail": "é\n"}])
    assert sorted(r.ts for r in log.read().collect()) == [2, 3, 4]
    table = Table(spark, f"file://{tmp_path}/t")
    changes.into_table(log.stream(), table, f"{tmp_path}/c", "events")
    assert sorted(r.ts for r in table.read().collect()) == [2, 3, 4]
    log.write([{"ts": 9, "level": "warn", "event": "gc", "project_id": "p0", "detail": ""}])
    changes.into_table(log.stream(), table, f"{tmp_path}/c", "events")
    assert sorted(r.ts for r in table.read().collect()) == [2, 3, 4, 9]
    changes.into_table(log.stream(), table, f"{tmp_path}/fresh", "events")  # a lost checkpoint hands batches over again
    assert table.count() == 4
    latest = Table(spark, f"file://{tmp_path}/latest")
    changes.into_table(log.stream(), latest, f"{tmp_path}/k", "latest", key="project_id")
    assert {r.project_id: r.ts for r in latest.read().collect()} == {"p1": 3, "p0": 9}
