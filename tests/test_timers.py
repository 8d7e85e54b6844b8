"""Timers of a stream against a fold of the same events, and against the form for tables."""

import random
from collections import defaultdict

import pytest

from siltstone.api import Engine
from siltstone.operators import temporal
from siltstone.streaming import changes, timers

SETTINGS = (1500, 5, 60_000, 300_000)


def fold(events, quiet, factor, hot, idle):
    """Millisecond rules written out: what happens between an event and the next one of its project."""
    by = defaultdict(list)
    for p, at in sorted(events):
        by[p].append(at)
    out = []
    for p, times in by.items():
        waiting, last = [], None
        for at, following in zip(times, [*times[1:], None], strict=True):
            cold = last is None or at >= last + hot
            if cold:
                out.append((p, "hot", at, None, None))
            waiting.append(at)
            due = at + quiet * (factor if cold else 1)
            if following is None or following >= due:
                out.append((p, "flush", due, len(waiting), waiting[0]))
                waiting = []
            out += [(p, kind, at + wait, None, None) for kind, wait in (("cold", hot), ("idle", idle)) if following is None or following >= at + wait]
            last = at
    return sorted(out, key=str)


def made(seed, n=300):
    rng, out = random.Random(seed), []
    for p in "abc":
        at = 1_700_000_000_000
        for _ in range(n):
            at += rng.choice([0, 1, 700, 1499, 1500, 1501, 7499, 7500, 7501, 59_999, 60_000, 60_001, 299_999, 300_000, 400_000])
            out.append((p, at))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tables_against_the_fold(spark, seed):
    events = made(seed)
    rows = spark.createDataFrame(events, "project string, at long")
    assert sorted(map(tuple, temporal.activity_timers(rows, "project").collect()), key=str) == fold(events, *SETTINGS)
    assert temporal.activity_timers(rows.limit(0), "project").count() == 0


def test_stream_against_the_fold(spark, tmp_path):
    """Events come out of order within the lateness, in several batches; a last event of another project moves the watermark on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = [(p, at) for p, at in made(3, 40)]
        shuffled = sorted(events, key=lambda e: e[1] + random.Random(e[1]).randint(-60_000, 60_000))
        size = len(shuffled) // 3
        for k in range(3):
            part = spark.createDataFrame(shuffled[k * size : None if k == 2 else (k + 1) * size], "project string, at long")
            part.selectExpr("project", "timestamp_millis(at) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        end = spark.createDataFrame([("end", 1_900_000_000_000)], "project string, at long").selectExpr("project", "timestamp_millis(at) as ts")
        end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = changes.read_events(spark, f"{tmp_path}/events", "project string, ts timestamp")
        got = []
        changes.run_available(timers.activity(stream, "project"), f"file://{tmp_path}/ck", lambda df, _: got.extend(map(tuple, df.collect())))
        assert sorted((r for r in got if r[0] != "end"), key=str) == fold(events, *SETTINGS)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_an_idle_project_is_collected(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/i", dims=8)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": ""})
    for word in ("one", "two"):
        e.index_source("p", "s", "main", items=spark.createDataFrame([("a.py", f"def {word}():\n    pass\n", "python")], "item_path string, content string, language string"))
    events = spark.createDataFrame([("p", 1_000), ("p", 200_000), ("other", 5_000)], "project_id string, at long")
    assert e.gc_when_idle(events, 0, 499_999) == []  # the second event set the timer back
    assert len(e.gc_when_idle(events, 499_999, 500_000)) == 1 and e.gc_when_idle(events, 500_000, 900_000) == []
    assert e.run_jobs()[0]["status"] == "done" and e.chunks.count() == 1
