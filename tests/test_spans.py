"""Nested spans of a session's log against a replay of each session by itself."""

import random

import pytest

from siltstone.operators import temporal

LOG = "session string, at long, tie long, kind string, name string, value double"


def replay(log, segment_ms):
    """Rows as the operator gives them, from lists of the rows that stand in each span."""
    out = []
    for session in {r[0] for r in log}:
        rows = sorted((r for r in log if r[0] == session and r[1] is not None and r[3] in ("enter", "sample", "exit")), key=lambda r: (r[1], r[2]))
        spans, opened, top = [], [], []  # top: the innermost span of each row
        for i, r in enumerate(rows):
            if r[3] == "enter":
                spans.append({"a": i, "z": None, "parent": opened[-1] if opened else None, "depth": len(opened) + 1})
                opened.append(len(spans) - 1)
            top.append(opened[-1] if opened else None)
            if r[3] == "exit" and opened:
                spans[opened.pop()]["z"] = i
        after = []  # the innermost span of the time that follows each row
        for i, r in enumerate(rows):
            inside = [k for k, s in enumerate(spans) if s["a"] <= i and (s["z"] is None or s["z"] > i)]
            after.append(inside[-1] if inside else None)
        for k, s in enumerate(spans):
            end = len(rows) - 1 if s["z"] is None else s["z"]
            cuts = [s["a"]]
            for i in range(s["a"] + 1, end + 1):
                if segment_ms and rows[i][3] == "sample" and rows[i][1] - rows[cuts[-1]][1] >= segment_ms:
                    cuts.append(i)
            for seq, (a, z) in enumerate(zip(cuts, [*cuts[1:], end], strict=True)):
                seen = [rows[i][5] for i in range(a, z + 1) if rows[i][5] is not None]
                own = [rows[i][5] for i in range(a, z + 1) if rows[i][5] is not None and top[i] == k]
                own_ms = sum(rows[i + 1][1] - rows[i][1] for i in range(a, z) if after[i] == k)
                final = seq == len(cuts) - 1
                ended = not final or s["z"] is not None
                ends = (seen[0], seen[-1], max(seen)) if seen else (None, None, None)
                parent = None if s["parent"] is None else s["parent"] + 1
                out.append((session, k + 1, parent, s["depth"], rows[s["a"]][4], seq, final and ended, rows[a][1], rows[z][1] if ended else None, *ends, max(own) if own else None, len(seen), rows[z][1] - rows[a][1], own_ms))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_ms", [None, 15_000])
def test_spans_equal_a_replay(spark, segment_ms):
    rng = random.Random(5)
    log = []
    for session in ["s1", "s2", "s3", "", None]:
        for tie in range(rng.choice([1, 60, 300])):
            kind = rng.choice(["enter", "exit", "sample", "sample", "sample", "other", None])
            log.append((session, rng.choice([None, *range(0, 400_000, 1000)]), tie, kind, rng.choice(["scan", "embed", None]), rng.choice([None, float(rng.randint(0, 99))])))
    got = temporal.nested_spans(spark.createDataFrame(log, LOG).repartition(7), segment_ms)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == replay(log, segment_ms)


def test_one_job(spark):
    """A job of 60 s with a phase inside; segments after 15 s; the second job is never closed."""
    log = [("j", 0, 0, "enter", "job", 10.0), ("j", 5_000, 1, "enter", "embed", 20.0), ("j", 16_000, 2, "sample", None, 90.0), ("j", 25_000, 3, "sample", None, 40.0), ("j", 30_000, 4, "exit", None, 30.0), ("j", 60_000, 5, "exit", None, 12.0), ("j", 61_000, 6, "exit", None, 99.0), ("j", 70_000, 7, "enter", "next", 5.0), ("j", 71_000, 8, "sample", None, 7.0)]
    df = spark.createDataFrame(log, LOG)
    whole = {r.name: r for r in temporal.nested_spans(df).collect()}
    assert (whole["job"].total_ms, whole["job"].own_ms, whole["job"].peak, whole["job"].own_peak) == (60_000, 35_000, 90.0, 12.0)
    assert (whole["embed"].parent_no, whole["embed"].total_ms, whole["embed"].own_peak) == (1, 25_000, 90.0)
    assert (whole["next"].final, whole["next"].exit_at, whole["next"].total_ms, whole["next"].peak) == (False, None, 1000, 7.0)
    parts = sorted((r.name, r.seq, r.final, r.enter_at, r.exit_at, r.peak) for r in temporal.nested_spans(df, 15_000).collect())
    assert parts == [("embed", 0, False, 5000, 25000, 90.0), ("embed", 1, True, 25000, 30000, 40.0), ("job", 0, False, 0, 16000, 90.0), ("job", 1, True, 16000, 60000, 90.0), ("next", 0, False, 70000, None, 7.0)]


def test_empty_log(spark):
    assert temporal.nested_spans(spark.createDataFrame([], LOG), 15_000).collect() == []
