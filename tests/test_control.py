"""Scheduling, parameters, the tracker source, discovery, upgrades and scores."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import params
from siltstone.operators import maintenance, ranking, scheduling
from siltstone.sources import discovery, tracker

SCHEMA = {"properties": {"project_id": {"type": "string"}, "top_k": {"type": "number"}, "mode": {"type": "string", "enum": ["full", "incremental"]}, "ids": {"type": "array", "items": {"type": "string"}}}, "required": ["project_id"]}


@pytest.mark.parametrize(
    ("given", "said"),
    [
        ({"project_id": "p"}, None),
        ({"project_ids": "p"}, "did you mean 'project_id'"),
        ({"tok_k": 3, "project_id": "p"}, "did you mean 'top_k'"),
        ({"zzzzzzzz": 3}, "unknown parameter 'zzzzzzzz'"),
        ({"project_id": None}, "missing parameter 'project_id'"),
        ({"project_id": "p", "top_k": "3"}, "must be of type number"),
        ({"project_id": "p", "top_k": True}, "not boolean"),
        ({"project_id": "p", "mode": "half"}, "must be one of full, incremental"),
        ({"project_id": "p", "ids": ["a", 1]}, "items of 'ids'"),
        ({"project_id": "p", "top_k": None}, None),
    ],
)
def test_params(given, said):
    got = params.violation(SCHEMA, given)
    assert got is None if said is None else said in got


def test_ticket_fields():
    assert params.ticket_fields({"gitlab_url": "u", "token": "t", "gitlab_token": "old"}) == {"provider": "gitlab", "url": "u", "project": "", "token": "t"}


def test_admission(spark):
    rows = [(1, "a", "running", 1), (2, "a", "queued", 2), (3, "b", "queued", 3), (4, "b", "queued", 4), (5, "gone", "queued", 5), (6, "c", "queued", 6), (7, "d", "queued", 7)]
    jobs = spark.createDataFrame(rows, "job_id int, project_id string, status string, queued_at int")
    known = spark.createDataFrame([(p,) for p in "abcd"], "project_id string")
    got = {r.job_id: r.decision for r in scheduling.admit(jobs, known, 3).collect()}
    assert got == {2: "wait", 3: "start", 4: "wait", 5: "fail", 6: "start", 7: "wait"}
    assert scheduling.accept(999) and not scheduling.accept(1000)


def test_polls_and_heat(spark):
    rows = [("s1", "h1", True, 0, 0), ("s2", "h1", True, 0, 10), ("s3", "h2", False, 0, 5000), ("s4", "h3", False, 5, 9000), ("s5", "h4", False, 1, 9975), ("s6", "h5", False, 0, None)]
    sources = spark.createDataFrame(rows, "source_id string, host string, hot boolean, failures int, last_poll_at int")
    assert [r.source_id for r in scheduling.due_polls(sources, 10_000).collect()] == ["s1", "s6"]
    assert [r[0] for r in spark.range(8).select(scheduling.backoff_seconds(F.col("id"))).collect()] == [30, 30, 60, 120, 240, 480, 600, 600]
    events = spark.createDataFrame([("p", 950), ("q", 10)], "project_id string, at int")
    assert {r.project_id: r.hot for r in scheduling.heat(events, 1000).collect()} == {"p": True, "q": False}


def test_tracker_pages_and_retries():
    answers = [(429, {"retry-after": "7"}, []), (200, {}, [{"i": k} for k in range(100)]), (500, {}, []), (200, {}, [{"i": 100}])]
    waits, asked = [], []

    def fetch(path, page, since, token):
        asked.append((path, page, since, token))
        return answers.pop(0)

    rows = list(tracker.pages(fetch, "x", "s", "t", waits.append))
    assert [r["i"] for r in rows] == list(range(101)) and waits == [7.0, 1.0] and [a[1] for a in asked] == [1, 1, 2, 2]
    assert list(tracker.pages(lambda *a: (404, {}, []), "x", None, "")) == []
    with pytest.raises(tracker.Refused):
        list(tracker.pages(lambda *a: (401, {}, []), "x", None, ""))
    with pytest.raises(RuntimeError):
        list(tracker.pages(lambda *a: (500, {}, []), "x", None, "", lambda s: None))
    assert tracker.wait_seconds(403, {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "105"}, 1, 100.0) == 6.0
    assert tracker.wait_seconds(429, {}, 1, 0.0) == 60.0
    assert tracker.since_of("2024-01-01T00:01:00Z") == "2024-01-01T00:00:00+00:00" and tracker.since_of(None) is None


def test_discovery(spark):
    paths = ["a/.git/HEAD", "a/x.py", "a/y.py", "a/z.ts", "a/sub/.git/HEAD", "a/sub/q.go", "b/c/.git", "b/c/m.md", "node_modules/k/.git/HEAD", "d/e/f/g/.git/HEAD", "h/t.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "item_path string")
    got = {r.root: (r.n_files, r.language) for r in discovery.repositories(rows).collect()}
    assert got == {"a": (4, "python"), "b/c": (1, "markdown")}
    text = discovery.default_ignore("# c\n*.tmp\n\nbuild/\n")
    assert text.count("build/") == 1 and "*.tmp" in text and "# c" not in text


def test_upgrades(spark):
    assert maintenance.store_steps(None) == ["reset", "upgrade_jobs"] and maintenance.store_steps(4) == []
    assert maintenance.upgrade_jobs(spark.createDataFrame([(1,)], "job_id int")).first().type == "reindex"
    sources = spark.createDataFrame([("p", "s", "text", 1), ("p", "t", "text", 2), ("p", "u", "code", None)], "project_id string, source_id string, profile string, knowledge_schema_version int")
    assert [r.source_id for r in maintenance.to_refetch(sources).collect()] == ["s"]
    folders = spark.createDataFrame([("i1", 5), ("i2", 6)], "path string, bytes int")
    assert [r.path for r in maintenance.unreferenced(folders, folders.filter("path = 'i1'")).collect()] == ["i2"]


def test_logits(spark):
    rows = spark.createDataFrame([(1, [0.3]), (2, [0.0, 0.0]), (3, [float("nan")]), (4, [])], "i int, l array<double>")
    assert {r.i: r.s for r in rows.select("i", ranking.score_of_logits(F.col("l")).alias("s")).collect()} == {1: 0.3, 2: 0.5, 3: 0.0, 4: 0.0}
