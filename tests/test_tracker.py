"""The tracker source against a small server of the tests' own, and saved pages."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone.api import Engine
from siltstone.sources import issues, tracker


def gitlab_issue(n, at, **fields):
    return {"iid": n, "title": f"T{n}", "description": f" body {n} ", "author": {"username": f"u{n}"}, "updated_at": at, "web_url": f"https://h/i/{n}", "state": "opened", "labels": ["a"], "milestone": None, "assignees": [{"username": "x"}], "confidential": n % 2 == 0} | fields


class Server(ThreadingHTTPServer):
    """Issues by path, notes by issue; the first request of each path fails once."""

    daemon_threads = True

    def __init__(self, lists):
        self.lists, self.seen, self.asked = lists, set(), []
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        path, _, query = self.path.partition("?")
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
        self.server.asked.append((path, asked))
        first = (path, asked.get("page")) not in self.server.seen
        self.server.seen.add((path, asked.get("page")))
        since = asked.get("updated_after") or asked.get("since")
        rows = self.server.lists.get(path)
        status = 404 if rows is None else 429 if first and path.endswith("issues") else 200
        rows = [r for r in rows or [] if not since or tracker.moment(r["updated_at"]) > tracker.moment(since)]
        size, page = tracker.PAGE, int(asked.get("page", 1))
        self.send_response(status)
        if status == 429:
            self.send_header("Retry-After", "0")
        if "/repos/" not in path:
            self.send_header("X-Total-Pages", str(-(-len(rows) // size)))
            self.send_header("X-Total", str(len(rows)))
        elif page * size < len(rows):
            self.send_header("Link", f'<http://h?page={page + 1}>; rel="next", <http://h?per_page=100&page={-(-len(rows) // size)}>; rel="last"')
        self.end_headers()
        self.wfile.write(json.dumps(rows[(page - 1) * size : page * size] if status == 200 else []).encode())

    def log_message(self, *args):
        pass


GITLAB = "/api/v4/projects/g%2Fp/issues"


@pytest.fixture
def gitlab():
    many = [gitlab_issue(n, f"2024-01-01T00:{n // 60:02d}:{n % 60:02d}Z") for n in range(1, 251)]
    notes = {f"{GITLAB}/{n}/notes": [] for n in range(1, 251)}
    notes[f"{GITLAB}/7/notes"] = [{"id": 1, "body": " said ", "author": {"username": "z"}, "created_at": "2024-01-05T00:00:00Z", "system": False}, {"id": 2, "body": "changed", "author": {"username": "z"}, "created_at": None, "system": True}]
    del notes[f"{GITLAB}/9/notes"]
    server = Server({GITLAB: many} | notes)
    yield server
    server.shutdown()


@pytest.fixture(autouse=True)
def no_pause(monkeypatch):
    monkeypatch.setattr(tracker, "PAUSE", 0)


def test_all_pages_of_a_server(spark, gitlab):
    spark.dataSource.register(tracker.IssueSource)
    rows = spark.read.format("issues").options(provider="gitlab", base_url=gitlab.url, project="g/p", token="t").load().persist()
    assert rows.rdd.getNumPartitions() == 3
    got = {r.item_path: r for r in issues.tracker_items(rows).collect()}
    assert len(got) == 251 and got["issues/9"].content == "# T9\n\nbody 9"
    note = got["issues/7#note_1"]
    assert (note.content, note.author, note.timestamp, note.item_url, note.labels, note.confidential) == ("said", "z", "2024-01-05T00:00:00Z", "https://h/i/7#note_1", '["a"]', "false")
    rows.unpersist()
    later = spark.read.format("issues").options(provider="gitlab", base_url=gitlab.url, project="g/p", cursor="2024-01-01T00:04:00Z", until="2024-01-01T00:04:05Z").load()
    assert sorted(r.number for r in later.filter("kind = 'issue'").collect()) == list(range(181, 246))  # the cursor less 60 s, up to the offset
    assert spark.read.format("issues").options(provider="gitlab", base_url=gitlab.url, project="none").load().count() == 0


def test_the_other_provider(spark):
    path = "/repos/o/r/issues"
    own = [{"number": n, "title": "T", "body": None, "user": None if n == 3 else {"login": "l"}, "updated_at": "2024-01-01T00:00:00Z", "html_url": "u", "state": "closed", "labels": [{"name": "b"}], "milestone": {"title": "m"}, "assignees": []} for n in range(1, 130)]
    own[4]["pull_request"] = {"url": "x"}
    server = Server({path: own} | {f"{path}/{n}/comments": [{"id": 8, "body": "c", "user": None, "created_at": ""}] if n == 2 else [] for n in range(1, 130)})
    spark.dataSource.register(tracker.IssueSource)
    rows = spark.read.format("issues").options(provider="github", base_url=server.url, project="o/r").load()
    got = {r.item_path: r for r in issues.tracker_items(rows, "github").collect()}
    assert len(got) == 129 and "issues/5" not in got and got["issues/3"].author == "unknown"
    note = got["issues/2#comment_8"]
    assert (note.item_url, note.author, note.timestamp, note.milestone, note.state) == ("u#issuecomment-8", "unknown", "2024-01-01T00:00:00Z", '{"title":"m","due_date":null}', "closed")
    assert not any(p.startswith(f"{path}/5/") for p, _ in server.asked)
    server.shutdown()


def test_rows_that_move_between_pages(gitlab):
    """An issue that goes while pages are read moves others to the page before; none is lost."""
    t = tracker._Tracker({"provider": "gitlab", "base_url": gitlab.url, "project": "g/p"})
    plan = t.plan("g/p", None, None)
    assert [p.page for p in plan] == [1, 2, 3] and plan[0].total == "250"
    first = {r[2] for r in t.read(plan[0])}
    del gitlab.lists[GITLAB][0]
    rest = {r[2] for p in plan[1:] for r in t.read(p)}
    assert 101 not in first and first | rest == set(range(1, 251))


def test_engine_reads_and_follows_a_tracker(spark, gitlab, tmp_path):
    gitlab.lists[GITLAB] = gitlab.lists[GITLAB][:12]
    e = Engine(spark, f"file://{tmp_path}/index", dims=16)
    e.registry.add_project("p")
    for name in ("batch", "stream"):
        e.registry.add_source("p", {"id": name, "type": "ticket", "provider": "gitlab", "base_url": gitlab.url, "project_id": "g/p", "token": "t"})
    assert e.index_source("p", "batch")["persisted"] == 13
    assert e.registry.list_sources("p")[0]["cursor"]
    e.follow_source("p", "stream", f"file://{tmp_path}/offsets")

    def paths(source):
        return sorted(r.item_path for r in e.knowledge.read(parts=[f"p/{source}"]).collect())

    assert paths("stream") == paths("batch") and len(paths("stream")) == 13
    gitlab.lists[GITLAB][2] |= {"description": "edited", "updated_at": "2099-01-01T00:00:00Z"}  # after the offset: the next batch's
    e.follow_source("p", "stream", f"file://{tmp_path}/offsets")
    e.follow_source("p", "stream", f"file://{tmp_path}/again")  # all of it once more
    assert paths("stream") == paths("batch")
    gitlab.lists[GITLAB][3] |= {"description": "mended", "updated_at": tracker.datetime.now(tracker.UTC).isoformat()}
    gitlab.lists[f"{GITLAB}/7/notes"].clear()
    gitlab.lists[GITLAB][6] |= {"updated_at": tracker.datetime.now(tracker.UTC).isoformat()}
    e.follow_source("p", "stream", f"file://{tmp_path}/offsets")
    rows = {r.item_path: r.content for r in e.knowledge.read(parts=["p/stream"]).collect()}
    assert len(rows) == 12 and rows["issues/4"] == "# T4\n\nmended" and rows["issues/3"] == "# T3\n\nbody 3"
    assert e.search_knowledge("p", "mended", 1, source="stream").first().item_path == "issues/4"


def test_a_saved_page_lists_only_its_own_folder(spark, tmp_path, monkeypatch):
    import pyarrow.fs

    root = f"file://{tmp_path}/pages"
    rows = [("projects/7/issues", k // 10 + 1, '{"iid": %d, "updated_at": "2024-01-01T00:00:00Z"}' % k) for k in range(200)]
    tracker.save_pages(spark.createDataFrame(rows, "path string, page int, row string"), root)
    real, seen = pyarrow.fs.FileSystem.from_uri, []

    class Counted:
        def __init__(self, files):
            self.files = files

        def get_file_info(self, selector):
            found = self.files.get_file_info(selector)
            seen.append(len(found))
            return found

        def open_input_stream(self, path):
            return self.files.open_input_stream(path)

    monkeypatch.setattr(tracker.pyarrow.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: (Counted(real(uri)[0]), real(uri)[1]))}))
    status, headers, found = tracker.saved_pages(f"{root}#projects/7/issues", 3, None, "")
    assert status == 200 and tracker.total_pages(headers) == 20 and sorted(r["iid"] for r in found) == list(range(20, 30))
    assert sum(seen) < 10, seen
    assert tracker.saved_pages(f"{root}#projects/8/issues", 1, None, "")[0] == 404
