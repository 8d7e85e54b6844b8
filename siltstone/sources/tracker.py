"""An issue tracker as a Python data source, batch and streaming: pages, retries and cursors on the executors.

``spark.dataSource.register(IssueSource)``, then
``spark.read.format("issues").option("provider", "gitlab").option("base_url", ...).option("project", "7").load()``,
or ``spark.readStream`` alike.  Rows are (project, kind, number, updated_at, body): an
issue or a note as the provider's JSON; ``issues.from_tracker`` reads them.

One partition reads one page of one project's issues with their notes, where
the provider says how many pages there are; else a project is one partition.  A
stream's offset is, for each project, the time up to which it was read; a batch
asks for what changed after the offset before less the overlap, up to the new one,
so a batch that is run again gives the same rows as long as the tracker does, and
an edit made while a batch runs belongs to the next.  Sinks merge on the issue.

``fetch(path, page, since, token)`` returns (status, headers, rows) of one page; it
does the network part and is named as ``module:function`` or by the provider.
"""

from __future__ import annotations

import importlib
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .issues import OVERLAP_SECONDS

#: Rows of a page, tries of a page, seconds between issues whose notes are asked for one by one.
PAGE, TRIES, PAUSE = 100, 3, 0.05
#: The folder, beside saved pages, of the number of each path's last one.
LAST = "_last"
Headers = dict[str, str]
Fetch = Callable[[str, int, str | None, str], tuple[int, Headers, list[dict]]]


class Refused(RuntimeError):
    """The tracker denies access."""


def wait_seconds(status: int, headers: dict, attempt: int, now: float) -> float | None:
    """How long to wait before the next try; None where none helps.

    A rate limit names the wait or the reset time, else a minute; other
    failures wait a second more with each try.
    """
    if status == 429 or status == 403 and str(headers.get("x-ratelimit-remaining")) == "0":
        if "retry-after" in headers:
            return float(headers["retry-after"])
        if "x-ratelimit-reset" in headers:
            return max(0.0, float(headers["x-ratelimit-reset"]) - now) + 1
        return 60.0
    if status in (401, 403):
        raise Refused(f"status {status}")
    return None if status == 404 else float(attempt)


def since_of(cursor: str | None) -> str | None:
    """The cursor less the overlap."""
    if cursor is None:
        return None
    return (datetime.fromisoformat(cursor.replace("Z", "+00:00")) - timedelta(seconds=OVERLAP_SECONDS)).isoformat()


def total_pages(headers: Headers) -> int | None:
    """How many pages there are, by either provider's header; None where neither says."""
    if str(headers.get("x-total-pages", "")).isdigit():
        return int(headers["x-total-pages"])
    last = re.search(r'[?&]page=(\d+)[^>]*>;\s*rel="last"', headers.get("link", ""))
    return int(last[1]) if last else None


def one_page(fetch: Fetch, path: str, page: int, since: str | None, token: str, sleep: Callable[[float], None] = time.sleep) -> tuple[Headers, list[dict]] | None:
    """Headers and rows of a page, tried again after failures; None for a missing resource."""
    for attempt in range(1, TRIES + 2):
        status, headers, rows = fetch(path, page, since, token)
        if status == 200:
            return headers, rows
        wait = wait_seconds(status, headers, attempt, time.time())
        if wait is None:
            return None
        if attempt > TRIES:
            break
        sleep(wait)
    raise RuntimeError(f"{path}: status {status} after {TRIES} retries")


def pages(fetch: Fetch, path: str, since: str | None, token: str, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows of all pages: as many as the provider says, else until a short one; a missing resource has none."""
    page = 1
    while (found := one_page(fetch, path, page, since, token, sleep)) is not None:
        headers, rows = found
        yield from rows
        known = total_pages(headers)
        if page >= known if known is not None else len(rows) < PAGE:
            return
        page += 1


def _get(url: str, headers: Headers) -> tuple[int, Headers, list[dict]]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:  # noqa: S310  the source's own url
            return r.status, {k.lower(): v for k, v in r.headers.items()}, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, []
    except urllib.error.URLError:
        return 599, {}, []


def gitlab_pages(path: str, page: int, since: str | None, token: str) -> tuple[int, Headers, list[dict]]:
    asked = {"per_page": PAGE, "page": page, "order_by": "created_at", "sort": "asc"} | ({"state": "all"} if path.endswith("/issues") else {}) | ({"updated_after": since} if since else {})
    return _get(f"{path}?{urllib.parse.urlencode(asked)}", {"PRIVATE-TOKEN": token})


def github_pages(path: str, page: int, since: str | None, token: str) -> tuple[int, Headers, list[dict]]:
    asked = {"per_page": PAGE, "page": page} | ({"state": "all", "sort": "created", "direction": "asc"} if path.endswith("/issues") else {}) | ({"since": since} if since else {})
    return _get(f"{path}?{urllib.parse.urlencode(asked)}", {"Authorization": f"Bearer {token}", "Accept": "application/vnd.github+json"})


def save_pages(rows: DataFrame, root: str) -> None:
    """Keep rows (path, page, row as JSON) as pages that ``saved_pages`` serves."""
    rows.select("path", "page", "row").repartition("path", "page").write.partitionBy("path", "page").text(root)
    last = rows.groupBy("path").agg(F.max("page").cast("string").alias("last"))
    last.repartition("path").write.partitionBy("path").text(f"{root.rstrip('/')}/{LAST}")


def _saved(files: pyarrow.fs.FileSystem, folder: str) -> list[str]:
    """The lines of a folder's files; of one folder only, so a page costs the same however many there are."""
    lines: list[str] = []
    for f in files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        if f.is_file and f.base_name.startswith("part-"):
            with files.open_input_stream(f.path) as stream:
                lines += stream.read().decode().splitlines()
    return lines


def saved_pages(path: str, page: int, since: str | None, token: str) -> tuple[int, Headers, list[dict]]:
    """A ``fetch`` for pages kept by ``save_pages`` in a folder (``base_url``) that all workers see; notes stand in their issue."""
    root, _, name = path.partition("#")
    files, at = pyarrow.fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pyarrow.fs.LocalFileSystem(), root)
    place = f"path={urllib.parse.quote(name, safe='')}"
    last = [int(n) for n in _saved(files, f"{at}/{LAST}/{place}")]
    if not last:  # kept without the number of pages
        there = files.get_file_info(pyarrow.fs.FileSelector(f"{at}/{place}", allow_not_found=True))
        last = [int(f.base_name[5:]) for f in there if f.base_name.startswith("page=")]
    if not last:
        return 404, {}, []
    rows = [json.loads(line) for line in _saved(files, f"{at}/{place}/page={page}")]
    return 200, {"x-total-pages": str(max(last)), "x-total": ""}, [r for r in rows if since is None or moment(r["updated_at"]) > moment(since)]


def moment(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


# What each provider calls things.  The number of an issue, its resources below the base, its pages' reader.
PROVIDERS = {
    "gitlab": {"number": "iid", "issues": "/api/v4/projects/{project}/issues", "fetch": f"{__name__}:gitlab_pages", "notes": "/notes"},
    "github": {"number": "number", "issues": "/repos/{project}/issues", "fetch": f"{__name__}:github_pages", "notes": "/comments"},
    "saved": {"number": "iid", "issues": "#projects/{project}/issues", "fetch": f"{__name__}:saved_pages", "notes": "/notes"},
}


@dataclass
class Page(InputPartition):
    """A page of a project's issues (all of them where ``pages`` is None), changed after ``since`` and not after ``until``; ``total`` is what the list had when the pages were dealt."""

    project: str
    page: int
    pages: int | None
    total: str
    since: str | None
    until: str | None


class _Tracker:
    """What the batch and the streaming reader share."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.provider = PROVIDERS[self.options.get("provider", "gitlab")]
        self.projects = [p.strip() for p in self.options["project"].split(",")]

    def _fetch(self) -> Fetch:
        module, _, name = self.options.get("fetch", self.provider["fetch"]).partition(":")
        return getattr(importlib.import_module(module), name)

    def _path(self, project: str) -> str:
        safe = "/" if "repos" in self.provider["issues"] else ""
        return self.options.get("base_url", "").rstrip("/") + self.provider["issues"].format(project=urllib.parse.quote(project, safe=safe))

    def plan(self, project: str, since: str | None, until: str | None) -> list[Page]:
        found = one_page(self._fetch(), self._path(project), 1, since, self.options.get("token", ""))
        headers = found[0] if found else {"x-total-pages": "1"}  # of what is missing a page is asked for and is empty
        known = total_pages(headers)
        if known is None:
            return [Page(project, 1, None, "", since, until)]
        return [Page(project, k, known, headers.get("x-total", ""), since, until) for k in range(1, max(1, known) + 1)]

    def _rows(self, p: Page) -> Iterator[dict]:
        """A page's issues; where the list has grown or shrunk meanwhile, those of as many neighbours as rows can have moved to."""
        fetch, path, token = self._fetch(), self._path(p.project), self.options.get("token", "")
        if p.pages is None:
            yield from pages(fetch, path, p.since, token)
            return
        found = one_page(fetch, path, p.page, p.since, token)
        if found is None:
            return
        headers, rows = found
        yield from rows
        now = headers.get("x-total", "")
        reach = -(-abs(int(now) - int(p.total)) // PAGE) if now.isdigit() and p.total.isdigit() else abs((total_pages(headers) or p.pages) - p.pages)
        for k in range(max(1, p.page - reach), p.page + reach + 1):
            if k != p.page and (found := one_page(fetch, path, k, p.since, token)) is not None:
                yield from found[1]

    def read(self, partition: Page) -> Iterator[tuple]:
        fetch, path, token = self._fetch(), self._path(partition.project), self.options.get("token", "")
        last = partition.until and moment(partition.until)
        for issue in self._rows(partition):
            if issue.get("pull_request") is not None or last and moment(issue["updated_at"]) > last:
                continue
            number, changed = int(issue[self.provider["number"]]), issue["updated_at"]
            notes = issue.pop("notes", None)
            if notes is None:
                notes = list(pages(fetch, f"{path}/{number}{self.provider['notes']}", None, token))
                time.sleep(PAUSE)
            yield partition.project, "issue", number, changed, json.dumps(issue)
            for note in notes:
                yield partition.project, "note", number, changed, json.dumps(note)


class _Reader(_Tracker, DataSourceReader):
    def partitions(self) -> Sequence[Page]:
        return [p for project in self.projects for p in self.plan(project, since_of(self.options.get("cursor")), self.options.get("until"))]


class _StreamReader(_Tracker, DataSourceStreamReader):
    """Offsets are {project: time up to which it was read}; nothing is kept outside the query's checkpoint."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: self.options.get("cursor", "") for p in self.projects}

    def latestOffset(self) -> dict:  # noqa: N802
        now = self.options.get("until") or datetime.now(UTC).isoformat(timespec="seconds")
        return dict.fromkeys(self.projects, now)

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        return [p for project in self.projects for p in self.plan(project, since_of(start.get(project) or None), end[project])]

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offset; the tracker need not know."""


class IssueSource(DataSource):
    """project, kind (issue or note), number, updated_at, body (the provider's JSON)."""

    @classmethod
    def name(cls) -> str:
        return "issues"

    def schema(self) -> str:
        return "project string, kind string, number long, updated_at string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader(self.options)
