"""Projects, their sources and the readers of each source type."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.store import Document

Reader = Callable[[SparkSession, dict], DataFrame]
_READERS: dict[str, Reader] = {}
_PROFILE = {"code": "code"}


def register_reader(kind: str, reader: Reader, profile: str = "text") -> None:
    """Make a source type known: ``reader(spark, source)`` gives its items."""
    _READERS[kind] = reader
    _PROFILE[kind] = profile


def reader_of(kind: str) -> Reader:
    if kind not in _READERS:
        raise KeyError(f"unknown source type: {kind}")
    return _READERS[kind]


def resolve_env(value: str) -> str:
    """``${NAME}`` parts replaced from the environment; a missing name raises."""

    def one(m: re.Match) -> str:
        if m.group(1) not in os.environ:
            raise KeyError(f"environment variable {m.group(1)} is not set")
        return os.environ[m.group(1)]

    return re.sub(r"\$\{(\w+)\}", one, value)


def resolved(source: dict) -> dict:
    """A source's settings with ``${NAME}`` parts of its texts filled in."""
    return {k: resolve_env(v) if isinstance(v, str) else v for k, v in source.items()}


def _known(found: dict[str, dict], name: str, what: str) -> dict:
    if name not in found:
        raise KeyError(f"unknown {what}: {name}")
    return found[name]


class Registry:
    """Projects and their sources, which are few: a versioned document.  Every update is made of the newest version, so none undoes another's."""

    def __init__(self, spark: SparkSession, root: str):
        self.document = Document(spark, root)

    def _load(self) -> dict[str, dict]:
        return self.document.load()

    def list_projects(self) -> list[dict]:
        return sorted(self._load().values(), key=lambda p: p["id"])

    def get(self, project: str) -> dict:
        return _known(self._load(), project, "project")

    def _update(self, project: str, change: Callable[[dict], dict | None]) -> dict:
        """Replace a project by what ``change`` makes of it; None forgets it."""

        def save(projects: dict[str, dict]) -> dict[str, dict]:
            new = change(_known(projects, project, "project"))
            return {k: v for k, v in projects.items() if k != project} | ({project: new} if new else {})

        return self.document.save(save).get(project, {})

    def add_project(self, project: str, description: str = "") -> None:
        def save(projects: dict[str, dict]) -> dict[str, dict]:
            if project in projects:
                raise ValueError(f"project exists: {project}")
            return projects | {project: {"id": project, "description": description, "sources": []}}

        self.document.save(save)

    def update_project(self, project: str, description: str) -> dict:
        return self._update(project, lambda p: p | {"description": description})

    def remove_project(self, project: str) -> None:
        self._update(project, lambda p: None)

    def add_source(self, project: str, source: dict) -> dict:
        """A source has id, type and the settings of its reader."""
        reader_of(source["type"])
        own = {"pinned_branches": [], "last_indexed": None} | source | {"profile": _PROFILE[source["type"]]}

        def add(p: dict) -> dict:
            if any(s["id"] == own["id"] for s in p["sources"]):
                raise ValueError(f"source exists: {own['id']}")
            return p | {"sources": [*p["sources"], own]}

        self._update(project, add)
        return own

    def update_source(self, project: str, source: str, fields: dict) -> dict:
        def set_fields(p: dict) -> dict:
            _known({s["id"]: s for s in p["sources"]}, source, "source")
            return p | {"sources": [s | fields if s["id"] == source else s for s in p["sources"]]}

        return next(s for s in self._update(project, set_fields)["sources"] if s["id"] == source)

    def remove_source(self, project: str, source: str) -> None:
        def remove(p: dict) -> dict:
            _known({s["id"]: s for s in p["sources"]}, source, "source")
            return p | {"sources": [s for s in p["sources"] if s["id"] != source]}

        self._update(project, remove)

    def list_sources(self, project: str | None = None, profile: str | None = None) -> list[dict]:
        out = [s | {"project_id": p["id"]} for p in self.list_projects() if project in (None, p["id"]) for s in p["sources"]]
        return [s for s in out if profile in (None, s["profile"])]
