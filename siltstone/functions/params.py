"""Validation of a command's parameters against a flat schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest edit distance of a suggestion.
NEAR = 3
#: Python types of each kind of value; true and false are no numbers.
KINDS = {"boolean": (bool,), "number": (int, float), "string": (str,), "array": (list,), "object": (dict,)}


def _kind(value: object) -> str:
    return next((k for k, types in KINDS.items() if isinstance(value, types)), type(value).__name__)


def edits(a: str, b: str) -> int:
    """Insertions, deletions and replacements between two short names."""

    @cache
    def rest(i: int, j: int) -> int:
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j
        return rest(i + 1, j + 1) if a[i] == b[j] else 1 + min(rest(i + 1, j), rest(i, j + 1), rest(i + 1, j + 1))

    return rest(0, 0)


def suggest(unknown: str, known: list[str]) -> str | None:
    """A known name that begins with the unknown one or the other way round, else the nearest within ``NEAR`` edits; of several the first."""
    rated = [(0 if k.startswith(unknown) or unknown.startswith(k) else edits(unknown, k), i, k) for i, k in enumerate(known)]
    distance, _, name = min(rated, default=(NEAR + 1, 0, None))
    return name if distance <= NEAR else None


class _Given(NamedTuple):
    """One parameter as it was sent, with what its schema says."""

    name: str
    value: object
    rule: dict | None
    required: bool
    known: list[str]

    @property
    def odd_items(self) -> list[str]:
        """Kinds of the items that are of another kind than the schema's."""
        want = self.rule.get("items", {}).get("type")
        return [_kind(v) for v in self.value if want and _kind(v) != want] if isinstance(self.value, list) else []


def _hint(g: _Given) -> str:
    near = suggest(g.name, g.known)
    return f", did you mean '{near}'?" if near else ""


#: What can be wrong: its stage (a lower one is told first), when it holds, and what is said.
CHECKS: list[tuple[int, Callable[[_Given], bool], Callable[[_Given], str]]] = [
    (0, lambda g: g.rule is None, lambda g: f"unknown parameter '{g.name}'{_hint(g)}"),
    (1, lambda g: g.required and g.value is None, lambda g: f"missing parameter '{g.name}'"),
    (2, lambda g: _kind(g.value) != g.rule.get("type", _kind(g.value)), lambda g: f"'{g.name}' must be of type {g.rule['type']}, not {_kind(g.value)}"),
    (2, lambda g: isinstance(g.value, str) and g.value not in g.rule.get("enum", [g.value]), lambda g: f"'{g.name}' must be one of {', '.join(g.rule['enum'])}, not '{g.value}'"),
    (2, lambda g: bool(g.odd_items), lambda g: f"items of '{g.name}' must be of type {g.rule['items']['type']}, not {g.odd_items[0]}"),
]


def violation(schema: dict, params: dict) -> str | None:
    """The first thing wrong by stage, then in the order of the parameters; None if all is well."""
    rules, needed = schema.get("properties", {}), schema.get("required", [])
    given = [_Given(n, params.get(n), rules.get(n), n in needed, list(rules)) for n in dict.fromkeys([*params, *needed])]
    for stage in range(3):
        for g in given:
            if stage < 2 or g.value is not None:
                for at, wrong, say in CHECKS:
                    if at == stage and wrong(g):
                        return say(g)
    return None


def suggestions(typed: DataFrame, known: DataFrame, near: int = NEAR) -> DataFrame:
    """typed, suggestion: for each typed name the nearest known one within some edits, of equally near ones the first; known is a command's few names."""
    d = F.levenshtein("typed", "known")
    return typed.join(F.broadcast(known), d <= near).groupBy("typed").agg(F.min_by("known", F.struct(d, "known")).alias("suggestion"))


def ticket_fields(fields: dict) -> dict:
    """provider, url, project and token, with the old provider-specific names as stand-ins."""
    old = {"url": "gitlab_url", "project": "gitlab_project_id", "token": "gitlab_token"}
    out = {name: next((v for v in (fields.get(name), fields.get(alias)) if v is not None), "") for name, alias in old.items()}
    return {"provider": fields.get("provider") or "gitlab"} | out
