"""Deterministic symbol lookup."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import branches

MAX_LIMIT = 200


def symbol_predicate(symbol: Column, name: str, match: str = "suffix", case_sensitive: bool = True, literal: bool = False) -> Column:
    """Exact or suffix match of a dotted symbol.

    In a suffix ``_`` and ``%`` are wildcards unless ``literal``.
    """
    if match not in ("exact", "suffix"):
        raise ValueError(f"match must be exact or suffix, not {match}")
    left, right = (symbol, name) if case_sensitive else (F.lower(symbol), name.lower())
    same = left == right
    if match == "exact":
        return same
    pattern = right.replace("\\", "\\\\")
    if literal:
        pattern = pattern.replace("%", r"\%").replace("_", r"\_")
    return same | left.like(f"%.{pattern}")


def symbol_index(chunks: DataFrame) -> DataFrame:
    """low (the symbol in lower case, read backwards) and chunk_id, in the order in which they are kept: what ends alike stands together."""
    named = chunks.filter(F.coalesce("symbol_name", F.lit("")) != "")
    return named.select(F.reverse(F.lower("symbol_name")).alias("low"), "chunk_id").repartitionByRange("low").sortWithinPartitions("low")


def candidates(index: DataFrame, name: str, literal: bool = False) -> DataFrame:
    """chunk_id of the symbols that end as ``name`` does after its last wildcard: a range of the index, so its statistics skip what lies outside."""
    tail = name if literal else re.split("[%_]", name)[-1]
    return index.filter(F.col("low").startswith(F.reverse(F.lower(F.lit(tail))))).select("chunk_id")


def lookup_symbol(chunks: DataFrame, tags: DataFrame, name: str, match: str = "suffix", case_sensitive: bool = True, branch: str | None = None, limit: int = 50, literal: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Chunks that declare a symbol, with their branches, ordered by language, path and line.

    With an index (see ``symbol_index``) only its candidates are looked at.

    The limit applies after the sort, so which rows stay is determined.
    """
    name = name.strip()
    if not name:
        raise ValueError("symbol name is empty")
    if limit > MAX_LIMIT:
        raise ValueError(f"limit is at most {MAX_LIMIT}")
    if index is not None:
        chunks = chunks.join(candidates(index, name, literal), "chunk_id", "left_semi")
    found = chunks.filter((F.coalesce("symbol_name", F.lit("")) != "") & symbol_predicate(F.col("symbol_name"), name, match, case_sensitive, literal))
    if branch is not None and branch != "*":
        found = found.join(tags.filter(F.col("branch") == branch).select("chunk_id"), "chunk_id", "left_semi")
    order = ["language", "item_path", "start_line", "chunk_id"]
    return branches.annotate(found.orderBy(*order).limit(limit), tags).orderBy(*order)
