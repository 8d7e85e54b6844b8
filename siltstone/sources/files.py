"""Code trees: scanning, skip and ignore rules, hashes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

# Folders that a scan does not enter, besides those that begin with a dot.
SKIPPED_FOLDERS = (
    "Dommel",
    "TestResults",
    "__pycache__",
    "android",
    "artifacts",
    "bin",
    "build",
    "coverage",
    "dist",
    "electron",
    "fastlane",
    "ios",
    "node_modules",
    "obj",
    "packages",
    "publish",
    "target",
    "vendor",
    "venv",
    "~ExternalLibraries",
)
SKIPPED_FOLDER_PREFIX = "Intra.Old."
# Lock files.
LOCK_FILES = (
    "Gemfile.lock",
    "Pipfile.lock",
    "composer.lock",
    "go.sum",
    "package-lock.json",
    "pnpm-lock.yaml",
    "poetry.lock",
    "yarn.lock",
)

#: Larger files of a branch snapshot are passed over.
MAX_REF_BYTES = 1 << 20
#: Modes of symbolic links and of submodules.
LINK_MODES = ("120000", "160000")


@dataclass(frozen=True)
class Rule:
    pattern: str
    regex: str
    negated: bool


def _to_regex(pattern: str, anchored: bool, folder: bool) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(re.escape(c))
            i += 1
    head = "^" if anchored else "^(?:.*/)?"
    return head + "".join(out) + ("/.+$" if folder else "(?:/.*)?$")


def compile_rules(lines: list[str]) -> list[Rule]:
    """Ignore lines as anchored regular expressions, in order; blank lines and comments go."""
    out = []
    for raw in lines:
        line = raw.rstrip("\r\n")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
        folder = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        body = body.removeprefix("/")
        if body:
            out.append(Rule(line, _to_regex(body, anchored, folder), negated))
    return out


def count_rules(text: str) -> int:
    """Lines that are neither blank nor comments."""
    return sum(1 for line in text.splitlines() if line.strip() and not line.strip().startswith("#"))


#: Rules up to which a column expression is built; beyond, Arrow batches go through automata of so many rules each.
FEW_RULES, RULES_EACH = 40, 200


class Matcher:
    """Ordered rules as few automata: neighbouring rules of one sign are one alternation, and the last rule that fits wins."""

    def __init__(self, rules: list[Rule]):
        groups: list[tuple[bool, list[str]]] = []
        for rule in rules:
            if not groups or groups[-1][0] != rule.negated or len(groups[-1][1]) == RULES_EACH:
                groups.append((rule.negated, []))
            groups[-1][1].append(rule.regex)
        self.groups = [(negated, "|".join(f"(?:{r})" for r in regexes)) for negated, regexes in reversed(groups)]

    def ignored(self, paths: pa.Array) -> np.ndarray:
        """Whether the last rule that fits ignores each path; each automaton sees the paths that no later rule decided."""
        out = np.zeros(len(paths), dtype=bool)
        left = np.arange(len(paths))
        for negated, regex in self.groups:
            if not len(left):
                break
            fits = pc.fill_null(pc.match_substring_regex(paths.take(pa.array(left)), regex), False).to_numpy(zero_copy_only=False)
            out[left[fits]] = not negated
            left = left[~fits]
        return out


def _by_automata(path: Column, rules: list[Rule]) -> Column:
    matcher = Matcher(rules)

    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series(matcher.ignored(pa.array(paths, pa.string())))

    return run(path)


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that fits ignores the path."""
    if len(rules) > FEW_RULES:
        return _by_automata(path, rules)
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(rule.regex), F.lit(not rule.negated)).otherwise(out)
    return out


def forced(path: Column, rules: list[Rule]) -> Column:
    """Whether a ``!`` rule fits: such a path is scanned although its folder is skipped."""
    forcing = [Rule(r.pattern, r.regex, False) for r in rules if r.negated]
    return ignored(path, forcing)


def may_hold_forced(folder: str, rules: list[Rule]) -> bool:
    """Whether a skipped folder must be entered for a ``!`` rule that names it or something below it."""
    for rule in rules:
        if rule.negated:
            body = rule.pattern[1:].strip("/")
            if body == folder or body.startswith(folder + "/"):
                return True
    return False


def skipped_folder(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED_FOLDERS or name.startswith(SKIPPED_FOLDER_PREFIX)


def in_skipped_folder(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED_FOLDERS) | d.startswith(SKIPPED_FOLDER_PREFIX))


def scan(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The files to index, with their language.

    Skipped folders, lock files and files of no language are passed over unless
    a ``!`` rule forces them; ignored paths always are.
    """
    rules = rules or []
    path = F.col("item_path")
    name = F.element_at(F.split(path, "/"), -1)
    skip = in_skipped_folder(path) | name.isin(*LOCK_FILES) | T.language_of(path).isNull()
    return files.filter((~skip | forced(path, rules)) & ~ignored(path, rules)).withColumn("language", T.language_of(path))


def scan_ref(versions: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """A branch snapshot (item_path, mode, size, content): links, submodules, large files and unknown languages go."""
    path = F.col("item_path")
    return versions.filter(~F.col("mode").isin(*LINK_MODES) & (F.col("size") <= MAX_REF_BYTES) & T.language_of(path).isNotNull() & ~ignored(path, rules or [])).withColumn("language", T.language_of(path))


#: Folders that the driver lists before tasks walk the rest, paths that a task reads, and bytes over which a file is not read.
SPREAD, SLICE_FILES, MAX_FILE_BYTES = 256, 500, 64 << 20


def store_of(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(file system, path) of a path or address that pyarrow opens (local disks, HDFS, S3, GCS)."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" not in root:
        return pyarrow.fs.LocalFileSystem(), root.rstrip("/")
    fs, at = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", root))
    return fs, at.rstrip("/")


def _level(fs: pyarrow.fs.FileSystem, base: str, folder: str, rules: list[Rule] | None) -> tuple[list[tuple[str, int]], list[str]]:
    """(files with sizes, folders to enter) right below a folder, by their paths below ``base``.  Links are passed over; without rules every folder is entered."""
    found, folders = [], []
    for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
        name = f"{folder}/{f.base_name}".lstrip("/")
        if isinstance(fs, pyarrow.fs.LocalFileSystem) and os.path.islink(f.path):
            continue
        if f.type == pyarrow.fs.FileType.File:
            found.append((name, f.size))
        elif f.type == pyarrow.fs.FileType.Directory and (rules is None or not skipped_folder(f.base_name) or may_hold_forced(name, rules)):
            folders.append(name)
    return found, folders


def list_tree(spark: SparkSession, root: str, rules: list[Rule] | None = None) -> DataFrame:
    """item_path, size of the files below ``root``, whatever their names; no contents are read.

    With rules, skipped folders are not entered unless one may force something in
    them.  The driver lists the first levels; once there are ``SPREAD`` folders,
    tasks walk them.  Spark's own file index is no use here: it passes over names
    that begin with ``_`` or ``.``.
    """
    fs, base = store_of(root)
    if fs.get_file_info(base).type != pyarrow.fs.FileType.Directory:  # an empty listing would empty the source's index
        raise FileNotFoundError(root)
    rows: list[tuple[str, int]] = []
    folders = [""]
    while folders and len(folders) < SPREAD:
        below: list[str] = []
        for folder in folders:
            found, inside = _level(fs, base, folder, rules)
            rows += found
            below += inside
        folders = below
    near = spark.createDataFrame(rows, "item_path string, size long")
    if not folders:
        return near

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(root)
        for b in batches:
            left = b.column(0).to_pylist()
            while left:
                found, inside = _level(fs, base, left.pop(), rules)
                left += inside
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["item_path", "size"])

    far = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 4 * SPREAD)).mapInArrow(walk, "item_path string, size long")
    return near.unionByName(far)


def read_files(listed: DataFrame, root: str, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``listed`` (item_path, size, ...) with the files' contents as text; a file that is gone meanwhile, or over ``most_bytes``, goes."""
    names = listed.columns
    at = names.index("item_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(root)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                texts = []
                for path in part.column(at).to_pylist():
                    try:
                        with fs.open_input_stream(f"{base}/{path}") as stream:
                            texts.append(stream.read().decode("utf-8", "replace"))
                    except FileNotFoundError:
                        texts.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "content"])

    small = listed.filter(F.col("size") <= most_bytes).persist()
    tasks = max(1, -(-small.count() // SLICE_FILES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return small.repartition(tasks).mapInArrow(run, f"{schema}, content string").filter("content is not null")


def write_files(rows: DataFrame, root: str) -> None:
    """Write rows (item_path, text) as files below ``root``; a task that runs again writes the same files."""

    def put(part: Iterator) -> None:
        fs, base = store_of(root)
        for r in part:
            fs.create_dir(f"{base}/{r['item_path']}".rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{base}/{r['item_path']}") as out:
                out.write(r["text"].encode())

    rows.foreachPartition(put)


def read_tree(spark: SparkSession, root: str, rules: list[Rule] | None = None) -> DataFrame:
    """item_path, content, hash, language of the files of a tree that are to be indexed; no others are read."""
    kept = scan(list_tree(spark, root, rules or []), rules)
    return read_files(kept, root).select("item_path", "content", T.content_hash(F.col("content")).alias("hash"), "language")
