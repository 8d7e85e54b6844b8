"""What a repository says of its branches, read through Hadoop's file system."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: The branch of what is no repository.
ANY = "*"
_SHA = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?")


def _text(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    except Py4JJavaError:
        return None
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _git_folder(spark: SparkSession, root: str) -> str:
    """The folder of the repository's own files; a worktree's ``.git`` is a file that points to it."""
    pointer = _text(spark, f"{root.rstrip('/')}/.git")
    if pointer is None or not pointer.startswith("gitdir:"):
        return f"{root.rstrip('/')}/.git"
    to = pointer.removeprefix("gitdir:").strip()
    scheme = root.split("://")[0] + "://" if "://" in root else ""
    return scheme + to if to.startswith("/") else f"{root.rstrip('/')}/{to}"


def head_branch(spark: SparkSession, root: str) -> str:
    """The checked-out branch; the first twelve digits of a detached commit; ``*`` where there is no repository."""
    head = _text(spark, f"{_git_folder(spark, root)}/HEAD")
    if head is None:
        return ANY
    if head.startswith("ref:"):
        return head.removeprefix("ref:").strip().removeprefix("refs/heads/")
    return head[:12] if _SHA.fullmatch(head) else ANY


def _lookup(spark: SparkSession, folders: list[str], name: str) -> str | None:
    """What a full ref name stands for, loose or packed."""
    for at in folders:
        sha = _text(spark, f"{at}/{name}")
        if sha and _SHA.fullmatch(sha):
            return sha
        for line in (_text(spark, f"{at}/packed-refs") or "").splitlines():
            if line.endswith(f" {name}") and _SHA.fullmatch(line.split()[0]):
                return line.split()[0]
    return None


def ref_of(spark: SparkSession, root: str, name: str) -> str | None:
    """The object that a full ref name (refs/...) stands for; None where it is unknown."""
    folder = _git_folder(spark, root)
    shared = _text(spark, f"{folder}/commondir")
    return _lookup(spark, [folder, *([f"{folder}/{shared}"] if shared else [])], name)


def commit_of(spark: SparkSession, root: str, branch: str) -> str | None:
    """The commit that a branch (or origin/branch) points to, loose or packed; None where it is unknown."""
    folder = _git_folder(spark, root)
    shared = _text(spark, f"{folder}/commondir")
    folders = [folder, *([f"{folder}/{shared}"] if shared else [])]
    names = [f"refs/remotes/{branch}", f"refs/heads/{branch}"] if branch.startswith("origin/") else [f"refs/heads/{branch}", f"refs/remotes/origin/{branch}"]
    for name in names:
        sha = _lookup(spark, folders, name)
        if sha is not None:
            return sha
    head = _text(spark, f"{folder}/HEAD") or ""
    return head if _SHA.fullmatch(head) and head[:12] == branch else None
