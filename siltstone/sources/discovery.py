"""Finding repositories in a listing of paths, and a first ignore file for one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

from .files import SKIPPED_FOLDERS

DEPTH = 3
# Folders in which no repository is looked for.
PASSED_OVER = (
    "__pycache__",
    "build",
    "dist",
    "node_modules",
    "target",
    "vendor",
    "venv",
)


def repositories(listing: DataFrame, depth: int = DEPTH) -> DataFrame:
    """root, n_files, language of each repository that a listing (item_path) shows: a folder with ``.git`` in it.

    Only folders down to ``depth`` count, none below another repository and none
    in a folder that is passed over.
    """
    path = F.col("item_path")
    marks = listing.select(F.regexp_extract(path, r"^(?:(.*?)/)?\.git(?:/|$)", 1).alias("root")).filter(path.rlike(r"(^|/)\.git(/|$)")).distinct()
    parts = F.filter(F.split("root", "/"), lambda p: p != "")
    found = marks.filter((F.size(parts) <= depth) & ~F.exists(parts, lambda p: p.isin(*PASSED_OVER) | p.startswith(".")))
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nested = found.select("root", F.explode(F.when(F.size(parts) > 0, above).otherwise(F.array().cast("array<string>"))).alias("up")).join(found.select(F.col("root").alias("up")), "up", "left_semi")
    roots = found.join(nested.select("root"), "root", "left_anti")
    files = listing.filter(~path.rlike(r"(^|/)\.git(/|$)")).withColumn("language", T.language_of(path)).filter("language is not null")
    folders = F.filter(F.split(path, "/"), lambda p: p != "")
    owners = F.transform(F.sequence(F.lit(0), F.least(F.lit(depth), F.size(folders) - 1)), lambda n: F.array_join(F.slice(folders, 1, n), "/"))
    owned = files.select("language", F.explode(owners).alias("root")).join(roots, "root", "left_semi")
    counts = owned.groupBy("root", "language").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("root").agg(F.sum("n").alias("n_files"), F.max_by("language", F.struct("n", "language")).alias("__first"), F.array_sort(F.collect_list("n")).alias("__n"))
    two = F.size("__n") >= 2
    ahead = F.element_at("__n", -1) > 1.5 * F.element_at("__n", F.when(two, F.lit(-2)).otherwise(F.lit(-1)))
    language = F.when(~two | ahead, F.col("__first")).otherwise("mixed")
    return roots.join(best, "root", "left").select("root", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.when(F.col("__n").isNotNull(), language).alias("language"))


def default_ignore(gitignore: str = "") -> str:
    """An ignore file's first text: the rules of ``.gitignore`` and the folders and files that are seldom wanted."""
    own = [line.strip() for line in gitignore.splitlines() if line.strip() and not line.strip().startswith("#")]
    standard = [f"{d}/" for d in SKIPPED_FOLDERS] + ["*.min.js", "*.min.css", "*.map", "*.lock"]
    return "\n".join(["# Paths that are not indexed.", *dict.fromkeys([*own, *standard])]) + "\n"
