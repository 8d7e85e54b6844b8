"""The branch-membership relation: which chunk is on which branch, and where in its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = ["project_id", "source_id"]
EPHEMERAL = "_ephemeral/"


def list_branches(tags: DataFrame) -> DataFrame:
    return tags.select(*SOURCE, "branch").distinct()


def chunks_on(tags: DataFrame, branch: str | None = None) -> DataFrame:
    """Distinct chunk ids of a branch, or of all."""
    rows = tags if branch is None else tags.filter(F.col("branch") == branch)
    return rows.select(*SOURCE, "chunk_id").distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_tags"))


def ephemeral_branches(tags: DataFrame) -> DataFrame:
    return list_branches(tags).filter(F.col("branch").startswith(EPHEMERAL))


def resolve(names: DataFrame, tags: DataFrame) -> DataFrame:
    """name, resolved: the branch itself, else with origin/ added or taken off, else null."""
    other = F.when(F.col("name").startswith("origin/"), F.substr("name", F.lit(8))).otherwise(F.concat(F.lit("origin/"), F.col("name")))
    tried = names.select("name", F.posexplode(F.array("name", other)).alias("rank", "branch"))
    found = tried.join(tags.select("branch").distinct(), "branch").groupBy("name").agg(F.min_by("branch", "rank").alias("resolved"))
    return names.select("name").distinct().join(found, "name", "left")


def ordered(branches: Column) -> Column:
    """master and main first, then by name."""
    keyed = F.transform(branches, lambda b: F.struct(F.when(b == "master", 0).when(b == "main", 1).otherwise(2).alias("k"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda x: x["b"])


def annotate(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds branches, the sorted names a row's chunk is on; an unknown chunk has none.

    Names are made distinct before they are gathered, so a list is as long as a
    source has branches.
    """
    names = tags.select("chunk_id", "branch").distinct().groupBy("chunk_id").agg(ordered(F.collect_list("branch")).alias("branches"))
    return rows.join(names, "chunk_id", "left").withColumn("branches", F.coalesce("branches", F.array().cast("array<string>")))


def without_branch(tags: DataFrame, branch: str) -> DataFrame:
    return tags.filter(F.col("branch") != branch)


def wipe_source(rows: DataFrame, project: str, source: str) -> DataFrame:
    return rows.filter(~((F.col("project_id") == project) & (F.col("source_id") == source)))


def relabel_origin(tags: DataFrame) -> DataFrame:
    """origin/x becomes x; where both were there, the rows of origin/x win for the whole branch."""
    logical = F.regexp_replace("branch", "^origin/", "")
    qualified = F.col("branch").startswith("origin/")
    winners = tags.filter(qualified).select(*SOURCE, logical.alias("branch")).distinct()
    kept = tags.filter(~qualified).join(winners, [*SOURCE, "branch"], "left_anti")
    return kept.unionByName(tags.filter(qualified).withColumn("branch", logical).select(*tags.columns))


def pin(sources: DataFrame, branches: list[str]) -> DataFrame:
    """Adds branches to pinned_branches, in order, each once."""
    return sources.withColumn("pinned_branches", F.array_union(F.coalesce("pinned_branches", F.array().cast("array<string>")), F.array(*map(F.lit, branches))))


def unpin(sources: DataFrame, branches: list[str]) -> DataFrame:
    return sources.withColumn("removed", F.array_intersect("pinned_branches", F.array(*map(F.lit, branches)))).withColumn("pinned_branches", F.array_except("pinned_branches", F.array(*map(F.lit, branches))))
