"""Snapshot differences and the incremental bookkeeping around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to which their hashes are broadcast.
FEW = 1_000_000


def snapshot_diff(old: DataFrame, new: DataFrame, keep_missing: bool = False) -> DataFrame:
    """path, old_hash, new_hash, change (added, changed, removed, same) from two (path, hash) snapshots.

    ``keep_missing``: a cursor scan only lists what changed, so a path that is
    missing from it stays as it was.
    """
    both = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full_outer")
    gone = F.lit("same") if keep_missing else F.lit("removed")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), gone).when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return both.withColumn("change", change)


def merged_snapshot(diff: DataFrame) -> DataFrame:
    """path, hash after the diff is applied."""
    return diff.filter("change <> 'removed'").select("path", F.coalesce("new_hash", "old_hash").alias("hash"))


def unknown_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks whose id is not known yet: only these are embedded."""
    return chunks.join(known.select("chunk_id"), "chunk_id", "left_anti")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is one of ``keys``; of at most ``FEW`` keys the hashes go to the rows, and only rows that have one are shuffled."""
    keys = keys.select(key)
    some = _hashed(keys, key)
    return (rows if some is None else rows.join(some, F.xxhash64(key) == F.col("__h"), "left_semi")).join(keys, key, "left_semi").select(*rows.columns)


def not_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is none of ``keys``, shuffled as ``among`` does."""
    keys = keys.select(key)
    some = _hashed(keys, key)
    if some is None:
        return rows.join(keys, key, "left_anti").select(*rows.columns)
    same = F.xxhash64(key) == F.col("__h")
    near = rows.join(some, same, "left_semi").join(keys, key, "left_anti").select(*rows.columns)
    return rows.join(some, same, "left_anti").unionByName(near)


def _hashed(keys: DataFrame, key: str) -> DataFrame | None:
    return None if keys.limit(FEW + 1).count() > FEW else F.broadcast(keys.select(F.xxhash64(key).alias("__h")))


def without_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that gave no chunk; they still get a hash."""
    return files.join(chunks.select("item_path"), "item_path", "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Merge on key: matched rows are replaced, others are added."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def apply_files(tags: DataFrame, outcomes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Branch tags after a run.

    ``outcomes`` (item_path, outcome): removed and stale files lose their tags,
    embedded ones too before ``fresh`` adds theirs; a tag is there once.
    """
    kept = tags.join(outcomes.filter(F.col("outcome").isin("removed", "stale", "embedded")).select("item_path").distinct(), "item_path", "left_anti")
    return kept.unionByName(fresh).distinct()


def run_summary(diff: DataFrame, chunks: DataFrame, known: DataFrame) -> DataFrame:
    """One row: scanned, reindexed, removed, prepared and persisted counts of an index run."""
    files = diff.agg(F.sum((F.col("change") != "removed").cast("long")).alias("scanned"), F.sum(F.col("change").isin("added", "changed").cast("long")).alias("reindexed"), F.sum((F.col("change") == "removed").cast("long")).alias("removed"))
    prepared = chunks.agg(F.count(F.lit(1)).alias("prepared"))
    persisted = unknown_chunks(chunks.select("chunk_id").distinct(), known).agg(F.count(F.lit(1)).alias("persisted"))
    one = [d.withColumn("__one", F.lit(1)) for d in (files, prepared, persisted)]
    return one[0].join(one[1], "__one").join(one[2], "__one").drop("__one")
