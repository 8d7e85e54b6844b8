"""Garbage collection, jobs, health, migrations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: An index is collected when more than this share of its rows has no tag.
ORPHAN_RATIO = 0.15
TERMINAL = ("done", "failed", "cancelled", "interrupted")
KEEP_DAYS, KEEP_NEWEST = 7, 1000
SCHEMA_VERSION, AWAIT_CHUNKS = 2, 50_000
#: Versions of a table over which it is bloated, and rows by which the ids of an old table are tried.
MANY_VERSIONS, TRIED_ROWS = 20, 1000


def orphans(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Chunks without any tag."""
    return chunks.join(tags.select("chunk_id"), "chunk_id", "left_anti")


def collect_garbage(chunks: DataFrame, tags: DataFrame, dry_run: bool = False) -> DataFrame:
    """What is left after orphans go; with ``dry_run`` their count by source."""
    if dry_run:
        return orphans(chunks, tags).groupBy("source_id").agg(F.count(F.lit(1)).alias("orphans"))
    return chunks.join(tags.select("chunk_id"), "chunk_id", "left_semi")


def orphan_ratio(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """source_id, n_rows, tagged, ratio, due: whether a source should be collected."""
    has = chunks.join(tags.select("chunk_id").distinct().withColumn("__t", F.lit(1)), "chunk_id", "left")
    by = has.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("__t").alias("tagged"))
    ratio = (F.col("n_rows") - F.col("tagged")) / F.col("n_rows")
    return by.withColumn("ratio", F.round(ratio, 9)).withColumn("due", ratio > ORPHAN_RATIO)


def recent_jobs(jobs: DataFrame, status: str | None = None, project: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """The newest jobs by queue time."""
    for column, value in (("status", status), ("project_id", project), ("type", kind)):
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.desc("queued_at"), F.desc("job_id")).limit(limit)


def queue_status(jobs: DataFrame) -> DataFrame:
    """Running jobs by start, queued ones by queue time, with their position."""
    at = F.when(F.col("status") == "running", F.col("started_at")).otherwise(F.col("queued_at"))
    order = Window.partitionBy("status", "project_id").orderBy("__at", "job_id")
    live = jobs.filter(F.col("status").isin("running", "queued")).withColumn("__at", at)
    return live.withColumn("position", F.row_number().over(order).cast("long")).select("job_id", "project_id", "status", "position")


def prune_jobs(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Jobs that stay: those that are not over, young ones, and the newest thousand that are over."""
    over = F.col("status").isin(*TERMINAL)
    newest = jobs.filter(over).orderBy(F.desc("finished_at"), F.desc("job_id")).limit(KEEP_NEWEST).select("job_id")
    old = jobs.filter(over & (F.col("finished_at") < now_ms - KEEP_DAYS * 86_400_000)).join(newest, "job_id", "left_anti")
    return jobs.join(old.select("job_id"), "job_id", "left_anti")


def last_gc(jobs: DataFrame) -> DataFrame:
    """project_id, last_gc_at: the last finished collection, null where the last one failed."""
    gc = jobs.filter((F.col("type") == "gc") & F.col("status").isin("done", "failed"))
    by = gc.groupBy("project_id").agg(F.max_by("status", F.struct("finished_at", "job_id")).alias("__s"), F.max(F.when(F.col("status") == "done", F.col("finished_at"))).alias("__at"))
    return by.select("project_id", F.when(F.col("__s") == "done", F.col("__at")).alias("last_gc_at"))


def job_rollup(tasks: DataFrame) -> DataFrame:
    """job_id, status, error: failed if any task failed, else cancelled if any was, else done; the first error."""
    failed, cancelled = F.bool_or(F.col("status") == "failed"), F.bool_or(F.col("status") == "cancelled")
    by = tasks.groupBy("job_id").agg(failed.alias("__f"), cancelled.alias("__c"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("task_no"))).alias("error"))
    return by.select("job_id", F.when(F.col("__f"), "failed").when(F.col("__c"), "cancelled").otherwise("done").alias("status"), "error")


def duplicate_jobs(jobs: DataFrame) -> DataFrame:
    """Queued jobs that ask for what an earlier queued job asks for."""
    same = Window.partitionBy("project_id", "source_id", "mode", "branch").orderBy("queued_at", "job_id")
    return jobs.filter(F.col("status") == "queued").withColumn("__n", F.row_number().over(same)).filter("__n > 1").select("job_id", "project_id", "source_id", "mode", "branch")


def reconcile_jobs(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """At start: live jobs of unknown projects are cancelled, others interrupted."""
    known = projects.select("project_id").distinct().withColumn("__k", F.lit(True))
    live = F.col("status").isin("running", "queued")
    status = F.when(live & F.col("__k").isNull(), "cancelled").when(live, "interrupted").otherwise(F.col("status"))
    return jobs.join(known, "project_id", "left").withColumn("status", status).drop("__k").select(*jobs.columns)


def preempt_gc(jobs: DataFrame, project: str | None = None) -> DataFrame:
    """Queued collections in scope (all projects where none is named) are cancelled."""
    hit = (F.col("type") == "gc") & (F.col("status") == "queued")
    if project is not None:
        hit = hit & (F.col("project_id") == project)
    return jobs.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def rehash(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, id map): ids of the second scheme, old ticket paths rewritten, first row of an id kept.

    chunks: project_id, source_id, item_path, item_url, item_type, language,
    content and the rest; the map has old_id and new_id.
    """
    path = T.ticket_path(F.col("item_path"), F.col("item_url"))
    moved = chunks.withColumn("item_path", path).withColumn("old_id", F.col("chunk_id"))
    moved = moved.withColumn("chunk_id", T.chunk_id(*(F.col(c) for c in ("project_id", "source_id", "item_path", "item_url", "item_type", "content"))))
    mapping = moved.select("old_id", F.col("chunk_id").alias("new_id")).distinct()
    others = [c for c in chunks.columns if c != "chunk_id"]
    first = moved.groupBy("chunk_id").agg(F.min_by(F.struct(*others), F.col("old_id")).alias("__r")).select("chunk_id", "__r.*")
    return first.select(*chunks.columns), mapping


def legacy_mismatches(chunks: DataFrame, tried: int = TRIED_ROWS) -> DataFrame:
    """n_tried, n_wrong: how many of some rows have an id that is not the first scheme's; a table with any is not rewritten."""
    some = chunks.orderBy("chunk_id").limit(tried)
    right = T.legacy_chunk_id(*(F.col(c) for c in ("project_id", "source_id", "language", "content")))
    return some.agg(F.count(F.lit(1)).alias("n_tried"), F.count(F.when(F.col("chunk_id") != right, 1)).alias("n_wrong"))


def rewrite_tags(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tags with new ids; ids that the map lacks stay, and a tag is there once."""
    one = mapping.groupBy(F.col("old_id").alias("chunk_id")).agg(F.min("new_id").alias("__new"))
    return tags.join(one, "chunk_id", "left").withColumn("chunk_id", F.coalesce("__new", "chunk_id")).drop("__new").select(*tags.columns).distinct()


def schema_scan(sources: DataFrame) -> DataFrame:
    """source_id, decision: whether a source must be embedded anew."""
    decision = (
        F.when(F.coalesce("schema_version", F.lit(0)) >= SCHEMA_VERSION, "skip_current")
        .when(F.col("provider") != "local", "skip_remote")
        .when(F.col("active_job"), "skip_active")
        .when(F.col("n_chunks") >= AWAIT_CHUNKS, "await_confirmation")
        .otherwise("enqueue")
    )
    return sources.select("source_id", decision.alias("decision"))


def pending_migrations(ledger: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations not yet applied, in order."""
    return ledger.join(applied.select("migration_id"), "migration_id", "left_anti").orderBy("seq")


def health(manifest: DataFrame, files: DataFrame, dims: int | None = None) -> DataFrame:
    """table_name, health: schema_unreadable (an empty manifest file), manifest_missing_data (a listed file is gone), dim_mismatch, healthy."""
    there = files.select("path", F.lit(True).alias("__there"))
    by = (
        manifest.join(there, "path", "left")
        .groupBy("table_name")
        .agg(F.bool_or(F.col("is_manifest") & (F.col("size") == 0)).alias("__empty"), F.bool_or(~F.col("is_manifest") & F.col("__there").isNull()).alias("__gone"), F.max("dims").alias("__dims"), F.max("n_rows").alias("__rows"))
    )
    wrong = (F.col("__dims") != F.lit(dims)) & (F.col("__rows") > 0) if dims is not None else F.lit(False)
    return by.select("table_name", F.when(F.col("__empty"), "schema_unreadable").when(F.col("__gone"), "manifest_missing_data").when(wrong, "dim_mismatch").otherwise("healthy").alias("health"))


def source_flags(sources: DataFrame) -> DataFrame:
    """source_id, flags: bloat (over 20 versions), needs_migration, corrupt, model_mismatch."""
    tests = [("bloat", F.col("versions") > MANY_VERSIONS), ("needs_migration", F.coalesce("scheme", F.lit(0)) < 2), ("corrupt", F.col("health") != "healthy"), ("model_mismatch", F.col("model") != F.col("configured_model"))]
    return sources.select("source_id", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests))).alias("flags"))


def doctor_checks(sources: DataFrame) -> DataFrame:
    """check, project_id, source_id, status for each source (indexed, health, scheme, versions, ratio, unsearchable)."""
    there = F.col("indexed")

    def found(bad: Column, status: str) -> Column:
        return F.when(~there, "skip").when(bad, status).otherwise("ok")

    checks = {
        "indexed": F.when(there, "ok").otherwise("warn"),
        "health": F.when(~there, "skip").when(F.col("health") == "healthy", "ok").when(F.col("health") == "unknown", "warn").otherwise("fail"),
        "id_scheme": found(F.coalesce("scheme", F.lit(0)) < 2, "fail"),
        "versions": found(F.col("versions") > MANY_VERSIONS, "warn"),
        "orphans": found(F.coalesce("ratio", F.lit(0.0)) > ORPHAN_RATIO, "warn"),
        "searchable": found(F.col("unsearchable").isNotNull(), "fail"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), status.alias("status")) for name, status in checks.items())))
    return sources.select("project_id", "source_id", each.alias("c")).select("c.check", "project_id", "source_id", "c.status")


def job_checks(jobs: DataFrame, now_ms: int) -> DataFrame:
    """One check: whether a job has failed in the last day."""
    failed = F.count(F.when((F.col("status") == "failed") & (F.col("finished_at") > now_ms - 86_400_000), 1))
    return jobs.agg(failed.alias("n")).select(F.lit("jobs").alias("check"), F.lit("").alias("project_id"), F.lit("").alias("source_id"), F.when(F.col("n") > 0, "warn").otherwise("ok").alias("status"))


def check_counts(checks: DataFrame) -> DataFrame:
    """One row with the number of ok, warn, fail and skip checks."""
    return checks.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("ok", "warn", "fail", "skip")))


def language_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def main_language(files: DataFrame) -> DataFrame:
    """One row: the commonest language if it has more than 1.5 times the next one's files, else ``mixed``."""
    by = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    two = by.orderBy(F.desc("n"), "language").limit(2).agg(F.max("n").alias("__a"), F.min("n").alias("__b"), F.count(F.lit(1)).alias("__k"), F.max_by("language", F.struct(F.col("n"))).alias("__l"))
    return two.select(F.when((F.col("__k") == 1) | (F.col("__a") > 1.5 * F.col("__b")), F.col("__l")).otherwise("mixed").alias("main_language"))


def token_cost(chunks: DataFrame, per_chunk: int = 500) -> DataFrame:
    return chunks.groupBy("source_id").agg((F.count(F.lit(1)) * per_chunk).alias("tokens"))


def upgrade_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs of the third store version get the type and result columns of the fourth."""
    out = jobs if "type" in jobs.columns else jobs.withColumn("type", F.lit("reindex"))
    return out if "result" in out.columns else out.withColumn("result", F.lit(None).cast("string"))


def store_steps(version: int | None) -> list[str]:
    """What opening a store of an older version asks for, in order."""
    version = version or 0
    return (["reset"] if version < 2 else []) + (["upgrade_jobs"] if version < 4 else [])


def to_refetch(sources: DataFrame) -> DataFrame:
    """Knowledge sources whose table is of an older schema: it is recreated, the cursor cleared, the tags wiped."""
    return sources.filter((F.col("profile") == "text") & (F.coalesce("knowledge_schema_version", F.lit(0)) < SCHEMA_VERSION)).select("project_id", "source_id")


def unreferenced(folders: DataFrame, manifests: DataFrame) -> DataFrame:
    """Index folders (path, bytes) that no kept manifest (path) names."""
    return folders.join(manifests.select("path"), "path", "left_anti")
