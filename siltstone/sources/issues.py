"""Issue trackers: raw issues and comments to knowledge items, and metadata at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: A cursor scan looks back this many seconds, for edits made while a run was under way.
OVERLAP_SECONDS = 60

ISSUE = "key string, number long, title string, description string, author string, updated_at string, url string, state string, labels array<string>, milestone struct<title: string, due_date: string>, assignees array<string>, confidential boolean"
NOTE = "key string, note string, body string, author string, created_at string, system boolean"


def since(raw: DataFrame, cursor: str | None) -> DataFrame:
    """Issues updated after the cursor less the overlap; all of them without one."""
    if cursor is None:
        return raw
    return raw.filter(F.to_timestamp("updated_at") > F.to_timestamp(F.lit(cursor)) - F.make_dt_interval(secs=F.lit(OVERLAP_SECONDS)))


def updated_map(raw: DataFrame) -> DataFrame:
    """path, hash: the time of an issue's last change stands for its content, as a snapshot to compare."""
    return raw.select(F.col("key").alias("path"), F.col("updated_at").alias("hash"))


def from_gitlab(raw: DataFrame) -> DataFrame:
    """Issues as the first provider has them (iid, author.username, milestone, ...)."""
    return raw.select(
        F.concat(F.lit("issues/"), F.col("iid").cast("string")).alias("key"),
        F.col("iid").cast("long").alias("number"),
        "title",
        "description",
        F.col("author.username").alias("author"),
        "updated_at",
        F.col("web_url").alias("url"),
        "state",
        "labels",
        F.when(F.col("milestone").isNotNull(), F.struct(F.col("milestone.title").alias("title"), F.col("milestone.due_date").alias("due_date"))).alias("milestone"),
        F.col("assignees.username").alias("assignees"),
        "confidential",
    )


def from_github(raw: DataFrame) -> DataFrame:
    """Issues as the second provider has them; pull requests go, an author may be unknown, nothing is confidential."""
    return raw.filter(F.col("pull_request").isNull()).select(
        F.concat(F.lit("issues/"), F.col("number").cast("string")).alias("key"),
        F.col("number").cast("long").alias("number"),
        "title",
        F.col("body").alias("description"),
        F.coalesce("user.login", F.lit("unknown")).alias("author"),
        "updated_at",
        F.col("html_url").alias("url"),
        "state",
        F.col("labels.name").alias("labels"),
        F.when(F.col("milestone").isNotNull(), F.struct(F.col("milestone.title").alias("title"), F.lit(None).cast("string").alias("due_date"))).alias("milestone"),
        F.col("assignees.login").alias("assignees"),
        F.lit(False).alias("confidential"),
    )


# What is read of the providers' issues and notes.
GITLAB_ISSUE = "iid long, title string, description string, author struct<username: string>, updated_at string, web_url string, state string, labels array<string>, milestone struct<title: string, due_date: string>, assignees array<struct<username: string>>, confidential boolean"
GITLAB_NOTE = "id long, body string, author struct<username: string>, created_at string, system boolean"
GITHUB_ISSUE = "number long, title string, body string, user struct<login: string>, updated_at string, html_url string, state string, labels array<struct<name: string>>, milestone struct<title: string>, assignees array<struct<login: string>>, pull_request struct<url: string>"
GITHUB_NOTE = "id long, body string, user struct<login: string>, created_at string"


def from_tracker(rows: DataFrame, provider: str = "gitlab") -> tuple[DataFrame, DataFrame]:
    """(issues, notes) of one project's rows of the tracker source; a row that was read twice counts once."""
    github = provider == "github"

    def bodies(kind: str, schema: str, *keys: str) -> DataFrame:
        parsed = rows.filter(F.col("kind") == kind).select("number", F.from_json("body", schema).alias("b"))
        return parsed.select(F.col("number").alias("__number"), "b.*").dropDuplicates(list(keys))

    raw = bodies("issue", GITHUB_ISSUE if github else GITLAB_ISSUE, "__number").drop("__number")
    said = bodies("note", GITHUB_NOTE if github else GITLAB_NOTE, "__number", "id")
    notes = said.select(
        F.concat(F.lit("issues/"), F.col("__number").cast("string")).alias("key"),
        F.col("id").cast("string").alias("note"),
        "body",
        (F.coalesce("user.login", F.lit("unknown")) if github else F.col("author.username")).alias("author"),
        F.nullif("created_at", F.lit("")).alias("created_at"),
        (F.lit(False) if github else F.col("system")).alias("system"),
    )
    return (from_github if github else from_gitlab)(raw), notes


def tracker_items(rows: DataFrame, provider: str = "gitlab") -> DataFrame:
    """Knowledge items of one project's rows of the tracker source."""
    if provider == "github":
        return items(*from_tracker(rows, provider), note_suffix="comment_", anchor="issuecomment-")
    return items(*from_tracker(rows, provider))


def from_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The driver's conversations as (issues, notes): turn 0 opens an issue, later turns are its notes, system ones system notes."""
    conv = F.col("conv_id")
    key = F.concat(F.lit("issues/"), conv.cast("string"))
    n_labels = conv % 3
    raw = rows.filter("turn = 0").select(
        key.alias("key"),
        conv.alias("number"),
        F.concat(F.lit("Issue "), conv.cast("string")).alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("u"), (conv % 7).cast("string")).alias("author"),
        F.lit("2024-01-01T00:00:00Z").alias("updated_at"),
        F.concat(F.lit("https://host/"), key).alias("url"),
        F.when(conv % 2 == 0, "opened").otherwise("closed").alias("state"),
        F.when(n_labels == 0, F.array().cast("array<string>")).when(n_labels == 1, F.array(F.lit("l0"))).otherwise(F.array(F.lit("l0"), F.lit("l1"))).alias("labels"),
        F.when(conv % 5 == 0, F.struct(F.concat(F.lit("m"), conv.cast("string")).alias("title"), F.lit(None).cast("string").alias("due_date"))).alias("milestone"),
        F.array().cast("array<string>").alias("assignees"),
        (conv % 4 == 0).alias("confidential"),
    )
    notes = rows.filter("turn > 0").select(key.alias("key"), F.col("turn").cast("string").alias("note"), F.col("text").alias("body"), F.col("role").alias("author"), F.lit(None).cast("string").alias("created_at"), (F.col("role") == "system").alias("system"))
    return raw, notes


def items(raw: DataFrame, notes: DataFrame, note_suffix: str = "note_", anchor: str | None = None) -> DataFrame:
    """Knowledge items: one for each issue's body and one for each note that is neither blank nor a system note.

    A note has its own author and time (the issue's where it has none) and the
    issue's metadata; its url ends in ``anchor`` (the suffix of its path where none
is given) and its id.  Metadata are strings: JSON lists and objects, true/false,
    empty where absent.
    """
    blank = F.coalesce(F.col("description"), F.lit(""))
    head = raw.select(
        F.col("key").alias("__key"),
        F.col("url").alias("__url"),
        F.col("author").alias("__author"),
        "updated_at",
        F.concat(F.lit("# "), "title", F.lit("\n\n"), T.trim_blank(blank)).alias("__body"),
        F.when(F.col("state").isin("opened", "open"), "open").otherwise("closed").alias("state"),
        F.to_json(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"),
        F.to_json(F.coalesce("assignees", F.array().cast("array<string>"))).alias("assignees"),
        F.coalesce(F.to_json("milestone", {"ignoreNullFields": "false"}), F.lit("")).alias("milestone"),
        F.when(F.coalesce("confidential", F.lit(False)), "true").otherwise("false").alias("confidential"),
    )
    meta = ["state", "labels", "assignees", "milestone", "confidential"]
    bodies = head.select(F.col("__key").alias("item_path"), F.col("__url").alias("item_url"), F.lit("issue").alias("item_type"), F.col("__author").alias("author"), F.col("updated_at").alias("timestamp"), T.normalize_content(T.trim_blank(F.col("__body"))).alias("content"), *meta)
    said = notes.filter(~F.coalesce("system", F.lit(False)) & (T.trim_blank(F.coalesce("body", F.lit(""))) != ""))
    comments = said.join(head, F.col("key") == F.col("__key")).select(
        F.concat("key", F.lit(f"#{note_suffix}"), "note").alias("item_path"),
        F.concat("__url", F.lit(f"#{anchor or note_suffix}"), "note").alias("item_url"),
        F.lit("comment").alias("item_type"),
        "author",
        F.coalesce("created_at", "updated_at").alias("timestamp"),
        T.normalize_content(T.trim_blank(F.col("body"))).alias("content"),
        *meta,
    )
    return bodies.unionByName(comments)


def parse_metadata(rows: DataFrame) -> DataFrame:
    """String metadata as typed columns; malformed lists are empty, a malformed milestone or an empty state null."""
    empty = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "state": F.nullif("state", F.lit("")),
            "labels": F.coalesce(F.from_json("labels", "array<string>"), empty),
            "assignees": F.coalesce(F.from_json("assignees", "array<string>"), empty),
            "milestone": F.when(F.col("milestone").startswith("{"), F.from_json("milestone", "struct<title: string, due_date: string>")),
            "confidential": F.col("confidential") == "true",
        }
    )
