"""Registered queries that go through the store and the engine's commands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.api import Engine
from siltstone.operators.store import Table
from siltstone.sources import issues

from . import adapters as A
from .catalog import _BLANKS, query


@query(
    """WITH t AS (SELECT doc_id AS chunk_id, lang, n_chars FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT doc_id AS chunk_id, 'x' || lang AS lang, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 4 = 0),
    m AS (SELECT * FROM t WHERE chunk_id NOT IN (SELECT chunk_id FROM s) UNION ALL SELECT * FROM s UNION ALL SELECT -doc_id - 1, lang, n_chars FROM documents WHERE doc_id % 6 = 0)
    SELECT * FROM m WHERE NOT coalesce(n_chars < 200, false) AND chunk_id % 7 <> 0"""
)
def store_upsert_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write, merge, append, delete by predicate and by id, compact, and read what is left; a failed write in between does no harm."""
    docs = A.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "n_chars")
    table = Table(spark, A.scratch(spark))
    table.write(docs.filter("chunk_id % 3 <> 0"), "p1/a")
    table.upsert(docs.filter("chunk_id % 4 = 0").select("chunk_id", F.concat(F.lit("x"), "lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars")), part="p1/a")
    table.append(docs.filter("chunk_id % 6 = 0").withColumn("chunk_id", -F.col("chunk_id") - 1), "p1/b")
    try:
        table.write(docs.withColumn("lang", F.raise_error(F.lit("lost")).cast("string")), "p1/b")
    except Exception:  # noqa: BLE001, S110  the write is meant to fail
        pass
    table.delete(F.col("n_chars") < 200)
    table.delete_ids(table.read().select("chunk_id").filter("chunk_id % 7 = 0"))
    table.compact(purge=True)
    return table.read()


def _windows(name: str, files: str) -> str:
    """Line windows of ``files`` (doc_id, source_id, item_path, content) with their chunk ids."""
    return f"""
{name}_l AS (SELECT * EXCLUDE (p), list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS l FROM (SELECT *, string_split(content, chr(10)) AS p FROM {files})),
{name}_w AS (SELECT *, unnest(range(0, len(l), 50)) AS i0 FROM {name}_l),
{name}_c AS (SELECT *, i0 + 1 AS start_line, regexp_replace(array_to_string(l[i0 + 1:i0 + 60], ''), '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS chunk FROM {name}_w),
{name} AS (SELECT doc_id, source_id, item_path, start_line, chunk, sha256('p1' || chr(0) || source_id || chr(0) || item_path || chr(0) || '' || chr(0) || 'code' || chr(0) || chunk) AS chunk_id FROM {name}_c WHERE chunk <> '')"""


def _size(text: str, dims: int) -> np.ndarray:
    """A vector that SQL can compute too: the text's length beside a constant."""
    return np.array([len(text), 100.0], dtype=np.float32)


def _engine(spark: SparkSession, *sources: dict) -> Engine:
    e = Engine(spark, A.scratch(spark), dims=2, encode=_size, hybrid=False)
    e.registry.add_project("p1")
    for s in sources:
        e.registry.add_source("p1", s)
    return e


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return A.read(spark, sf, "documents").select("doc_id", path.alias("item_path"), F.coalesce("text", F.lit("")).alias("content"), F.lit("markdown").alias("language"))


@query(
    f"""WITH f1 AS (SELECT doc_id, 'docs' AS source_id, 'f' || doc_id AS item_path, coalesce(text, '') AS content FROM documents WHERE doc_id % 10 <> 0),
    f2 AS (SELECT doc_id, 'docs' AS source_id, 'f' || doc_id AS item_path, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END AS content FROM documents WHERE doc_id % 7 <> 0),
    {_windows('c1', 'f1')}, {_windows('c2', 'f2')},
    touched AS (SELECT * FROM c2 WHERE doc_id % 10 = 0 OR doc_id % 5 = 0),
    new AS (SELECT DISTINCT chunk_id FROM touched WHERE chunk_id NOT IN (SELECT chunk_id FROM c1)),
    stored AS (SELECT DISTINCT chunk_id FROM c1 UNION SELECT chunk_id FROM new)
    SELECT (SELECT count(*) FROM f2) AS scanned, (SELECT count(*) FROM f2 WHERE doc_id % 5 = 0) AS reindexed, (SELECT count(*) FROM f1 WHERE doc_id % 7 = 0) AS removed,
      (SELECT count(*) FROM touched) AS prepared, (SELECT count(*) FROM new) AS persisted, (SELECT count(*) FROM c2) AS n_tags, (SELECT count(*) FROM f2) AS n_hashes,
      (SELECT count(*) FROM stored) AS n_chunks, (SELECT count(*) FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM c2)) AS n_orphans, (SELECT count(*) FROM stored WHERE chunk_id IN (SELECT chunk_id FROM c2)) AS n_kept"""
)
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a source, the second over removed, new and changed files; then a collection."""
    e = _engine(spark, {"id": "docs", "type": "code", "root": ""})
    files = _documents(spark, sf)
    e.index_source("p1", "docs", "main", items=files.filter("doc_id % 10 <> 0").drop("doc_id"))
    changed = F.concat("content", F.when(F.col("doc_id") % 5 == 0, "!").otherwise(""))
    run = e.index_source("p1", "docs", "main", items=files.filter("doc_id % 7 <> 0").withColumn("content", changed).drop("doc_id"))
    counts = run | {"n_tags": e.tags.count(), "n_hashes": e.hashes.count(), "n_chunks": e.chunks.count(), "n_orphans": e.gc()["orphans"], "n_kept": e.chunks.count()}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


_FUSED = """
cos AS (SELECT *, list_cosine_similarity([{q}::DOUBLE, 100.0::DOUBLE], [(9 + length({content}))::DOUBLE, 100.0::DOUBLE]) AS s FROM {rows}),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(s, 12) DESC, chunk_id) AS r FROM cos),
top AS (SELECT *, round(1.0::DOUBLE / (60 + r), 12) AS score FROM r WHERE r <= {k}),
fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, source_id, r, chunk_id) AS rank FROM top)"""


@query(
    f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS source_id, 'f' || doc_id AS item_path, coalesce(text, '') AS content FROM documents WHERE doc_id % 3 <> 0),
    {_windows('c', 'f')}, {_FUSED.format(q=57, content='chunk', rows='c', k=20)}
    SELECT item_path, start_line::INT AS start_line, score, rank, CASE WHEN source_id = 'a' THEN ['main'] ELSE ['origin/main'] END AS branches FROM fused WHERE rank <= 20"""
)
def search_code_branches(spark: SparkSession, sf: str) -> DataFrame:
    """A branch that one source has as it is named and the other as origin/..., beside a branch that is not asked for; both sources' rankings fused."""
    e = _engine(spark, {"id": "a", "type": "code", "root": ""}, {"id": "b", "type": "code", "root": ""})
    files = _documents(spark, sf)
    for source, odd, branch in (("a", 0, "main"), ("b", 1, "origin/main")):
        mine = files.filter(F.col("doc_id") % 2 == odd)
        e.index_source("p1", source, "dev", items=mine.filter("doc_id % 3 = 0").drop("doc_id"))
        e.index_source("p1", source, branch, items=mine.filter("doc_id % 3 <> 0").drop("doc_id"))
    return e.search_code("p1", "x" * 50, 20, "main").select("item_path", "start_line", "score", "rank", "branches")


@query(
    f"""WITH i AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 't1' ELSE 't2' END AS source_id, regexp_replace(coalesce(text, ''), '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS body, 'issues/' || conv_id || '#note_' || turn AS item_path
        FROM conversations WHERE turn > 0 AND role <> 'system' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)),
    k AS (SELECT *, sha256('p1' || chr(0) || source_id || chr(0) || item_path || chr(0) || 'https://host/' || item_path || chr(0) || 'comment' || chr(0) || body) AS chunk_id FROM i WHERE body <> ''),
    {_FUSED.format(q=47, content='body', rows='k', k=15)}
    SELECT item_path, source_id, score, rank, conv_id % 4 = 0 AS confidential FROM fused WHERE rank <= 15"""
)
def search_knowledge_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Comments of two trackers, each ranked by itself and fused by project, source, path and beginning."""
    e = _engine(spark, {"id": "t1", "type": "ticket", "issues": "", "notes": ""}, {"id": "t2", "type": "ticket", "issues": "", "notes": ""})
    talk = A.read(spark, sf, "conversations")
    for k, source in enumerate(("t1", "t2")):
        e.index_source("p1", source, items=issues.items(*issues.from_conversations(talk.filter(F.col("conv_id") % 2 == k))))
    return e.search_knowledge("p1", "y" * 40, 15, item_types=["comment"]).select("item_path", "source_id", "score", "rank", "confidential")


@query(
    f"""WITH f AS (SELECT doc_id, 'a' AS source_id, 'f' || doc_id AS item_path, coalesce(text, '') AS content FROM documents WHERE doc_id % 9 = 0), {_windows('c', 'f')},
    n AS (SELECT count(DISTINCT chunk_id) AS all_, count(DISTINCT chunk_id) FILTER (WHERE doc_id % 2 = 0) AS even FROM c)
    SELECT unnest(['branches', 'pinned', 'unpinned', 'queue', 'after cancel', 'ignore', 'orphans of dev', 'chunks left', 'doctor fails', 'projects left']) AS command,
      unnest(['dev,main', 'main,rel', 'rel', '1 2', 'cancelled', '2', (all_ - even)::VARCHAR, even::VARCHAR, '0', '0']) AS outcome FROM n"""
)
def engine_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands called by name: branches, pins, jobs, private ignore rules, a collection, the doctor, and a project's end."""
    e = _engine(spark, {"id": "a", "type": "code", "root": ""})
    files = _documents(spark, sf).filter("doc_id % 9 = 0")
    e.index_source("p1", "a", "main", items=files.filter("doc_id % 2 = 0").drop("doc_id"))
    e.index_source("p1", "a", "dev", items=files.drop("doc_id"))
    here = {"project": "p1", "source": "a"}
    out = [("branches", ",".join(e.call("list_branches", here)))]
    out.append(("pinned", ",".join(e.call("pin_branches", here | {"names": ["main", "rel", "main"]})["branches"])))
    out.append(("unpinned", ",".join(e.call("unpin_branches", here | {"names": ["main"]})["branches"])))
    jobs = [e.call("reindex_source", here), e.call("reindex_all", {})]
    out.append(("queue", " ".join(str(j["job_id"]) for j in jobs)))
    for j in jobs:
        e.call("cancel_reindex", {"job_id": j["job_id"]})
    out.append(("after cancel", e.call("reindex_status", {"job_id": jobs[0]["job_id"]})["status"]))
    e.call("set_private_ignore", here | {"content": "# own\nvendor/\n*.tmp\n"})
    out.append(("ignore", str(e.call("get_private_ignore", here)["rule_count"])))
    e.drop_branch("p1", "a", "dev")
    out.append(("orphans of dev", str(e.call("gc", {"project": "p1"})["orphans"])))
    out.append(("chunks left", str(e.chunks.count())))
    out.append(("doctor fails", str(e.call("doctor", {})["summary"]["fail"])))
    e.call("remove_project", {"project": "p1"})
    out.append(("projects left", str(len(e.call("list_projects", {})))))
    return spark.createDataFrame(out, "command string, outcome string")
