"""The driver's tables seen as the engine's relations, as DataFrames and, for the SQL equivalents, as common table expressions."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.files import store_of

from siltstone.functions import text as T


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder for tables of a query: below spark.checkpoint.dir, or in local mode, where that is unset, below one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="siltstone-"))
    return f"{named or _own[0]}/{spark.sparkContext.applicationId}/tables-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to a new scratch folder and read again."""
    root = scratch(spark)
    df.write.parquet(root)
    return spark.read.schema(df.schema).parquet(root)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files of project p1, one source for each ``source``."""
    ext = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "fr", "ts").when(F.col("lang") == "de", "py").otherwise("min.js")
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return read(spark, sf, "documents").select("doc_id", F.lit("p1").alias("project_id"), F.col("source").alias("source_id"), path.alias("item_path"), F.lit("").alias("item_url"), F.coalesce("text", F.lit("")).alias("content"))


FILES = """
files AS (SELECT doc_id, 'p1' AS project_id, source AS source_id, '' AS item_url, coalesce(text, '') AS content,
    'docs/' || source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'md' WHEN 'fr' THEN 'ts' WHEN 'de' THEN 'py' ELSE 'min.js' END AS item_path
  FROM documents)"""


def whole_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each file as one chunk with its id."""
    ident = T.chunk_id(*(F.col(c) for c in ("project_id", "source_id", "item_path", "item_url")), F.lit("code"), F.col("content"))
    return files(spark, sf).withColumn("chunk_id", ident)


CHUNKS = (
    FILES
    + """,
chunks AS (SELECT *, sha256(project_id || chr(0) || source_id || chr(0) || item_path || chr(0) || item_url || chr(0) || 'code' || chr(0) || content) AS chunk_id FROM files)"""
)

#: branch -> (modulus, remainders) of the document ids that are on it.
BRANCHES = {"main": (3, (0, 1)), "dev": (2, (0,)), "origin/dev": (5, (0,)), "origin/fix/one": (13, (0,)), "_ephemeral/pr-1": (7, (0,)), "master": (11, (0,))}


def branches_of(number: Column) -> Column:
    return F.array_compact(F.array(*(F.when((number % m).isin(*rest), F.lit(b)) for b, (m, rest) in BRANCHES.items())))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Branch tags of the files; some files have none."""
    return whole_chunks(spark, sf).select("project_id", "source_id", F.explode(branches_of(F.col("doc_id"))).alias("branch"), "item_path", "chunk_id")


TAGS = (
    CHUNKS
    + ",\ntags AS ("
    + " UNION ALL ".join(f"SELECT project_id, source_id, '{b}' AS branch, item_path, chunk_id FROM chunks WHERE doc_id % {m} IN ({', '.join(map(str, rest))})" for b, (m, rest) in BRANCHES.items())
    + ")"
)


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """part as declarations with dotted names."""
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string"), F.lit(".ts"))
    rows = read(spark, sf, "part").select("p_partkey", name.alias("symbol_name"), path.alias("item_path"), F.lower("p_type").alias("language"), (F.col("p_partkey") % 500 + 1).alias("start_line"))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), "symbol_name"), 256))


SYMBOLS = """
symbols AS (SELECT *, sha256(p_partkey || '|' || symbol_name) AS chunk_id FROM (
    SELECT p_partkey, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS symbol_name, 'src/' || lower(p_type) || '/' || p_size || '.ts' AS item_path,
           lower(p_type) AS language, p_partkey % 500 + 1 AS start_line FROM part)),
tags AS (SELECT chunk_id, 'main' AS branch FROM symbols WHERE p_partkey % 3 IN (0, 1) UNION ALL SELECT chunk_id, 'dev' FROM symbols WHERE p_partkey % 2 = 0)"""


def symbol_tags(spark: SparkSession, sf: str) -> DataFrame:
    on = F.array_compact(F.array(F.when((F.col("p_partkey") % 3).isin(0, 1), "main"), F.when(F.col("p_partkey") % 2 == 0, "dev")))
    return symbols(spark, sf).select("chunk_id", F.explode(on).alias("branch"))


def millis(time: str) -> Column:
    """Milliseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """events as index jobs."""
    status = F.get(F.array(*map(F.lit, ("done", "failed", "cancelled", "queued", "running", "interrupted"))), F.col("event_id") % 6)
    queued = millis("ts")
    return read(spark, sf, "events").select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project_id"),
        F.col("event_type").alias("source_id"),
        F.when(F.col("event_id") % 7 == 0, "gc").otherwise("reindex").alias("type"),
        F.when(F.col("event_id") % 2 == 0, "full").otherwise("incremental").alias("mode"),
        F.when(F.col("user_id") % 2 == 0, "main").otherwise("dev").alias("branch"),
        status.alias("status"),
        queued.alias("queued_at"),
        F.when((F.col("event_id") % 6) != 3, queued + F.col("event_id") % 977).alias("started_at"),
        F.when((F.col("event_id") % 6).isin(0, 1, 2, 5), queued + 1000 * (F.col("event_id") % 1009)).alias("finished_at"),
    )


JOBS = """
jobs AS (SELECT event_id AS job_id, 'p' || user_id % 10 AS project_id, event_type AS source_id, CASE WHEN event_id % 7 = 0 THEN 'gc' ELSE 'reindex' END AS type,
    CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch,
    ['done', 'failed', 'cancelled', 'queued', 'running', 'interrupted'][event_id % 6 + 1] AS status, epoch_us(ts) // 1000 AS queued_at,
    CASE WHEN event_id % 6 <> 3 THEN epoch_us(ts) // 1000 + event_id % 977 END AS started_at,
    CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN epoch_us(ts) // 1000 + 1000 * (event_id % 1009) END AS finished_at FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return vectors(spark, sf).filter(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


#: Copies of each vector in ``jittered``, and a copy's components in SQL.
COPIES = 50
JITTER_SQL = "list_transform(embedding, lambda e, c: (e::DOUBLE + 0.05 * (((vec_id * 31 + (c - 1) * 17 + j * 101 + (c - 1) * j * 7) % 97) / 97.0::DOUBLE - 0.5))::FLOAT::DOUBLE)"


def jittered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, queries): ``COPIES`` slightly moved copies of every vector, written once, and those of them whose id is divisible by 500."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = np.arange(COPIES)[:, None]
        for b in batches:
            for vec_id, vector in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                c = np.arange(len(x))
                copies = (x + 0.05 * (((vec_id * 31 + c * 17 + j * 101 + c * j * 7) % 97) / 97.0 - 0.5)).astype(np.float32)
                offsets = pa.array(np.arange(COPIES + 1, dtype=np.int32) * len(x))
                yield pa.RecordBatch.from_arrays([pa.array(vec_id * COPIES + j[:, 0]), pa.ListArray.from_arrays(offsets, pa.array(copies.ravel()))], names=["chunk_id", "vector"])

    vectors = written(spark, read(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(moved, "chunk_id long, vector array<float>"))
    return vectors, vectors.filter(F.col("chunk_id") % 500 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


COSINE = """
cos AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.label::BIGINT AS label,
    round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS exact
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""

WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

BM25 = f"""
dw AS (SELECT doc_id AS chunk_id, {WORDS.format("text")} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
tf AS (SELECT chunk_id, len(w) AS length, term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM dw) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, mean FROM tf, st GROUP BY term, n, mean),
qw AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format("text")})) AS term FROM benchmark),
bm AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
       FROM qw JOIN tf USING (term) JOIN idf USING (term) GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)"""


def _put_objects(rows: DataFrame, root: str) -> None:
    """Write rows (kind, body) as a repository's loose objects."""

    def put(part: Iterator) -> None:
        fs, base = store_of(root)
        for r in part:
            raw = f"{r['kind']} {len(r['body'])}\0".encode() + bytes(r["body"])
            name = hashlib.sha1(raw, usedforsecurity=False).hexdigest()
            fs.create_dir(f"{base}/.git/objects/{name[:2]}", recursive=True)
            with fs.open_output_stream(f"{base}/.git/objects/{name[:2]}/{name[2:]}") as out:
                out.write(zlib.compress(raw, 1))

    rows.foreachPartition(put)


def _object(kind: str, body: Column) -> Column:
    """The hash of an object."""
    return F.sha1(F.concat(F.concat(F.lit(f"{kind} "), F.octet_length(body).cast("string")).cast("binary"), F.lit(bytearray(1)), body))


def repository(spark: SparkSession, sf: str) -> str:
    """documents as files of branch ``rel`` of a repository, a hundred to a folder, of which nothing is checked out; every eleventh is a link."""
    root, doc = scratch(spark), F.col("doc_id")
    ext = F.get(F.array(*map(F.lit, ("py", "md", "ts", "bin"))), doc % 4)
    blobs = read(spark, sf, "documents").select(
        F.concat(F.lit("a"), F.floor(doc / 10_000).cast("string")).alias("p0"),
        F.concat(F.lit("d"), F.floor(doc / 100).cast("string")).alias("p1"),
        F.concat(F.lit("f"), doc.cast("string"), F.lit("."), ext).alias("name"),
        F.when(doc % 11 == 0, "120000").otherwise("100644").alias("mode"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"),
    )
    _put_objects(blobs.select(F.lit("blob").alias("kind"), "body"), root)
    level = blobs.select("p0", "p1", "name", "mode", _object("blob", F.col("body")).alias("sha"))
    for by in (["p0", "p1"], ["p0"], []):
        entry = F.concat(F.hex(F.concat("mode", F.lit(" "), "name").cast("binary")), F.lit("00"), F.upper("sha"))
        held = F.sort_array(F.collect_list(F.struct("name", entry.alias("e"))))
        trees = level.groupBy(*by).agg(F.unhex(F.array_join(F.transform(held, lambda x: x["e"]), "")).alias("body"))
        _put_objects(trees.select(F.lit("tree").alias("kind"), "body"), root)
        level = trees.select(*by[:-1], *([F.col(by[-1]).alias("name")] if by else []), F.lit("40000").alias("mode"), _object("tree", F.col("body")).alias("sha"))
    commit = f"tree {level.first()['sha']}\nauthor a <a> 0 +0000\ncommitter a <a> 0 +0000\n\nall\n".encode()
    _put_objects(spark.createDataFrame([("commit", bytearray(commit))], "kind string, body binary"), root)
    fs, base = store_of(root)
    for name, text in (("HEAD", "ref: refs/heads/main"), ("refs/heads/rel", hashlib.sha1(f"commit {len(commit)}\0".encode() + commit, usedforsecurity=False).hexdigest())):
        fs.create_dir(f"{base}/.git/{name}".rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{base}/.git/{name}") as out:
            out.write(f"{text}\n".encode())
    return root
