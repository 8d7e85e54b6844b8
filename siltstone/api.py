"""The engine's commands: projects, indexing, searching, jobs, branches and maintenance."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import embedding, params
from siltstone.functions import text as T
from siltstone.operators import blocks, branches, cells, changes, chunking, jobs, lookup, maintenance, ranking, retrieval, scheduling, temporal
from siltstone.operators.store import Table, needs_migration
from siltstone.sources import declarations, files, gitobjects, issues, presets, registry, repository, tracker
from siltstone.streaming import changes as streams

CHUNKS = "chunk_id string, project_id string, source_id string, item_path string, content string, start_line int, end_line int, language string, symbol_name string, vector array<float>"
ITEMS = ["chunk_id", "project_id", "source_id", "item_path", "item_url", "item_type", "author", "timestamp", "content", "state", "labels", "assignees", "milestone", "confidential"]
TAGS = "project_id string, source_id string, branch string, item_path string, chunk_id string, start_line int, end_line int"
HASHES = "project_id string, source_id string, branch string, path string, hash string"
STATE = "project_id string, source_id string, branch string, last_indexed_sha string, last_indexed_at long"
BATCHES = "key string, last_successful long, max_failed long, updated_at long"
IGNORES = "project_id string, source_id string, content string, written_at long"
#: Schemes of chunk ids and of knowledge rows, and the store's version.
ID_SCHEME, STORE_VERSION = 2, 4
#: Pinned branches of a source over which a warning is due, and seconds between two collections that ratios ask for.
MANY_PINS, QUIET_SECONDS = 20, 1800
#: Bytes of text whose postings are made at once, so that a run's shuffles are bounded.
TEXT_BYTES = 4 << 30
#: A repository's own ignore files.
IGNORE_FILES = (".gitignore", ".siltstoneignore")
ANY = repository.ANY


class IndexProblem(RuntimeError):
    """A source whose index must be mended before it can be searched; ``kind`` is needs_migration or table_corrupt."""

    def __init__(self, kind: str, message: str, **details):
        super().__init__(message)
        self.kind, self.details = kind, details


def _read_code(spark: SparkSession, source: dict) -> DataFrame:
    """Files of the working tree, or of the ref that ``source`` names."""
    own = [line for name in IGNORE_FILES for line in (repository._text(spark, f"{source['root'].rstrip('/')}/{name}") or "").splitlines()]
    rules = files.compile_rules([*own, *source.get("ignore", [])])
    return gitobjects.read_ref(spark, source["root"], source["ref"], rules) if source.get("ref") else files.read_tree(spark, source["root"], rules)


#: Settings of a ticket source that its tracker's reader takes.
_TRACKER = ("provider", "base_url", "token", "fetch", "cursor", "until")


def _tracker(reader, spark: SparkSession, source: dict) -> DataFrame:  # noqa: ANN001  spark.read or spark.readStream
    spark.dataSource.register(tracker.IssueSource)
    own = {k: source[k] for k in _TRACKER if source.get(k)}
    return reader.format("issues").options(project=source["project_id"], **own).load()


def _read_issues(spark: SparkSession, source: dict) -> DataFrame:
    """Items of a provider's tracker, or of issues and notes kept as JSON lines in the engine's own shape."""
    if source.get("provider"):
        return issues.tracker_items(_tracker(spark.read, spark, source).persist(), source["provider"])
    raw = issues.since(spark.read.schema(issues.ISSUE).json(source["issues"]), source.get("cursor"))
    return issues.items(raw, spark.read.schema(issues.NOTE).json(source["notes"]))


registry.register_reader("code", _read_code, "code")
registry.register_reader("ticket", _read_issues, "text")


def _part(project: str, source: str) -> str:
    return f"{project}/{source}"


class Engine:
    """An index under ``root``.  Tables are divided by project and source, so a run rewrites its own source only."""

    def __init__(self, spark: SparkSession, root: str, dims: int = 384, encode=embedding.hash_vector, hybrid: bool = True, exact: bool = False):
        self.spark, self.root, self.dims, self.encode, self.hybrid, self.exact = spark, root.rstrip("/"), dims, encode, hybrid, exact
        self.registry = registry.Registry(spark, f"{self.root}/projects")
        self.presets = presets.Presets(spark, f"{self.root}/presets")
        self.jobs = jobs.Jobs(spark, f"{self.root}/jobs")
        names = ("code", "knowledge", "branch_tags", "hashes", "branch_state", "terms", "lengths", "codes", "cells", "symbols", "batch_state", "ignores", "store")
        self.tables = {name: Table(spark, f"{self.root}/{name}") for name in names}
        self.chunks, self.knowledge, self.tags, self.hashes, self.state, self.terms, self.lengths, self.codes, self.cells, self.symbols, self.batches, self.ignores, self.store = self.tables.values()
        #: Chunks of a run under way; no version names them.
        self.made = Table(spark, f"{self.root}/made")
        self.backfill = scheduling.Fifo(lambda part, force: self.create_vector_index(*part.split("/", 1), force=force))
        #: Rows added to each part since its vector index was last asked for.
        self.added: dict[str, int] = {}
        self._models: dict[str, tuple[tuple[str, ...], cells.Cells]] = {}

    def _or_empty(self, table: Table, schema: str, parts: list[str] | None = None) -> DataFrame:
        rows = table.read(parts=parts)
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def _source(self, project: str, source_id: str) -> dict:
        source = next((s for s in self.registry.get(project)["sources"] if s["id"] == source_id), None)
        if source is None:
            raise KeyError(f"unknown source: {source_id}")
        return source

    def _replace(self, table: Table, part: str, make: Callable[[DataFrame], DataFrame], schema: str, **fields) -> None:
        """Rewrite a part, or write its first rows."""
        if table.rewrite(make, part, **fields) is None:
            table.write(make(self.spark.createDataFrame([], schema)), part, **fields)

    # --- indexing ---

    def index_source(self, project: str, source_id: str, branch: str | None = None, full: bool = False, items: DataFrame | None = None, flush_files: int | None = None) -> dict:
        """Index what changed of a source on a branch (code: the checked-out one by default; others are read from the repository's objects).

        ``items`` replaces the reader's rows.  With ``flush_files`` the changed
        files are indexed in runs of about so many, each of which is kept when a
        later one fails.  Chunks are written before tags, and those before hashes.
        """
        source = self._source(project, source_id)
        if source["profile"] != "code":
            return self._index_knowledge(project, source_id, registry.reader_of(source["type"])(self.spark, registry.resolved(source)) if items is None else items, full)
        root = source.get("root", "")
        head = repository.head_branch(self.spark, root) if root else ANY
        branch = branch or head
        if items is None:
            items = self._files(project, source_id, None if head in (ANY, branch) else branch)
        done = self._index_code(project, source_id, branch, items, full, flush_files)
        sha = repository.commit_of(self.spark, root, branch) if root and branch != ANY else None
        if sha is not None:
            self.set_last_indexed_sha(project, source_id, branch, sha)
        return done

    def _files(self, project: str, source_id: str, ref: str | None) -> DataFrame:
        """A code source's files: its working tree, or a ref's, which need not be checked out."""
        source = self._source(project, source_id)
        private = (self.get_private_ignore(project, source_id)["content"] or "").splitlines()
        return registry.reader_of(source["type"])(self.spark, registry.resolved(source) | {"ignore": [*source.get("ignore", []), *private], "ref": ref})

    def _let_go(self) -> None:
        """Have Spark delete the shuffle files of plans that are over; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _embedded(self, rows: DataFrame, project: str, source: str, table: Table) -> tuple[DataFrame, str]:
        """Rows with vectors, and the folder of ``table`` that they were put in; the batch sizes that went through are remembered for the source."""
        key = f"{project}:{source}:{getattr(self.encode, '__name__', 'encoder')}"
        known = self._or_empty(self.batches, BATCHES).filter(F.col("key") == key).first()
        size = embedding.probe_size(known and known["last_successful"], known and known["max_failed"], embedding.SLOTS)
        met = Observation()
        out = embedding.embed(rows, "content", self.dims, encode=self.encode, size=size, report=True).observe(met, F.max("__good").alias("good"), F.min("__refused").alias("refused")).drop("__good", "__refused")
        folder = table.put(out)
        self._let_go()
        seen = met.get
        if seen.get("refused") is not None:
            row = self.spark.createDataFrame([(key, seen["good"] or 1, seen["refused"], jobs.now_ms())], BATCHES)
            self.batches.upsert(row, "key")
        return table.rows_of(folder, out.schema), folder

    def _index_text(self, rows: DataFrame, part: str) -> None:
        """Keep the postings of rows that the text index lacks, sorted by term so that a search reads few row groups."""
        if part in self.lengths.parts():  # of a run that failed later
            rows = changes.not_among(rows, rows.select("chunk_id").join(self.lengths.read(parts=[part]), "chunk_id", "left_semi"), "chunk_id")
        rounds = -(-(rows.agg(F.sum(F.octet_length("content"))).first()[0] or 1) // TEXT_BYTES)
        for k in range(rounds):
            kept, lengths = blocks.kept_blocks(rows.filter(F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(rounds)) == k))
            self.terms.append(kept, part)
            self.lengths.append(lengths, part)
            self._let_go()

    def _index_symbols(self, new: DataFrame, part: str, full: bool) -> None:
        """Keep the symbols of rows that are about to be added; of all rows in a full run, or where the part has no symbol index yet."""
        if part in self.symbols.parts() and not full:
            self.symbols.append(lookup.symbol_index(new), part)
        else:
            both = [df.select("chunk_id", "symbol_name") for df in (self._or_empty(self.chunks, CHUNKS, [part]), new)]
            self.symbols.write(lookup.symbol_index(both[0].unionByName(both[1]).distinct()), part)

    def _drop_postings(self, gone: DataFrame, part: str) -> None:
        """Forget chunks (chunk_id) in a part's text index."""
        self.terms.rewrite(lambda current: blocks.kept_without(current, gone), part)
        self.lengths.delete_ids(gone, parts=[part])
        self._let_go()

    def _index_code(self, *run) -> dict:  # noqa: ANN002  as _index_files takes them
        with ExitStack() as ended:
            return self._index_files(ended, *run)

    def _index_files(self, ended: ExitStack, project: str, source: str, branch: str, items: DataFrame, full: bool, flush_files: int | None) -> dict:
        part = _part(project, source)
        items = items.withColumn("hash", T.content_hash(F.col("content")))
        here = F.col("branch") == branch
        old = self._or_empty(self.hashes, HASHES, [part]).filter(here).select("path", "hash")
        diff = changes.snapshot_diff(old.limit(0) if full else old, items.select(F.col("item_path").alias("path"), "hash")).persist()
        changed = diff.filter(F.col("change").isin("added", "changed"))
        n_changed, n_removed = changed.count(), diff.filter("change = 'removed'").count()
        runs = max(1, -(-n_changed // flush_files)) if flush_files else 1
        slot = F.pmod(F.xxhash64("path"), F.lit(runs))
        total = {"scanned": items.count(), "reindexed": n_changed, "removed": n_removed, "prepared": 0, "persisted": 0}
        repeated = not diff.groupBy("path").count().filter("count > 1").isEmpty()
        every = runs == 1 and n_changed == total["scanned"] and not repeated
        for k in range(runs):
            some = diff.filter((F.col("change") != "same") & (slot == k))
            touched = some.filter("change <> 'removed'").select(F.col("path").alias("item_path"))
            made = declarations.declaration_chunks(items.filter(F.col("item_path").isNotNull()) if every else changes.among(items, touched, "item_path"), again=True)
            made = made.withColumns({"project_id": F.lit(project), "source_id": F.lit(source), "item_url": F.lit(""), "chunk": F.col("content")})
            made = chunking.stamp(made).drop("chunk")
            kept = self.made.put(made)
            ended.callback(self.made.discard, kept)
            self._let_go()
            made = self.made.rows_of(kept, made.schema)
            # Ids hold the path, so equal ones are of one file; where a path is listed twice, of several rows.
            first = chunking.first_seen(made, ["item_path", "start_line", "end_line"]) if repeated else made.filter(~F.col("again"))
            known = None if full else self.chunks.read(parts=[part])
            if known is not None:
                first = changes.not_among(first, first.select("chunk_id").join(known, "chunk_id", "left_semi"), "chunk_id")
            new, folder = self._embedded(first.select("chunk_id", "project_id", "source_id", "item_path", "content", "start_line", "end_line", "language", "symbol_name"), project, source, self.chunks)
            made = made.select("project_id", "source_id", "item_path", "chunk_id", "start_line", "end_line")
            places = self.made.put(made)
            ended.callback(self.made.discard, places)
            made = self.made.rows_of(places, made.schema)
            self.made.discard(kept)
            n_new = new.count()
            total["prepared"] += made.count()
            total["persisted"] += n_new
            if n_new:
                keep = {"chunk_id_scheme": ID_SCHEME, "dims": self.dims}
                # Chunks come last: a later run passes over those that are there, so their indexes must be.
                self._index_text(new, part)
                self._index_symbols(new, part, full)
                self.chunks.upsert(new, part=part, **keep) if full else self.chunks.append(new, part, folder, **keep)
            if full or not n_new:
                self.chunks.discard(folder)
            fresh = made.select("project_id", "source_id", F.lit(branch).alias("branch"), "item_path", "chunk_id", "start_line", "end_line")
            gone = some.select(F.col("path").alias("item_path"))

            def retag(tags: DataFrame, gone=gone, fresh=fresh, k=k) -> DataFrame:
                mine = tags.filter(here).limit(0) if full and k == 0 else tags.filter(here)
                return tags.filter(~here).unionByName(changes.apply_files(mine, gone.withColumn("outcome", F.lit("stale")), fresh).select(*tags.columns)).distinct()

            self._replace(self.tags, part, retag, TAGS)
            now = some.filter("change <> 'removed'").select(F.lit(project).alias("project_id"), F.lit(source).alias("source_id"), F.lit(branch).alias("branch"), "path", F.col("new_hash").alias("hash"))

            def rehash(hashes: DataFrame, some=some, now=now, k=k) -> DataFrame:
                mine = hashes.filter(here).limit(0) if full and k == 0 else hashes.filter(here)
                return hashes.filter(~here).unionByName(mine.join(some.select("path"), "path", "left_anti").select(*hashes.columns)).unionByName(now)

            self._replace(self.hashes, part, rehash, HASHES)
            self.made.discard(places)
            self._let_go()
        diff.unpersist()
        self._finish(project, source, part, total["persisted"], full, {"last_indexed": jobs.now_ms()})
        return total

    def _finish(self, project: str, source: str, part: str, added: int, full: bool, fields: dict) -> None:
        """What ends a run: the source's stamps, tidied tables, and the vector index where enough rows were added."""
        self.registry.update_source(project, source, fields | {"embedding_schema_version": ID_SCHEME, "embedded_with": self._settings(self._source(project, source)["profile"])})
        self.added[part] = self.added.get(part, 0) + added
        table = self.chunks if part in self.chunks.parts() else self.knowledge
        if full or (added and self.added[part] >= max(temporal.REBUILD_ROWS, int(table.count([part]) * temporal.REBUILD_SHARE))):
            self.backfill.request(part, force=True)
            self.added[part] = 0
        for t in self.tables.values():
            t.tidy()
        self.backfill.run()

    def _settings(self, profile: str) -> dict:
        name = self.presets.assigned("code" if profile == "code" else "text")
        if name is None:
            return {"provider": presets.LOCAL, "model": getattr(self.encode, "__name__", "encoder"), "dims": self.dims}
        return {k: v for k, v in self.presets.resolve(name, "code" if profile == "code" else "text").items() if k in ("provider", "model", "dims")}

    def _index_knowledge(self, project: str, source: str, items: DataFrame, full: bool) -> dict:
        """Items replace what was there for their issue, so edited and removed notes do not linger."""
        started, part = jobs.now_ms(), _part(project, source)
        rows = items.withColumns({"project_id": F.lit(project), "source_id": F.lit(source)}).filter("content <> ''")
        ident = T.chunk_id(*(F.col(c) for c in ("project_id", "source_id", "item_path", "item_url", "item_type", "content")))
        rows = chunking.first_seen(rows.withColumn("chunk_id", ident), ["item_path"])
        new, folder = self._embedded(rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ITEMS)), project, source, self.knowledge)
        issue = F.regexp_extract("item_path", r"^([^#]*)", 1)
        n = new.count()
        named = new.select(issue.alias("__i")).distinct()
        current = self.knowledge.read(parts=[part])
        stale = None if current is None else (current if full else current.join(named, issue == F.col("__i"), "left_semi")).select("chunk_id")
        if stale is not None:
            self._drop_postings(stale.persist(), part)
        keep = {"knowledge_schema_version": ID_SCHEME, "dims": self.dims}
        done = None if full else self.knowledge.rewrite(lambda rows: rows.join(named, issue == F.col("__i"), "left_anti").unionByName(new), part, **keep)
        if done is None:
            self.knowledge.write(new, part, **keep)
        self._index_text(new, part)
        self.knowledge.discard(folder)
        self._finish(project, source, part, n, full, {"last_indexed": started, "knowledge_schema_version": ID_SCHEME, "cursor": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(started / 1000))})
        return {"scanned": n, "reindexed": n, "removed": 0, "prepared": n, "persisted": n}

    def follow_source(self, project: str, source: str, checkpoint: str) -> None:
        """Index what a tracker's project says since the stream's offset; a batch that is handed over again replaces its issues' rows once more."""
        own = self._source(project, source)
        settings = registry.resolved(own) | {"cursor": None}

        def each(rows: DataFrame, batch: int) -> None:
            held = rows.persist()
            self._index_knowledge(project, source, issues.tracker_items(held, settings.get("provider", "gitlab")), False)
            held.unpersist()

        streams.run_available(_tracker(self.spark.readStream, self.spark, settings), checkpoint, each)

    def create_vector_index(self, project: str, source: str, force: bool = False) -> bool:
        """Keep the codes of a source's vectors; not for few rows, nor again where there are some, unless forced."""
        part = _part(project, source)
        rows = next((r for t in (self.chunks, self.knowledge) if part in t.parts() and (r := t.read(parts=[part])) is not None), None)
        if rows is None or (not force and part in self.cells.parts()) or rows.count() < retrieval.INDEX_ROWS:
            return False
        model = cells.fit(rows, self.dims)
        self.codes.write(cells.laid_out(cells.codes(rows, model)), part)
        self.cells.write(cells.model_rows(self.spark, model).coalesce(1), part)
        return True

    def _cells(self, part: str) -> cells.Cells | None:
        """The model of a part's vector index, held until another is written; None where there is none."""
        folders = tuple((self.cells.latest() or {"parts": {}})["parts"].get(part, ()))
        if not folders or part not in self.codes.parts():
            return None
        if self._models.get(part, (None,))[0] != folders:
            self._models[part] = (folders, cells.model_of(self.cells.read(parts=[part])))
        return self._models[part][1]

    # --- searching ---

    def _searchable(self, project: str, profile: str, wanted: list[str] | None) -> list[dict]:
        """The project's sources of a profile, after the health of their indexes was looked at."""
        found = [s for s in self.registry.list_sources(project, profile) if wanted is None or s["id"] in wanted]
        if not found:
            raise LookupError("NO_CODE_SOURCES" if profile == "code" else "NO_KNOWLEDGE_SOURCES")
        table = self.chunks if profile == "code" else self.knowledge
        name = "code" if profile == "code" else "knowledge"
        health = self.health(name)[name]
        for s in found:
            where = {"project_id": project, "source_id": s["id"]}
            if _part(project, s["id"]) not in table.parts():
                continue
            if profile == "code" and needs_migration(table.latest()):
                raise IndexProblem("needs_migration", f"{project}/{s['id']} has chunk ids of an old scheme: migrate it", **where)
            if health not in ("healthy", "unknown"):
                raise IndexProblem("table_corrupt", f"{project}/{s['id']} cannot be read whole ({health}): repair it or index it in full", reason=health, **where)
        return found

    def _hybrid(self, rows: DataFrame, part: str, query: str, k: int) -> DataFrame:
        """chunk_id, score, rank of one source: cosine and BM25 lists fused; cosine alone where the text list is empty or cannot be had."""
        asked = embedding.embed(self.spark.createDataFrame([(0, query)], "query_id long, query string"), "query", self.dims, embedding.QUERY_PREFIX, self.encode)
        ids = rows.select("chunk_id")
        model = None if self.exact else self._cells(part)
        if model is not None:
            coded = self.codes.read(parts=[part])
            late = rows.join(coded.select("chunk_id"), "chunk_id", "left_anti")  # added since the codes were made
            coded = coded.join(ids, "chunk_id", "left_semi").unionByName(cells.codes(late, model))
            dense = cells.search_whole(rows, coded, model, asked, k)
        else:
            dense = retrieval.search(rows, asked, k, self.dims)
        dense = dense.select("chunk_id", "score", "rank")
        if not self.hybrid:
            return dense
        try:
            kept, lengths = self.terms.read(parts=[part]), self.lengths.read(parts=[part])
            if kept is None or part not in self.terms.parts():
                sparse = retrieval.bm25(rows, asked, k)
            elif ids.count() == lengths.count():
                sparse = blocks.search(kept, lengths, asked, k)
            else:  # the statistics are those of the rows searched, so the postings of others go first
                terms = kept.join(asked.select(F.explode(retrieval.tokens(F.col("query"))).alias("term")).distinct(), "term", "left_semi")
                sparse = retrieval.bm25_kept(blocks.flat(terms, kept).join(ids, "chunk_id", "left_semi"), lengths.join(ids, "chunk_id", "left_semi"), asked, k)
            sparse = sparse.select("chunk_id", "rank").persist()
            if sparse.isEmpty():
                return dense
        except Exception as e:  # noqa: BLE001  a text index that cannot be read must not stop a search
            if "path" in str(e).lower() or "index" in str(e).lower():
                return dense
            raise
        lists = dense.select(F.lit(0).alias("list_no"), "chunk_id", "rank").unionByName(sparse.select(F.lit(1).alias("list_no"), "chunk_id", "rank"))
        return ranking.reciprocal_rank(lists, ["chunk_id"]).select("chunk_id", "score", "rank").filter(F.col("rank") <= k)

    def _merge(self, lists: list[DataFrame], key: Column) -> DataFrame:
        """One ranking of the sources' hits (with rank, score and their columns): as it is for one source, fused by ``key`` for several.  A key's first row stands for it."""
        if len(lists) == 1:
            return lists[0]
        every = reduce(DataFrame.unionByName, [hits.withColumn("list_no", F.lit(i)) for i, hits in enumerate(lists)]).withColumn("__key", key).persist()
        fused = ranking.reciprocal_rank(every.select("list_no", "__key", "rank"), ["__key"]).select("__key", "score", "rank")
        first = chunking.first_seen(every.drop("rank", "score"), ["list_no", "chunk_id"], "__key")
        return first.join(fused, "__key").drop("__key", "list_no")

    def _reranked(self, hits: DataFrame, query: str, k: int, rerank) -> DataFrame:
        """The first k, blended with a re-ranker's scores; a local one that fails leaves the ranking as it is, a remote one's failure is raised."""
        if rerank is None:
            return hits.filter(F.col("rank") <= k)
        try:
            scores = rerank(hits, query).select("chunk_id", "rerank").persist()
            scores.count()
        except Exception:  # noqa: BLE001
            if getattr(rerank, "remote", False):
                raise
            return hits.filter(F.col("rank") <= k)
        blended = ranking.blend(hits.join(scores, "chunk_id", "left").withColumn("__g", F.lit(0)), k, ["__g"])
        return blended.withColumn("rank", F.col("new_rank")).drop("__g", "new_rank", "rerank")

    def _rows_on(self, part: str, branch: str) -> DataFrame:
        """A source's chunks on a branch, under whichever of its names (with or without origin/) is indexed; none where neither is."""
        rows = self._or_empty(self.chunks, CHUNKS, [part])
        if branch == ANY:
            return rows
        tags = self._or_empty(self.tags, TAGS, [part])
        names = self.spark.createDataFrame([(branch,)], "name string")
        on = tags.join(branches.resolve(names, tags).select(F.col("resolved").alias("branch")), "branch", "left_semi")
        return rows.join(on.select("chunk_id"), "chunk_id", "left_semi")

    def search_code(self, project: str, query: str, top_k: int = 10, branch: str | None = None, sources: list[str] | None = None, rerank=None) -> DataFrame:
        """Hits with path, lines, symbol, score and branches.

        Each source is searched on ``branch`` (its checked-out one by default, ``*``
        for all); the filter applies before the ranking.  The sources' rankings
        are fused.
        """
        fetch, lists, parts = ranking.fetch_count(top_k, rerank is not None), [], []
        for s in self._searchable(project, "code", sources):
            part = _part(project, s["id"])
            root = s.get("root", "")
            rows = self._rows_on(part, branch or (repository.head_branch(self.spark, root) if root else ANY))
            lists.append(self._hybrid(rows, part, query, fetch).join(rows.drop("vector"), "chunk_id"))
            parts.append(part)
        hits = self._reranked(self._merge(lists, F.col("chunk_id")), query, top_k, rerank)
        return branches.annotate(hits, self._or_empty(self.tags, TAGS, parts)).orderBy("rank")

    def search_knowledge(self, project: str, query: str, top_k: int = 10, source: str | None = None, item_types: list[str] | None = None, rerank=None) -> DataFrame:
        """Knowledge hits with parsed metadata; the sources' rankings are fused by project, source, path and the content's beginning."""
        known = [s["id"] for s in self.registry.list_sources(project, "text")]
        if known and source is not None and source not in known:
            raise LookupError(f"unknown source: {source}")
        fetch, lists = ranking.fetch_count(top_k, rerank is not None), []
        for s in self._searchable(project, "text", None if source is None else [source]):
            rows = self.knowledge.read(parts=[_part(project, s["id"])])
            if rows is None:
                continue
            if item_types:
                rows = rows.filter(F.col("item_type").isin(*item_types))
            lists.append(self._hybrid(rows, _part(project, s["id"]), query, fetch).join(rows.drop("vector"), "chunk_id"))
        if not lists:
            raise LookupError("NO_KNOWLEDGE_SOURCES")
        key = ranking.knowledge_key(*(F.col(c) for c in ("project_id", "source_id", "item_path", "content")))
        hits = self._reranked(self._merge(lists, key), query, top_k, rerank)
        return issues.parse_metadata(hits.drop("chunk_id")).orderBy("rank")

    def lookup_symbol(self, project: str, name: str, source: str | None = None, **options) -> DataFrame:
        parts = [_part(project, s["id"]) for s in self.registry.list_sources(project, "code") if source in (None, s["id"])]
        parts = [p for p in parts if p in self.chunks.parts()]
        index = self.symbols.read(parts=parts) if parts and set(parts) <= set(self.symbols.parts()) else None
        return lookup.lookup_symbol(self._or_empty(self.chunks, CHUNKS, parts), self._or_empty(self.tags, TAGS, parts), name, index=index, **options)

    # --- projects and sources ---

    def searchable(self, source: dict) -> dict:
        """Whether a source can be searched, and why not."""
        if not source.get("last_indexed"):
            return {"ok": False, "reason": "never indexed"}
        reason = self.presets.unsearchable(source["profile"])
        return {"ok": reason is None} | ({"reason": reason} if reason else {})

    def list_projects(self) -> list[dict]:
        return [p | {"sources": [s | {"searchable": self.searchable(s)} for s in p["sources"]]} for p in self.registry.list_projects()]

    def remove_source(self, project: str, source: str) -> None:
        """Forget a source with all its rows."""
        self._source(project, source)
        for table in self.tables.values():
            table.drop_parts([_part(project, source)])
        self.set_private_ignore(project, source, "", check=False)
        self.registry.remove_source(project, source)  # last, so that what a failure leaves can still be named

    def remove_project(self, project: str) -> None:
        """Forget a project: its live jobs are cancelled, the rows of all its sources go."""
        sources = [s["id"] for s in self.registry.get(project)["sources"]]
        self.jobs.cancel_project(project)
        for s in sources:
            self.remove_source(project, s)
        self.registry.remove_project(project)

    def set_private_ignore(self, project: str, source: str, content: str, check: bool = True) -> dict:
        """Ignore rules of a code source that are kept here and not in its repository; an empty text deletes them."""
        if check and self._source(project, source)["profile"] != "code":
            raise ValueError("only code sources have private ignore rules")
        old = self._ignore(project, source)
        if (old or "") == content:
            return {"ok": True, "action": "unchanged"}
        mine = (F.col("project_id") == project) & (F.col("source_id") == source)
        new = self.spark.createDataFrame([(project, source, content, jobs.now_ms())] if content else [], IGNORES)
        self._replace(self.ignores, "", lambda rows: rows.filter(~mine).unionByName(new).coalesce(1), IGNORES)
        return {"ok": True, "action": "written" if content else "deleted"}

    def _ignore(self, project: str, source: str) -> str | None:
        row = self._or_empty(self.ignores, IGNORES).filter((F.col("project_id") == project) & (F.col("source_id") == source)).first()
        return row and row["content"]

    def get_private_ignore(self, project: str, source: str) -> dict:
        content = self._ignore(project, source)
        return {"project_id": project, "source_id": source, "content": content, "rule_count": files.count_rules(content or "")}

    def list_private_ignores(self, project: str | None = None) -> list[dict]:
        rows = self._or_empty(self.ignores, IGNORES).orderBy("project_id", "source_id").collect()
        found = [{"project_id": r["project_id"], "source_id": r["source_id"], "rule_count": files.count_rules(r["content"]), "mtime": r["written_at"]} for r in rows if project in (None, r["project_id"])]
        return [r for r in found if r["rule_count"]]

    def ignore_coverage(self, project: str, source: str) -> dict:
        """Whether a code source has ignore rules of its own, in its repository or kept here."""
        root = self._source(project, source).get("root", "")
        committed = bool(root and files.count_rules(repository._text(self.spark, f"{root.rstrip('/')}/{IGNORE_FILES[1]}") or ""))
        private = files.count_rules(self._ignore(project, source) or "") > 0
        return {"covered": committed or private, "committed": committed, "private": private}

    # --- presets ---

    def init(self, code_provider: str, code_model: str | None = None, text_provider: str | None = None, text_model: str | None = None, reconfigure: bool = False, **fields) -> dict:
        """Make and assign the presets of both slots and queue an index of every project."""
        if self.presets.configured() and not reconfigure:
            return {"ok": True, "status": "already_configured"}
        stamp = f"-{jobs.now_ms()}" if self.presets.configured() else ""
        for slot, provider, model in (("code", code_provider, code_model), ("text", text_provider or code_provider, text_model)):
            own = {k: fields.get(f"{slot}_{f}", fields.get(f"code_{f}")) for k, f in (("credentials", "api_key"), ("base_url", "base_url"), ("dim", "dim"))}
            try:
                self.presets.add(f"{slot}{stamp}", provider, model, slot, **own)
                self.assign_preset(slot, f"{slot}{stamp}")
            except (ValueError, KeyError) as e:
                return {"ok": False, "status": "validation_failed", "message": str(e)}
        projects = [p["id"] for p in self.registry.list_projects() if p["sources"]]
        job = self.reindex_all() if projects else {}
        return {"ok": True, "status": "configured", "indexed_projects": projects} | {k: v for k, v in job.items() if k == "job_id"}

    def add_embedding_preset(self, name: str, provider: str, model: str, **fields) -> dict:
        self.presets.add(name, provider, model, **fields)
        return {"ok": True, "preset_name": name}

    def assign_preset(self, slot: str, preset_name: str) -> dict:
        """``requires_reindex`` where a source of the slot was embedded with another model, dimension or provider."""
        profile = "code" if slot == "code" else "text"
        return self.presets.assign(slot, preset_name, [s["embedded_with"] for s in self.registry.list_sources(profile=profile) if s.get("embedded_with")])

    # --- branches ---

    def list_branches(self, project: str, source: str) -> list[str]:
        if self._source(project, source)["profile"] != "code":
            return [ANY]
        found = branches.list_branches(self._or_empty(self.tags, TAGS, [_part(project, source)]))
        return sorted(r["branch"] for r in found.collect())

    def last_indexed_sha(self, project: str, source: str, branch: str) -> str | None:
        row = self._or_empty(self.state, STATE, [_part(project, source)]).filter(F.col("branch") == branch).first()
        return row and row["last_indexed_sha"]

    def set_last_indexed_sha(self, project: str, source: str, branch: str, sha: str) -> None:
        row = self.spark.createDataFrame([(project, source, branch, sha, jobs.now_ms())], STATE)
        self.state.upsert(row, "branch", _part(project, source))

    def poll_fetches(self, remotes: DataFrame) -> list[dict]:
        """Look at the pinned branches' remote commits (project_id, source_id, branch, sha): queue an index of what moved, take over what was indexed before commits were kept."""
        pins = [(s["project_id"], s["id"], b) for s in self.registry.list_sources(profile="code") for b in s["pinned_branches"]]
        key = F.concat_ws("/", "project_id", "source_id")
        pinned = self.spark.createDataFrame(pins, "project_id string, source_id string, branch string")
        moved = [df.withColumn("source_id", key) for df in (pinned, remotes, self._or_empty(self.state, STATE), self._or_empty(self.tags, TAGS))]
        shas = {(r["source_id"], r["branch"]): r["sha"] for r in moved[1].collect()}
        out = []
        for r in temporal.fetch_decisions(*moved).orderBy("source_id", "branch").collect():
            project, source = r["source_id"].split("/", 1)
            if r["decision"] == "enqueue":
                self.reindex_source(project, source, branch=r["branch"])
            elif r["decision"] == "baseline":
                self.set_last_indexed_sha(project, source, r["branch"], shas[r["source_id"], r["branch"]])
            out.append({"project_id": project, "source_id": source, "branch": r["branch"], "decision": r["decision"]})
        return out

    def drop_branch(self, project: str, source: str, branch: str) -> None:
        for table in (self.tags, self.hashes, self.state):
            table.delete(F.col("branch") == branch, parts=[_part(project, source)])

    def index_ephemeral(self, project: str, source: str, ref: str, items: DataFrame | None = None, label: str | None = None) -> dict:
        """Index a ref's files (or ``items``) under a label of the ephemeral prefix."""
        started = time.time()
        items = self._files(project, source, ref) if items is None else items
        label = self.spark.range(1).select(T.ephemeral_label(F.lit(label or ref)).alias("l")).first()["l"]
        done = self.index_source(project, source, label, items=items)
        return {"label": label, "chunks_new": done["prepared"], "chunks_reused": done["prepared"] - done["persisted"], "duration_ms": int((time.time() - started) * 1000)} | done

    def drop_ephemeral(self, project: str, source: str, label: str) -> dict:
        """Forget an ephemeral label and what only it has; nothing happens where it is gone already."""
        if not label.startswith(branches.EPHEMERAL):
            raise ValueError(f"not an ephemeral label: {label}")
        if label not in self.list_branches(project, source):
            return {"label": label, "dropped": False, "orphans": 0, "bytesFreed": 0}
        self.drop_branch(project, source, label)
        return {"label": label, "dropped": True} | self.gc(project, source)

    def sweep_ephemeral(self) -> list[dict]:
        """Drop every ephemeral label of every source, as at a start."""
        found = branches.ephemeral_branches(self._or_empty(self.tags, TAGS)).orderBy(*branches.SOURCE, "branch").collect()
        return [self.drop_ephemeral(r["project_id"], r["source_id"], r["branch"]) for r in found]

    def list_pinned_branches(self, project: str, source: str | None = None) -> list[dict]:
        return [{"source_id": s["id"], "pinned_branches": s["pinned_branches"]} for s in self.registry.list_sources(project, "code") if source in (None, s["id"])]

    def pin_branches(self, project: str, source: str, names: list[str]) -> dict:
        """Add to the pinned list, in order, each once; warnings for very many and for a source without ignore rules."""
        own = next(p["pinned_branches"] for p in self.list_pinned_branches(project, source))
        all_ = self.registry.update_source(project, source, {"pinned_branches": [*own, *(n for n in dict.fromkeys(names) if n not in own)]})["pinned_branches"]
        many = [f"{len(all_)} branches are pinned; each is polled and indexed"] if len(all_) > MANY_PINS else []
        bare = [] if self.ignore_coverage(project, source)["covered"] else ["the source has no ignore rules of its own"]
        return {"branches": all_, "added": [n for n in all_ if n not in own], "warnings": many + bare}

    def unpin_branches(self, project: str, source: str, names: list[str]) -> dict:
        own = next(p["pinned_branches"] for p in self.list_pinned_branches(project, source))
        left = self.registry.update_source(project, source, {"pinned_branches": [n for n in own if n not in names]})["pinned_branches"]
        return {"branches": left, "removed": [n for n in own if n in names]}

    # --- jobs ---

    def reindex_source(self, project: str, source: str, mode: str = "incremental", branch: str | None = None) -> dict:
        return self.reindex_project(project, [source], mode, branch)

    def reindex_project(self, project: str, source_ids: list[str] | None = None, mode: str = "incremental", branch: str | None = None) -> dict:
        """Queue a job with a task for each source; a full one needs the sources named."""
        if mode == "full" and not source_ids:
            raise ValueError("a full reindex needs source_ids")
        chosen = [self._source(project, s) for s in source_ids] if source_ids else self.registry.get(project)["sources"]
        self.jobs.preempt_gc(project)
        tasks = [{"project_id": project, "source_id": s["id"], "mode": mode, "branch": branch if s["profile"] == "code" else None} for s in chosen]
        return self.jobs.submit(tasks) | {"project_id": project, "mode": mode}

    def reindex_all(self) -> dict:
        tasks = [{"project_id": s["project_id"], "source_id": s["id"]} for s in self.registry.list_sources()]
        return self.jobs.submit(tasks) | {"project_count": len({t["project_id"] for t in tasks}), "mode": "incremental"}

    def _projects(self) -> DataFrame:
        return self.spark.createDataFrame([(p["id"],) for p in self.registry.list_projects()], "project_id string")

    def run_jobs(self, slots: int | None = None) -> list[dict]:
        """Run queued jobs until none may start, one after the other; as many as have slots are admitted at a time."""
        out, slots = [], slots or max(1, (os.cpu_count() or 2) // 2)
        while True:
            decided = self.jobs.admitted(self._projects(), slots)
            for job_id in (j for j, d in decided if d == "fail"):
                self.jobs.set(job_id, status="failed", error="the project is gone", finished_at=jobs.now_ms())
            starting = [j for j, d in decided if d == "start"]
            if not starting:
                return out
            for job_id in starting:
                for task in self.jobs.status(job_id)["tasks"]:
                    if self.jobs.status(job_id)["tasks"][task["task_no"]]["status"] == "queued":
                        self._run_task(task)
                out.append(self.jobs.status(job_id))

    def _run_task(self, task: dict) -> None:
        job, no = task["job_id"], task["task_no"]
        self.jobs.set(job, no, status="running", started_at=jobs.now_ms())
        try:
            if task["type"] == "gc":
                done = self.gc(task["project_id"], task["source_id"])
            else:
                done = self.index_source(task["project_id"], task["source_id"], task["branch"], full=task["mode"] == "full")
        except Exception as e:  # noqa: BLE001  a failed task must not end the queue
            self.jobs.set(job, no, status="failed", error=(str(e).splitlines() or [type(e).__name__])[0][:500], finished_at=jobs.now_ms())
        else:
            self.jobs.set(job, no, status="done", result=str(done), finished_at=jobs.now_ms())

    def reindex_status(self, job_id: int) -> dict:
        return self.jobs.status(job_id)

    def cancel_reindex(self, job_id: int, source_id: str | None = None) -> dict:
        self.jobs.status(job_id)
        return {"job_id": job_id, "cancelled": self.jobs.cancel(job_id, source_id)}

    def list_jobs(self, status: str | None = None, project: str | None = None, kind: str | None = None) -> list[dict]:
        return [r.asDict() for r in maintenance.recent_jobs(self.jobs.rows(), status, project, kind).collect()]

    def queue_status(self, project: str | None = None) -> dict:
        """Running and queued jobs by position, and sources that wait for a word to embed them anew."""
        rows = self.jobs.rows().filter(F.lit(True) if project is None else F.col("project_id") == project)
        live = [r.asDict() for r in maintenance.queue_status(rows).orderBy("position").collect()]
        return {s: [r for r in live if r["status"] == s] for s in ("running", "queued")} | {"awaiting_migration": [s for s, d in self.schema_decisions().items() if d == "await_confirmation" and project in (None, s.split("/")[0])]}

    def schema_decisions(self) -> dict[str, str]:
        """What an older embedding schema asks for, by source."""
        busy = {(r["project_id"], r["source_id"]) for r in self.jobs.rows().filter("status in ('queued', 'running')").collect()}
        rows = [(_part(s["project_id"], s["id"]), s.get("embedding_schema_version"), (s.get("embedded_with") or {}).get("provider", presets.LOCAL), (s["project_id"], s["id"]) in busy, self.chunks.count([_part(s["project_id"], s["id"])])) for s in self.registry.list_sources(profile="code")]
        frame = self.spark.createDataFrame(rows, "source_id string, schema_version int, provider string, active_job boolean, n_chunks long")
        return {r["source_id"]: r["decision"] for r in maintenance.schema_scan(frame).collect()}

    # --- maintenance ---

    def gc(self, project: str | None = None, source: str | None = None, dry_run: bool = False, purge: bool = False) -> dict:
        """Delete chunks without a tag, in scope, and compact; only sources that have some are rewritten."""
        parts = [p for p in self.chunks.parts() if project in (None, p.split("/", 1)[0]) and source in (None, p.split("/", 1)[1])]
        if not parts:
            return {"orphans": 0} if dry_run else {"orphans": 0, "bytesFreed": 0}
        self.jobs.preempt_gc(project)
        rows, tags = self.chunks.read(parts=parts), self._or_empty(self.tags, TAGS, parts)
        by = {r["p"]: r["n"] for r in maintenance.orphans(rows, tags).groupBy(F.concat_ws("/", "project_id", "source_id").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        out: dict = {"orphans": sum(by.values())}
        if dry_run:
            return out
        for p in by:
            own = self._or_empty(self.tags, TAGS, [p])
            lost = maintenance.orphans(self.chunks.read(parts=[p]), own).select("chunk_id").persist()
            lost.count()
            self.chunks.rewrite(lambda current, lost=lost: changes.not_among(current, lost, "chunk_id"), p)
            self._let_go()
            self._drop_postings(lost, p)
            for table in (self.codes, self.symbols):
                table.delete_ids(lost, parts=[p])
            lost.unpersist()
        for table in self.tables.values():
            done = table.compact(purge=purge)
            out["bytesFreed"] = out.get("bytesFreed", 0) + done["bytesFreed"]
            table.prune_orphans()
        self.made.prune_orphans()
        return out

    def gc_when_idle(self, events: DataFrame, since: int, until: int) -> list[dict]:
        """``auto_gc`` for the projects that became idle after ``since`` and up to ``until`` (milliseconds), by their events (project_id, at)."""
        idle = temporal.activity_timers(events, "project_id").filter((F.col("kind") == "idle") & (F.col("at") > since) & (F.col("at") <= until))
        known = [p["id"] for p in self.registry.list_projects()]
        return self.auto_gc([r["project_id"] for r in idle.filter(F.col("project_id").isin(known)).select("project_id").distinct().collect()])

    def auto_gc(self, projects: list[str] | None = None) -> list[dict]:
        """Queue a collection for each source (of some projects) with too many orphans, unless its project was collected a short while ago."""
        last = {r["project_id"]: r["last_gc_at"] for r in maintenance.last_gc(self.jobs.rows()).collect()}
        out = []
        for p in self.registry.list_projects():
            if projects is not None and p["id"] not in projects or jobs.now_ms() - (last.get(p["id"]) or 0) < QUIET_SECONDS * 1000:
                continue
            parts = [_part(p["id"], s["id"]) for s in p["sources"] if s["profile"] == "code"]
            for r in maintenance.orphan_ratio(self._or_empty(self.chunks, CHUNKS, parts), self._or_empty(self.tags, TAGS, parts)).filter("due").orderBy("source_id").collect():
                out.append(self.jobs.submit([{"project_id": p["id"], "source_id": r["source_id"]}], "gc"))
        return out

    def migrate_chunks(self, project: str, source: str) -> dict:
        """Give a source's chunks ids of the current scheme and its tags with them.

        The new rows are written beside the old ones first and the table is marked,
        so that a run that was broken off goes on where it stopped.
        """
        part = _part(project, source)
        rows = self.chunks.read(parts=[part])
        if rows is None or not needs_migration(self.chunks.latest()):
            return {"migrated": 0}
        if self.chunks.latest().get("migrating") != part:
            wrong = maintenance.legacy_mismatches(rows).first()["n_wrong"]
            if wrong:
                raise IndexProblem("table_corrupt", f"{wrong} ids are of neither scheme", project_id=project, source_id=source)
            self.chunks.describe(migrating=part)
        new, mapping = maintenance.rehash(rows.withColumns({"item_url": F.lit(""), "item_type": F.lit("code")}))
        mapping = mapping.persist()
        n = mapping.count()
        self.tags.rewrite(lambda tags: maintenance.rewrite_tags(tags, mapping), part)
        self.chunks.write(new.select(*rows.columns), part, chunk_id_scheme=ID_SCHEME, migrating=None)
        for table in (self.terms, self.lengths, self.codes, self.cells, self.symbols):
            table.drop_parts([part])
        mapping.unpersist()
        return {"migrated": n}

    def upgrade_knowledge(self) -> list[str]:
        """Empty the knowledge sources of an older schema, so that they are fetched again from the start."""
        rows = [(s["project_id"], s["id"], s["profile"], s.get("knowledge_schema_version")) for s in self.registry.list_sources() if s.get("last_indexed")]
        stale = maintenance.to_refetch(self.spark.createDataFrame(rows, "project_id string, source_id string, profile string, knowledge_schema_version int")).collect()
        for r in stale:
            for table in self.tables.values():
                table.drop_parts([_part(r["project_id"], r["source_id"])])
            self.registry.update_source(r["project_id"], r["source_id"], {"cursor": None, "last_indexed": None, "knowledge_schema_version": ID_SCHEME})
        return [_part(r["project_id"], r["source_id"]) for r in stale]

    def open_store(self) -> list[str]:
        """Bring an older store up to date, at a start; live jobs of before are settled."""
        found = self.store.latest()
        steps = maintenance.store_steps(found["store_version"]) if found else []
        for step in steps:
            if step == "reset":
                self.hashes.drop()
                self.tags.drop()
            elif step == "upgrade_jobs":
                old = self.jobs.table.read()
                if old is not None:
                    self.jobs.table.write(maintenance.upgrade_jobs(old).coalesce(1))
        self._renew_text()
        if steps or not found:
            self.store.write(self.spark.createDataFrame([(STORE_VERSION,)], "version int"), store_version=STORE_VERSION)
        self.jobs.reconcile(self._projects())
        return steps

    def _renew_text(self) -> None:
        """Make the text index anew where it was kept with ids in its postings."""
        kept = self.terms.latest()
        if kept is None or any(f["name"] == "members" for f in kept["schema"]["fields"]):
            return
        parts = self.terms.parts()
        for table in (self.terms, self.lengths):
            table.drop()
        for part in parts:
            for table in (self.chunks, self.knowledge):
                if part in table.parts():
                    self._index_text(table.read(parts=[part]), part)

    def health(self, only: str | None = None) -> dict[str, str]:
        """State of each (or one) table's current version; a store that cannot be listed is looked at once more, then ``unknown``."""
        out = {}
        for name, table in (("code", self.chunks), ("knowledge", self.knowledge)):
            if only not in (None, name):
                continue
            for last in (False, True):
                try:
                    row = maintenance.health(*table.manifest_rows(name), self.dims).first() if table._numbers() else None
                    out[name] = row["health"] if row else "healthy"
                    break
                except Exception:  # noqa: BLE001
                    out[name] = "unknown"
                    if not last:
                        time.sleep(0.1)
        return out

    def repair(self) -> dict[str, int | None]:
        """Go back to the newest version that can be read, where the current one cannot."""
        return {name: table.repair() for name, table in (("code", self.chunks), ("knowledge", self.knowledge)) if self.health(name)[name] not in ("healthy", "unknown")}

    def _conditions(self) -> DataFrame:
        """What the doctor looks at, a row for each source."""
        health, rows = self.health(), []
        for s in self.registry.list_sources():
            part, table, name = _part(s["project_id"], s["id"]), *((self.chunks, "code") if s["profile"] == "code" else (self.knowledge, "knowledge"))
            there = part in table.parts()
            ratio = maintenance.orphan_ratio(table.read(parts=[part]), self._or_empty(self.tags, TAGS, [part])).first() if there and s["profile"] == "code" else None
            scheme = (table.latest() or {}).get("chunk_id_scheme", ID_SCHEME if name == "knowledge" else None)
            rows.append((s["project_id"], s["id"], there, health[name], scheme, len(table._numbers()), ratio["ratio"] if ratio else None, self.searchable(s).get("reason")))
        return self.spark.createDataFrame(rows, "project_id string, source_id string, indexed boolean, health string, scheme int, versions int, ratio double, unsearchable string")

    def doctor(self) -> dict:
        """Checks of every source and of the queue, and how many are ok, warn, fail and skipped."""
        checks = maintenance.doctor_checks(self._conditions()).unionByName(maintenance.job_checks(self.jobs.rows(), jobs.now_ms())).persist()
        counts = maintenance.check_counts(checks).first()
        out = {"checks": [r.asDict() for r in checks.orderBy("project_id", "source_id", "check").collect()], "summary": {s: counts[f"n_{s}"] for s in ("ok", "warn", "fail", "skip")}}
        checks.unpersist()
        return out

    def status(self) -> dict:
        return {name: table.stats() | {"rows": table.count()} for name, table in (("code", self.chunks), ("knowledge", self.knowledge), ("branch_tags", self.tags))}

    # --- commands by name ---

    def call(self, command: str, given: dict):
        """A command by its name with parameters as a caller sends them, checked first."""
        if command not in COMMANDS:
            near = params.suggest(command, list(COMMANDS))
            raise LookupError(f"unknown command '{command}'" + (f", did you mean '{near}'?" if near else ""))
        method, schema = COMMANDS[command]
        wrong = params.violation(schema, given)
        if wrong is not None:
            raise ValueError(wrong)
        target = getattr(self.registry if method.startswith("registry.") else self, method.removeprefix("registry."))
        return target(**{k: v for k, v in given.items() if v is not None})


def _schema(required: str = "", optional: str = "", **kinds: dict) -> dict:
    names = [*required.split(), *optional.split()]
    return {"properties": {n: kinds.get(n, {"type": "string"}) for n in names}, "required": required.split()}


_NAMES, _NUMBER, _FLAG = {"type": "array", "items": {"type": "string"}}, {"type": "number"}, {"type": "boolean"}
_MODE = {"type": "string", "enum": ["full", "incremental"]}

#: Method and parameters of each command.
COMMANDS: dict[str, tuple[str, dict]] = {
    "init": ("init", _schema("code_provider", "code_model code_api_key code_base_url code_dim text_provider text_model text_api_key text_base_url text_dim reconfigure", code_dim=_NUMBER, text_dim=_NUMBER, reconfigure=_FLAG)),
    "doctor": ("doctor", _schema()),
    "status": ("status", _schema()),
    "list_projects": ("list_projects", _schema()),
    "add_project": ("registry.add_project", _schema("project", "description")),
    "update_project": ("registry.update_project", _schema("project description")),
    "remove_project": ("remove_project", _schema("project")),
    "list_sources": ("registry.list_sources", _schema("", "project profile")),
    "add_source": ("registry.add_source", _schema("project source", source={"type": "object"})),
    "update_source": ("registry.update_source", _schema("project source fields", fields={"type": "object"})),
    "remove_source": ("remove_source", _schema("project source")),
    "search_code": ("search_code", _schema("project query", "top_k branch sources", top_k=_NUMBER, sources=_NAMES)),
    "search_knowledge": ("search_knowledge", _schema("project query", "top_k source item_types", top_k=_NUMBER, item_types=_NAMES)),
    "lookup_symbol": ("lookup_symbol", _schema("project name", "match branch source case_sensitive limit", match={"type": "string", "enum": ["exact", "suffix"]}, case_sensitive=_FLAG, limit=_NUMBER)),
    "reindex_all": ("reindex_all", _schema()),
    "reindex_project": ("reindex_project", _schema("project", "source_ids mode branch", source_ids=_NAMES, mode=_MODE)),
    "reindex_source": ("reindex_source", _schema("project source", "mode branch", mode=_MODE)),
    "reindex_status": ("reindex_status", _schema("job_id", job_id=_NUMBER)),
    "cancel_reindex": ("cancel_reindex", _schema("job_id", "source_id", job_id=_NUMBER)),
    "list_jobs": ("list_jobs", _schema("", "status project kind")),
    "queue_status": ("queue_status", _schema("", "project")),
    "index_ephemeral": ("index_ephemeral", _schema("project source ref", "label")),
    "drop_ephemeral": ("drop_ephemeral", _schema("project source label")),
    "gc": ("gc", _schema("", "project source dry_run purge", dry_run=_FLAG, purge=_FLAG)),
    "list_branches": ("list_branches", _schema("project source")),
    "list_pinned_branches": ("list_pinned_branches", _schema("project", "source")),
    "pin_branches": ("pin_branches", _schema("project source names", names=_NAMES)),
    "unpin_branches": ("unpin_branches", _schema("project source names", names=_NAMES)),
    "set_private_ignore": ("set_private_ignore", _schema("project source content")),
    "get_private_ignore": ("get_private_ignore", _schema("project source")),
    "list_private_ignores": ("list_private_ignores", _schema("", "project")),
    "add_embedding_preset": ("add_embedding_preset", _schema("name provider model", "credentials credentials_from base_url dim max_input_tokens slot", dim=_NUMBER, max_input_tokens=_NUMBER)),
    "assign_preset": ("assign_preset", _schema("slot preset_name", slot={"type": "string", "enum": ["code", "text", "rerank"]})),
}
