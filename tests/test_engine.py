"""The engine's commands: several sources, branches of repositories, jobs, presets, health, upgrades."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.api import STATE, TAGS, Engine, IndexProblem
from siltstone.functions import embedding
from siltstone.functions import text as T
from siltstone.operators import ranking, retrieval, scheduling
from siltstone.sources import repository

SHA = "0123456789abcdef0123456789abcdef01234567"


def files(spark, **contents):
    return spark.createDataFrame([(f"{n}.py", c, "python") for n, c in contents.items()], "item_path string, content string, language string")


def engine(spark, path, *sources, **options):
    e = Engine(spark, f"file://{path}/index", dims=options.pop("dims", 16), **options)
    e.registry.add_project("p", "words")
    for s in sources:
        e.registry.add_source("p", s)
    return e


def code(name, root=""):
    return {"id": name, "type": "code", "root": root}


def repo(path, head="ref: refs/heads/main\n"):
    (path / ".git" / "refs" / "heads").mkdir(parents=True)
    (path / ".git" / "HEAD").write_text(head)
    (path / ".git" / "refs" / "heads" / "main").write_text(SHA + "\n")
    (path / ".git" / "packed-refs").write_text(f"# pack-refs\n{SHA[::-1]} refs/remotes/origin/rel\n")
    return path


def test_heads_of_repositories(spark, tmp_path):
    root = repo(tmp_path / "r")
    at = f"file://{root}"
    assert repository.head_branch(spark, at) == "main" and repository.commit_of(spark, at, "main") == SHA
    assert repository.commit_of(spark, at, "rel") == SHA[::-1] == repository.commit_of(spark, at, "origin/rel")
    assert repository.commit_of(spark, at, "nope") is None and repository.head_branch(spark, f"file://{tmp_path}") == "*"
    (root / ".git" / "HEAD").write_text(SHA)
    assert repository.head_branch(spark, at) == SHA[:12] and repository.commit_of(spark, at, SHA[:12]) == SHA
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / ".git").write_text(f"gitdir: {root}/.git")
    assert repository.head_branch(spark, f"file://{tree}") == SHA[:12]


def test_search_on_the_checked_out_branch_and_by_source(spark, tmp_path):
    root = repo(tmp_path / "r")
    (root / "a.py").write_text("def alpha_sentinel():\n    return 1\n")
    (root / "skip.py").write_text("def hidden_sentinel():\n    return 1\n")
    (root / ".siltstoneignore").write_text("# none\nskip.py\n")
    (root / "own.py").write_text("def private_sentinel():\n    return 1\n")
    e = engine(spark, tmp_path, code("r", f"file://{root}"), code("s"))
    assert e.searchable(e._source("p", "r")) == {"ok": False, "reason": "never indexed"}
    assert e.set_private_ignore("p", "r", "own.py\n")["action"] == "written" and e.set_private_ignore("p", "r", "own.py\n")["action"] == "unchanged"
    assert e.index_source("p", "r")["reindexed"] == 1
    assert e.last_indexed_sha("p", "r", "main") == SHA and e.list_branches("p", "r") == ["main"]
    e.index_source("p", "r", "dev", items=files(spark, b="def alpha_sentinel_dev():\n    return 2\n"))
    e.index_source("p", "s", "origin/main", items=files(spark, c="def alpha_sentinel_other():\n    return 3\n"))
    found = {r.symbol_name: r.branches for r in e.search_code("p", "alpha sentinel", 9).collect()}
    assert found == {"alpha_sentinel": ["main"], "alpha_sentinel_other": ["origin/main"]}
    assert {r.symbol_name for r in e.search_code("p", "alpha", 9, "*").collect()} == {"alpha_sentinel", "alpha_sentinel_dev", "alpha_sentinel_other"}
    assert [r.symbol_name for r in e.search_code("p", "alpha", 9, "dev").collect()] == ["alpha_sentinel_dev"]
    assert {r.source_id for r in e.search_code("p", "alpha", 9, "main", sources=["s"]).collect()} == {"s"}
    assert e.search_code("p", "alpha", 9, "nowhere").count() == 0
    assert e.ignore_coverage("p", "r") == {"covered": True, "committed": True, "private": True} and not e.ignore_coverage("p", "s")["covered"]
    assert e.list_private_ignores() == [{"project_id": "p", "source_id": "r", "rule_count": 1, "mtime": e.list_private_ignores("p")[0]["mtime"]}]
    assert any("ignore" in w for w in e.pin_branches("p", "s", [f"b{i}" for i in range(21)])["warnings"]) and len(e.list_pinned_branches("p", "s")[0]["pinned_branches"]) == 21
    assert e.set_private_ignore("p", "r", "")["action"] == "deleted" and e.get_private_ignore("p", "r")["content"] is None
    e.remove_project("p")
    assert e.chunks.count() == e.tags.count() == e.hashes.count() == e.terms.count() == 0 and e.list_projects() == []
    e.registry.add_project("p")
    e.registry.add_source("p", code("r"))
    assert e.search_code("p", "alpha", 9, "*").count() == 0


def test_rerankers_and_their_failures(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    return 'apple pear'\n", b="def two():\n    return 'apple'\n"))
    plain = [r.symbol_name for r in e.search_code("p", "apple pear", 2, "*").collect()]
    assert [r.symbol_name for r in e.search_code("p", "apple pear", 2, "*", rerank=ranking.lexical_reranker).collect()][0] == "one"

    def broken(hits, query):
        raise OSError("no model")

    assert [r.symbol_name for r in e.search_code("p", "apple pear", 2, "*", rerank=broken).collect()] == plain
    broken.remote = True
    with pytest.raises(OSError):
        e.search_code("p", "apple pear", 2, "*", rerank=broken)
    logits = ranking.logit_reranker(lambda hits, query: hits.select("chunk_id", F.array(F.lit(0.0), F.when(F.col("symbol_name") == "two", 9.0).otherwise(-9.0)).alias("logits")))
    scored = logits(e.search_code("p", "apple", 2, "*"), "apple")
    assert sorted(round(r.rerank, 3) for r in scored.collect()) == [0.0, 1.0]


def test_kept_indexes(spark, tmp_path, monkeypatch):
    """Postings are refreshed by runs and collections; codes under the row gate, refreshed when forced, and complete for what came later."""
    monkeypatch.setattr(retrieval, "INDEX_ROWS", 4)
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def поиск():\n    return 1\n"))
    assert e.terms.count() > 0 and e.create_vector_index("p", "s") is False
    e.index_source("p", "s", "main", items=files(spark, **{f"f{i}": f"def word{i}():\n    return {i}\n" for i in range(6)}))
    assert e.create_vector_index("p", "s") is True and e.create_vector_index("p", "s") is False and e.create_vector_index("p", "s", force=True)
    e.index_source("p", "s", "main", items=files(spark, **{f"f{i}": f"def word{i}():\n    return {i}\n" for i in range(7)}))
    assert e.search_code("p", "word6", 1, "*").first().symbol_name == "word6" and e.search_code("p", "поиск", 1, "*").first().symbol_name == "поиск"
    before = e.terms.count()
    assert e.gc("p", "s")["orphans"] == 1 and e.terms.count() < before and e.codes.count() == 6
    assert e.index_source("p", "s", "main", full=True, items=files(spark, g="def again():\n    pass\n"))["persisted"] == 1
    assert e.backfill.failed == {} and e.codes.count() >= 6
    assert "again" in {r.symbol_name for r in e.search_code("p", "again", 2).collect()}


def test_runs_in_parts_and_after_a_failure(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    many = files(spark, **{f"f{i}": f"def w{i}():\n    return {i}\n" for i in range(9)})
    assert e.index_source("p", "s", "main", items=many, flush_files=3)["persisted"] == 9
    assert e.tags.count() == 9 == e.hashes.count() and len(e.chunks.latest()["parts"]["p/s"]) > 1
    e.encode = lambda text, dims: np.zeros(dims + 1)
    with pytest.raises(Exception, match="17 components"):
        e.index_source("p", "s", "main", items=files(spark, x="def new():\n    pass\n"))
    e.encode = embedding.hash_vector
    done = e.index_source("p", "s", "main", items=files(spark, x="def new():\n    pass\n"))
    assert (done["removed"], done["persisted"], e.tags.count()) == (9, 1, 1)


def test_embedding_batches():
    assert embedding.probe_size(None, None, 64) == 64 and embedding.probe_size(8, 32, 64) == 20 and embedding.probe_size(8, 9, 64) == 8
    asked, waits = [], []

    def model(texts):
        asked.append(len(texts))
        if len(texts) > 3:
            raise embedding.TooLarge
        return [np.ones(2) * len(t) for t in texts]

    sizes = embedding.Sizes()
    texts = ["x" * n for n in (9, 1, 5, 7, 3, 2, 8)]
    got = embedding.encode_all(texts, model, 2, sizes=sizes)
    assert [v[0] for v in got] == [9, 1, 5, 7, 3, 2, 8] and (sizes.good, sizes.refused) == (3, 4) and asked[0] == 7
    answers = [embedding.RateLimited(), embedding.RateLimited(), [1]]

    def limited():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert embedding.patient(limited, sleep=waits.append) == [1] and waits == [5.0, 10.0]
    answers[:] = [embedding.RateLimited()] * 5
    with pytest.raises(embedding.RateLimited):
        embedding.patient(limited, sleep=waits.append)


def test_batch_sizes_are_remembered(spark, tmp_path):
    class Narrow:
        """A model that takes two texts at most."""

        batched, __name__ = True, "narrow"

        def __call__(self, texts, dims):
            if len(texts) > 2:
                raise embedding.TooLarge
            return [np.ones(dims) for _ in texts]

    e = engine(spark, tmp_path, code("s"), encode=Narrow())
    e.index_source("p", "s", "main", items=files(spark, **{f"f{i}": f"def w{i}():\n    return {i}\n" for i in range(7)}).coalesce(1))
    row = e.batches.read().first()
    assert row.last_successful <= 2 < row.max_failed


def test_jobs(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def here():\n    pass\n")
    e = engine(spark, tmp_path, code("s", f"file://{root}"), code("gone", f"file://{tmp_path}/nothing"))
    with pytest.raises(ValueError):
        e.reindex_project("p", mode="full")
    first = e.reindex_source("p", "s")
    again = e.reindex_source("p", "s")
    assert (first["queue_position"], first["duplicate_of_pending"], again["duplicate_of_pending"]) == (1, False, True)
    assert e.cancel_reindex(again["job_id"])["cancelled"] == 1 and e.reindex_status(again["job_id"])["status"] == "cancelled"
    both = e.reindex_all()
    assert len(e.queue_status("p")["queued"]) == 3 and e.reindex_status(both["job_id"])["status"] == "queued"
    ran = {j["job_id"]: j for j in e.run_jobs(slots=2)}
    assert ran[first["job_id"]]["status"] == "done" and ran[both["job_id"]]["status"] == "failed" and ran[both["job_id"]]["error"]
    assert [t["status"] for t in ran[both["job_id"]]["tasks"]] == ["done", "failed"]
    assert {j["status"] for j in e.list_jobs(project="p")} == {"done", "failed", "cancelled"} and e.search_code("p", "here", 1, sources=["s"]).count() == 1
    assert e.doctor()["summary"]["warn"] >= 1 and any(c["check"] == "jobs" and c["status"] == "warn" for c in e.doctor()["checks"])
    (root / "a.py").write_text("def there():\n    pass\n")
    e.index_source("p", "s")
    assert [j["job_id"] for j in e.auto_gc()] == [4] and e.run_jobs()[0]["status"] == "done" and e.chunks.count() == 1 and e.auto_gc() == []
    stuck = e.reindex_source("p", "s")
    assert e.open_store() == [] and e.reindex_status(stuck["job_id"])["status"] == "interrupted"
    lost = e.reindex_source("p", "s")
    e.registry.remove_project("p")
    assert e.run_jobs() == [] and e.reindex_status(lost["job_id"])["error"] == "the project is gone"
    with pytest.raises(KeyError):
        e.reindex_status(99)


def test_polls_of_pinned_branches(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    pass\n"))
    e.pin_branches("p", "s", ["main", "new", "away"])
    remotes = spark.createDataFrame([("p", "s", "main", "sha1"), ("p", "s", "new", "sha2")], "project_id string, source_id string, branch string, sha string")
    assert {r["branch"]: r["decision"] for r in e.poll_fetches(remotes)} == {"main": "baseline", "new": "enqueue", "away": "warn_no_remote"}
    assert e.last_indexed_sha("p", "s", "main") == "sha1" and [j["branch"] for j in e.list_jobs("queued")] == ["new"]
    assert {r["branch"]: r["decision"] for r in e.poll_fetches(remotes)}["main"] == "up_to_date"


def test_ephemeral_labels_are_swept(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    pass\n"))
    made = e.index_ephemeral("p", "s", "origin/pr", files(spark, a="def one():\n    pass\n", b="def two():\n    pass\n"))
    assert (made["label"], made["chunks_new"], made["chunks_reused"]) == ("_ephemeral/pr", 2, 1)
    assert [(d["label"], d["orphans"]) for d in e.sweep_ephemeral()] == [("_ephemeral/pr", 1)] and e.list_branches("p", "s") == ["main"]
    assert e.drop_ephemeral("p", "s", "_ephemeral/pr")["dropped"] is False


def test_health_gate_and_repair(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    pass\n"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    pass\n", b="def two():\n    pass\n"))
    assert e.health() == {"code": "healthy", "knowledge": "healthy"} and e.doctor()["summary"]["fail"] == 0
    newest = e.chunks.latest()["parts"]["p/s"][-1]
    for f in (tmp_path / "index" / "code" / "data" / newest).glob("*.parquet"):
        f.unlink()
    assert e.health()["code"] == "manifest_missing_data"
    with pytest.raises(IndexProblem) as problem:
        e.search_code("p", "one")
    assert problem.value.kind == "table_corrupt" and problem.value.details["source_id"] == "s"
    assert e.doctor()["summary"]["fail"] == 1
    (tmp_path / "index" / "code" / "data" / newest).rename(tmp_path / "away")
    assert e.repair() == {"code": 1} and e.search_code("p", "one", 1, "*").first().symbol_name == "one"
    e.dims = 99
    assert e.health()["code"] == "dim_mismatch"


def test_migration_of_old_ids(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    pass\n", b="def two():\n    pass\n"))
    new = {r.chunk_id for r in e.chunks.read().collect()}
    legacy = T.legacy_chunk_id(*(F.col(c) for c in ("project_id", "source_id", "language", "content")))
    ids = e.chunks.read().select("chunk_id", legacy.alias("old")).collect()
    of = F.create_map(*[F.lit(x) for r in ids for x in (r.chunk_id, r.old)])
    e.chunks.write(e.chunks.read().withColumn("chunk_id", legacy), "p/s", chunk_id_scheme=1)
    e.tags.rewrite(lambda t: t.withColumn("chunk_id", of[F.col("chunk_id")]), "p/s")
    with pytest.raises(IndexProblem) as problem:
        e.search_code("p", "one", branch="*")
    assert problem.value.kind == "needs_migration"
    assert e.migrate_chunks("p", "s") == {"migrated": 2} and e.migrate_chunks("p", "s") == {"migrated": 0}
    assert {r.chunk_id for r in e.chunks.read().collect()} == new == {r.chunk_id for r in e.tags.read().collect()}
    assert e.search_code("p", "one", 1, "main").first().symbol_name == "one"


def test_upgrades_of_store_and_knowledge(spark, tmp_path):
    e = engine(spark, tmp_path, {"id": "t", "type": "ticket", "issues": "", "notes": ""})
    assert e.open_store() == [] and e.open_store() == []
    e.store.describe(store_version=1)
    e.tags.write(spark.createDataFrame([], TAGS))
    assert e.open_store() == ["reset", "upgrade_jobs"] and e.tags.latest() is None
    e.registry.update_source("p", "t", {"last_indexed": 5, "cursor": "c"})
    assert e.upgrade_knowledge() == ["p/t"] and e._source("p", "t")["cursor"] is None and e.upgrade_knowledge() == []
    assert e.state.read() is None and STATE


def test_presets(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path, code("s"))
    e.index_source("p", "s", "main", items=files(spark, a="def one():\n    pass\n"))
    assert e.searchable(e._source("p", "s")) == {"ok": True}
    assert e.init("custom")["status"] == "validation_failed"
    done = e.init("local")
    assert done["status"] == "configured" and done["indexed_projects"] == ["p"] and e.init("local")["status"] == "already_configured"
    e.add_embedding_preset("v", "voyage", "voyage-code-3", credentials="${SILT_KEY}")
    e.add_embedding_preset("w", "custom", "m", dim=16, base_url="http://x", credentials_from="v")
    e.add_embedding_preset("x", "custom", "m", dim=16, base_url="http://x", credentials_from="w")
    for call in (lambda: e.add_embedding_preset("v", "local", "x"), lambda: e.add_embedding_preset("u", "voyage", "nope"), lambda: e.presets.resolve("v", "text"), lambda: e.presets.resolve("x", "code"), lambda: e.add_embedding_preset("u", "nobody", "m")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError, match="SILT_KEY"):
        e.assign_preset("code", "v")
    monkeypatch.setenv("SILT_KEY", "k")
    assert e.presets.resolve("w", "code")["credentials"] == "k" and e.presets.resolve("v", "code")["dims"] == 1024
    assert e.assign_preset("code", "v") == {"ok": True, "requires_reindex": True}
    monkeypatch.delenv("SILT_KEY")
    assert "SILT_KEY" in e.searchable(e._source("p", "s"))["reason"] and "SILT_KEY" in e.list_projects()[0]["sources"][0]["searchable"]["reason"]
    assert e.assign_preset("rerank", "none")["ok"] and e.presets.names() == ["code", "text", "v", "w", "x"]


def test_calls_are_checked(spark, tmp_path):
    e = engine(spark, tmp_path, code("s"))
    with pytest.raises(LookupError, match="did you mean 'search_code'"):
        e.call("serch_code", {})
    with pytest.raises(ValueError, match="missing parameter 'query'"):
        e.call("search_code", {"project": "p"})
    with pytest.raises(ValueError, match="must be one of full, incremental"):
        e.call("reindex_source", {"project": "p", "source": "s", "mode": "half"})
    assert [s["id"] for s in e.call("list_sources", {"project": "p"})] == ["s"] and e.call("status", {})["code"]["rows"] == 0


def test_first_in_first_out():
    built = []

    def build(name, force):
        built.append((name, force))
        if name == "b":
            raise OSError("disk")
        if name == "a" and len(built) == 1:
            assert not queue.request("a") and queue.run() == [] and queue.request("c")

    queue = scheduling.Fifo(build)
    assert queue.request("a") and queue.request("b", force=True) and not queue.request("b")
    assert queue.run() == ["a", "c"] and built == [("a", False), ("b", True), ("c", False)] and queue.failed == {"b": "disk"}


def test_knowledge_of_two_sources_is_fused(spark, tmp_path):
    e = engine(spark, tmp_path, *({"id": t, "type": "ticket", "issues": "", "notes": ""} for t in ("t", "u")))
    with pytest.raises(LookupError, match="NO_KNOWLEDGE_SOURCES"):
        e.search_knowledge("p", "x")
    columns = "item_path string, item_url string, item_type string, author string, timestamp string, content string, state string, labels string, assignees string, milestone string, confidential string"

    def items(*contents):
        return spark.createDataFrame([(f"issues/{i}", "u", "issue", "ann", "", c, "open", "[]", "[]", "", "false") for i, c in enumerate(contents)], columns)

    e.index_source("p", "t", items=items("printer on fire", "coffee"))
    e.index_source("p", "u", items=items("printer jam", "printer printer"))
    hits = e.search_knowledge("p", "printer", 4).collect()
    assert len(hits) == 4 and {r.source_id for r in hits[:2]} == {"t", "u"} and [r["rank"] for r in hits] == [1, 2, 3, 4]
    assert {r.source_id for r in e.search_knowledge("p", "printer", 4, source="u").collect()} == {"u"}
    e.index_source("p", "t", full=True, items=items("only this"))
    assert e.knowledge.count(["p/t"]) == 1 == e.lengths.count(["p/t"]) and e.knowledge.count(["p/u"]) == 2
