"""The vector index of cells."""

import numpy as np
import pytest

from siltstone.api import Engine
from siltstone.operators import cells, retrieval
from siltstone.plans import adapters, catalog


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<float>")


def test_recall_and_share(spark):
    row = catalog.QUERIES["ann_cells_measures"](spark, "/root/testdata/sf0.01").first()
    assert row.recall >= 0.99 and row.share_read <= 0.15, row


def test_only_the_probed_cells_are_read(spark, tmp_path):
    vectors, queries = adapters.jittered(spark, "/root/testdata/sf0.001")
    model = cells.fit(vectors, 64)
    cells.laid_out(cells.codes(vectors, model)).write.parquet(f"file://{tmp_path}/codes")
    kept = spark.read.parquet(f"file://{tmp_path}/codes")
    found = cells.search(vectors, kept, model, queries.limit(1), 10)
    assert "PushedFilters: [In(cell" in found._jdf.queryExecution().executedPlan().toString()
    again = cells.model_of(cells.model_rows(spark, model))
    assert np.allclose(again.centres, model.centres) and np.allclose(again.values, model.values) and again.probes == model.probes


@pytest.mark.parametrize("dims", [3, 10])
def test_all_probed_is_nearly_exact(spark, dims, monkeypatch):
    """Every cell probed, one cell of a third of the rows in many blocks, components that no group divides, zero vectors."""
    monkeypatch.setattr(cells, "DATA_BLOCK", 50)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(size=(400, dims)), np.repeat(rng.normal(size=(1, dims)), 200, axis=0), np.zeros((2, dims))]).astype(np.float32)
    vectors = frame(spark, x)
    queries = vectors.filter("chunk_id % 50 = 7").selectExpr("chunk_id as query_id", "vector")
    model = cells.fit(vectors, dims, cells=12)
    coded = cells.codes(vectors, model)
    got = cells.search(vectors, coded, model, queries, 5, probes=12).collect()
    want = retrieval.search(vectors, queries, 5, dims).collect()
    best = {(r.query_id, r["rank"]): r.score for r in want}
    assert len(got) == len(want) and np.mean([abs(r.score - best[r.query_id, r["rank"]]) < 1e-6 for r in got]) > 0.9


def test_edges(spark):
    none = frame(spark, np.zeros((0, 4)))
    model = cells.fit(none, 4)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<float>")
    assert cells.search(none, cells.codes(none, model), model, queries, 3).count() == 0
    one = frame(spark, np.ones((1, 4), np.float32))
    model = cells.fit(one, 4)
    assert [r.score for r in cells.search(one, cells.codes(one, model), model, queries, 3).collect()] == [pytest.approx(0.5)]
    assert cells.search(one, cells.codes(one, model), model, queries.limit(0), 3).count() == 0


def test_engine_searches_by_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "INDEX_ROWS", 50)
    e = Engine(spark, f"file://{tmp_path}/i", dims=32, hybrid=False)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": ""})
    files = [(f"f{i}.md", f"topic{i % 7} word{i} tail{i}", "markdown") for i in range(80)]
    schema = "item_path string, content string, language string"
    e.index_source("p", "s", "main", items=spark.createDataFrame(files, schema), full=True)
    assert e.cells.parts() == ["p/s"] and e.codes.read().columns == ["chunk_id", "cell", "code"]
    asked = []
    search = cells.search
    monkeypatch.setattr(cells, "search", lambda *a: asked.append(a[2]) or search(*a))
    assert e.search_code("p", "topic3 word3 tail3", 3).first().item_path == "f3.md"
    files += [("late.md", "quite another thing", "markdown")]  # coded when it is asked
    e.index_source("p", "s", "main", items=spark.createDataFrame(files, schema))
    assert e.search_code("p", "quite another thing", 1).first().item_path == "late.md"
    assert len(asked) == 2 and asked[0] is asked[1]


@pytest.mark.parametrize("dims", [2, 10])
def test_whole_search_gives_the_exact_rows_with_ties(spark, dims, monkeypatch):
    """Many equal vectors, of which the codes' candidates hold only some; one probe finds few of a query's neighbours."""
    monkeypatch.setattr(cells, "DATA_BLOCK", 50)
    monkeypatch.setattr(cells.Cells, "probes", 1)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(size=(500, dims)), np.repeat(rng.normal(size=(3, dims)), 200, axis=0), np.zeros((2, dims))]).astype(np.float32)
    vectors = frame(spark, x[rng.permutation(len(x))])
    queries = vectors.filter("chunk_id % 20 = 7").selectExpr("chunk_id as query_id", "vector")
    model = cells.fit(vectors, dims, cells=24)
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    want = rows(retrieval.search(vectors, queries, 7, dims))
    coded = cells.codes(vectors, model)
    assert rows(cells.search_whole(vectors, coded, model, queries, 7)) == want
    assert rows(cells.search(vectors, coded, model, queries, 7)) != want


def test_engine_with_an_index_ranks_ties_by_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "INDEX_ROWS", 50)
    e = Engine(spark, f"file://{tmp_path}/i", dims=2, hybrid=False, encode=lambda text, dims: np.array([len(text) % 5, 100.0], dtype=np.float32))
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": ""})
    files = [(f"f{i}.md", "x" * (i % 40 + 1) + f" {i:04}", "markdown") for i in range(3000)]  # six hundred of each length modulo five
    e.index_source("p", "s", "main", items=spark.createDataFrame(files, "item_path string, content string, language string"), full=True)
    assert e.cells.parts() == ["p/s"]
    found = [r.item_path for r in e.search_code("p", "abc", 3).collect()]
    e.exact = True
    assert found == [r.item_path for r in e.search_code("p", "abc", 3).collect()]


def test_exact_search_passes_over_groups_of_near_copies():
    """Near copies of any order are held in groups, of which only those are scored that can reach a query's bar; the rows stay."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    x = np.vstack([np.repeat(base, 50, axis=0) + 0.1 * rng.normal(size=(2000, 64)), rng.normal(size=(30, 64)), np.zeros((3, 64))])
    x = x[rng.permutation(len(x))].astype(np.float32)
    q = retrieval._unit(x[::20].astype(np.float64))
    plain, grouped = (retrieval._Rows(np.arange(len(x)), x, False) for _ in range(2))
    grouped.group()
    assert len(grouped.loose) + len(grouped.leaders) < len(x) / 3
    bar = np.sort(np.round(q @ plain.exact.T, 12), axis=1)[:, -10]
    some = np.where(np.arange(len(q)) % 5 == 0, -np.inf, bar)  # of some no bar is known
    want, got = (sorted(zip(*(c.tolist() for c in rows.pairs(q, b, 10)), strict=True)) for rows, b in ((plain, bar), (grouped, bar)))
    assert [p[:2] for p in want] == [p[:2] for p in got] and np.allclose([p[2] for p in want], [p[2] for p in got], atol=1e-11)
    best = []
    for rows, b in ((plain, some), (grouped, some)):
        held = retrieval._Best(None, b.copy())
        held.add(rows, q, 10)
        order = np.lexsort((held.held[1], -held.held[2], held.held[0]))
        best.append([held.held[i][order].tolist() for i in (0, 1)])
    assert best[0] == best[1] and len(best[0][0]) == 10 * len(q)


def test_found_rows_change_no_row_of_the_exact_search(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([np.repeat(rng.normal(size=(30, 8)), 40, axis=0) + 0.05 * rng.normal(size=(1200, 8)), np.repeat(rng.normal(size=(1, 8)), 90, axis=0), np.zeros((2, 8))]).astype(np.float32)
    vectors = frame(spark, x[rng.permutation(len(x))])
    queries = vectors.filter("chunk_id % 20 = 7").selectExpr("chunk_id as query_id", "vector")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = rows(retrieval.search(vectors, queries, 7, 8))
    found = retrieval.search(vectors.filter("chunk_id % 3 < 2"), queries.filter("query_id % 40 = 7"), 7, 8)
    assert len(want) == 7 * queries.count() and rows(retrieval.search(vectors, queries, 7, 8, found=found)) == want


def test_a_block_of_the_exact_search_is_no_group_of_one_key(spark):
    """Blocks are packed where the rows are: no whole group of rows with lists for its vectors reaches a worker."""
    vectors = frame(spark, np.eye(4))
    found = retrieval.search(vectors, vectors.selectExpr("chunk_id as query_id", "vector"), 2, 4)
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_memory_of_the_exact_search_is_bounded():
    """Blocks of any number of queries, and equal rows that all reach the bar, are looked at in parts."""
    import tracemalloc

    x = np.vstack([np.random.default_rng(1).normal(size=(4000, 64)), np.ones((200, 64))]).astype(np.float32)
    q = retrieval._unit(np.vstack([x[:2000], np.ones((1000, 64))]).astype(np.float64))
    tracemalloc.start()
    rows = retrieval._Rows(np.arange(len(x)), x, False)
    held = retrieval._Best(None, np.full(len(q), -np.inf))
    held.add(rows, q, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held.held[0]) == 10 * len(q) and peak < 150e6, peak
