"""Symbol lookups by the index, against the scan."""

import pytest

from siltstone.api import Engine
from siltstone.operators import lookup

NAMES = ["a.Run", "a.b.run", "run", "xrun", "a.r_n", "a.ran", "Ünï.Çode", "ün.çode", "a.run.more", "", None, "%.run", "a\\b.run"]


@pytest.mark.parametrize("match", ["suffix", "exact"])
def test_index_finds_what_the_scan_finds(spark, tmp_path, match):
    chunks = spark.createDataFrame([(f"c{i}", n, "py", "p", i) for i, n in enumerate(NAMES)], "chunk_id string, symbol_name string, language string, item_path string, start_line int")
    tags = chunks.selectExpr("chunk_id", "'main' as branch")
    lookup.symbol_index(chunks).write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    assert index.count() == len([n for n in NAMES if n])
    for name in ("run", "Run", "r_n", "%n", "b.run", "çode", "more", "none", "%", "b.run_"):
        for options in ({}, {"case_sensitive": False}, {"literal": True}):
            ask = lambda i: [r.chunk_id for r in lookup.lookup_symbol(chunks, tags, name, match, index=i, **options).collect()]  # noqa: B023, E731
            assert ask(index) == ask(None), (name, options)
    plan = lookup.candidates(index, "b.run")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(low), StringStartsWith(low,nur.b)]" in plan


def test_engine_keeps_the_index(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/i", dims=8)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": ""})

    def run(full=False, **texts):
        rows = spark.createDataFrame([(f"{k}.py", v, "python") for k, v in texts.items()], "item_path string, content string, language string")
        e.index_source("p", "s", "main", items=rows, full=full)

    def found(name):
        return [r.item_path for r in e.lookup_symbol("p", name).collect()]

    run(a="def one():\n    pass\n", b="def two():\n    pass\n")
    run(a="def one():\n    pass\n", c="def three():\n    pass\n")
    assert (found("one"), found("three")) == (["a.py"], ["c.py"]) and e.symbols.count() == 3
    assert e.gc("p", "s")["orphans"] == 1 and e.symbols.count() == 2 and found("two") == []
    e.symbols.drop_parts(["p/s"])  # an older store has none: lookups scan, and the next run makes it
    assert found("one") == ["a.py"]
    run(a="def one():\n    pass\n", c="def three():\n    pass\n", d="def four():\n    pass\n")
    assert e.symbols.count() == 3 and (found("one"), found("four")) == (["a.py"], ["d.py"])
