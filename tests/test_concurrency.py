"""Trees with odd names, writers that meet, and searches while a version is being made."""

import threading

import pytest

from siltstone.api import Engine
from siltstone.operators.store import Table
from siltstone.sources import files, presets, registry


def tree(tmp_path, *paths):
    for p in paths:
        at = tmp_path / "tree" / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"text of {p}\r\n")
    return f"file://{tmp_path}/tree"


def test_a_tree_loses_no_file(spark, tmp_path, monkeypatch):
    root = tree(tmp_path, "a.py", "pkg/__init__.py", "pkg/_private.py", "_lib/c.py", ".github/w.yml", ".venv/x.py", "node_modules/big.js", "node_modules/deep/n.js", "build/keep/k.py", "build/no.py", "pkg/x.lock", "yarn.lock", "pkg/sp ace%20.py")
    (tmp_path / "tree" / "loop").symlink_to(tmp_path / "tree")
    (tmp_path / "tree" / "node_modules" / "big.js").write_text("x" * 1000)
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 500)
    rules = files.compile_rules(["!.github/", "!build/keep", "pkg/_private.py"])
    want = {"a.py", "pkg/__init__.py", "_lib/c.py", ".github/w.yml", "build/keep/k.py", "pkg/sp ace%20.py"}
    for spread in (files.SPREAD, 1):
        monkeypatch.setattr(files, "SPREAD", spread)
        rows = files.read_tree(spark, root, rules).collect()
        assert {r.item_path for r in rows} - {".github/w.yml"} == want - {".github/w.yml"}
        assert {r.item_path: r.content for r in rows}["pkg/__init__.py"] == "text of pkg/__init__.py\r\n"
        listed = {r.item_path for r in files.list_tree(spark, root, rules).collect()}
        assert "node_modules/big.js" not in listed and ".github/w.yml" in listed
        assert len(files.list_tree(spark, root).collect()) == 13
    with pytest.raises(FileNotFoundError):
        files.read_tree(spark, f"{root}/nowhere")


def test_a_paused_writer_loses_no_commit(spark, tmp_path, monkeypatch):
    """A writer that stops before it publishes finds its number taken, and adds its rows to the other's."""
    a, b = (Table(spark, f"file://{tmp_path}/t") for _ in range(2))

    def rows(i):
        return spark.createDataFrame([(i,)], "v int")

    a.append(rows(1))
    publish, paused = Table._publish, []

    def slow(self, version, manifest):
        if self is a and not paused:
            paused.append(version)
            b.append(rows(3))
        return publish(self, version, manifest)

    monkeypatch.setattr(Table, "_publish", slow)
    a.append(rows(2))
    assert paused == [2] and sorted(r.v for r in a.read().collect()) == [1, 2, 3] and a.versions() == [1, 2, 3]
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]


def test_updates_of_the_registry_meet(spark, tmp_path):
    first, second = (registry.Registry(spark, f"file://{tmp_path}/r") for _ in range(2))
    first.add_project("p")
    for s in "ab":
        first.add_source("p", {"id": s, "type": "code"})
    failed = []

    def update(r, source):
        try:
            for n in range(4):
                r.update_source("p", source, {"last_indexed": n})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=update, args=x) for x in ((first, "a"), (second, "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failed == [] and [s["last_indexed"] for s in first.list_sources("p")] == [3, 3]
    with pytest.raises(KeyError):
        first.update_source("p", "c", {})
    p, q = (presets.Presets(spark, f"file://{tmp_path}/s") for _ in range(2))
    load = p._load
    p._load = lambda: (load(), q.add("y", "custom", "m", dim=3, base_url="u"))[0] if "y" not in q.names() else load()
    p.add("x", "custom", "m", dim=3, base_url="u")
    p.assign("code", "x", [])
    assert set(q._load()["preset"]) == {"x", "y"} and q._load()["slot"] == {"code": {"preset": "x"}}


def test_a_search_during_a_commit(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/i", dims=8, hybrid=False)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": ""})
    one = spark.createDataFrame([("a.md", "alpha beta", "markdown")], "item_path string, content string, language string")
    e.index_source("p", "s", "main", items=one)
    publish, seen = Table._publish, []

    def watched(self, version, manifest):
        if self is e.chunks:
            seen.append(e.search_code("p", "alpha", 1).first().item_path)
        return publish(self, version, manifest)

    monkeypatch.setattr(Table, "_publish", watched)
    e.index_source("p", "s", "dev", items=one.unionByName(spark.createDataFrame([("b.md", "gamma", "markdown")], one.schema)))
    assert seen == ["a.md"]
