"""Code trees, declarations, issues, the versioned store, the registry and the engine's commands."""

import pytest
from pyspark.sql import functions as F

from siltstone.api import Engine
from siltstone.operators.store import Conflict, Table, needs_migration
from siltstone.sources import declarations, files, issues, registry


def matches(spark, lines, paths):
    rules = files.compile_rules(lines)
    rows = spark.createDataFrame([(p,) for p in paths], "item_path string")
    return [r.item_path for r in rows.filter(files.ignored(F.col("item_path"), rules)).collect()]


@pytest.mark.parametrize(
    ("lines", "hit", "free"),
    [
        (["*.log"], ["a.log", "x/y.log"], ["a.logs"]),
        (["/build"], ["build", "build/x"], ["a/build"]),
        (["tmp/"], ["tmp/x", "a/tmp/y"], ["tmp"]),
        (["a/**/z"], ["a/z", "a/b/c/z"], ["b/a/z"]),
        (["docs/**", "!docs/keep.md"], ["docs/x"], ["docs/keep.md"]),
        (["# no", "", r"\#yes"], ["#yes"], ["# no"]),
        (["f[ab].t?"], ["fa.ts", "fb.tx"], ["fc.ts", "fa.t"]),
        (["!a", "a"], ["a"], []),
    ],
)
def test_ignore_rules(spark, lines, hit, free):
    assert sorted(matches(spark, lines, hit + free)) == sorted(hit)


def test_scan(spark):
    paths = ["src/a.ts", ".git/x.py", "node_modules/y.js", "go.sum", "a.png", "Intra.Old.1/z.cs", "vendor/keep.go"]
    rows = spark.createDataFrame([(p,) for p in paths], "item_path string")
    rules = files.compile_rules(["!vendor/keep.go"])
    assert {r.item_path for r in files.scan(rows, rules).collect()} == {"src/a.ts", "vendor/keep.go"}
    assert files.may_hold_forced("vendor", rules) and not files.may_hold_forced("dist", rules)
    assert files.count_rules("# a\n\nb\n  # c\nd") == 2


TS = """import x from "y";
export interface Options { name: string; nested: { a: number } }
export function greet(o: Options): string {
  return `hello ${o.name} }`;
}
export class Engine {
  private n = 1;
  constructor(private c: Options) { this.n = 2; }
  async transform(v: number): Promise<number> {
    if (v > 1) { return v; }
    return 0;
  }
}
type Pair<T> = { a: T };
enum Kind { A, B }
const arrow = () => { return 1; };
"""


@pytest.mark.parametrize(
    ("language", "source", "names"),
    [
        ("typescript", TS, ["Options", "greet", "Engine", "Engine.constructor", "Engine.transform", "Pair", "Kind"]),
        ("python", "import a\nclass A:\n    def f(self):\n        def inner(): pass\n    async def g(self): pass\ndef h(): pass\n", ["A", "A.f", "A.g", "h"]),
        ("go", "package m\ntype T struct {\n a int\n}\nfunc (t T) Run() {\n}\nfunc main() { run() }\n", ["T", "Run", "main"]),
        ("rust", "struct P { a: i32 }\nimpl P {\n pub fn new() -> P { P { a: 1 } }\n}\nenum E { A }\ntrait Tr { fn x(); }\nfn main() {}\n", ["P", "P", "P.new", "E", "Tr", "main"]),
        ("java", "public class A {\n private int x;\n public A() { x = 1; }\n public int get(int a) { return a; }\n}\nenum E { X }\n", ["A", "A.A", "A.get", "E"]),
        ("ruby", "module M\n class C\n  def a\n   if x\n   end\n  end\n  def self.b\n  end\n end\nend\n", ["M", "M.C", "M.C.a", "M.C.self.b"]),
        ("c", "#include <x.h>\nstatic int add(int a, int b) {\n return a + b;\n}\nint main(void) { return add(1, 2); }\n", ["add", "main"]),
        ("json", "{}", []),
    ],
)
def test_declarations(language, source, names):
    assert [d.name for d in declarations.declarations(source, language)] == names


def test_chunk_source_fallback_vue_and_long():
    assert [(s, e, n) for s, e, n, _ in declarations.chunk_source("const a = 1;\n" * 55, "typescript")] == [(1, 55, ""), (51, 55, "")]
    vue = "<template>\n</template>\n<script>\nfunction a() {\n}\n</script>\n"
    assert [(s, e, n) for s, e, n, _ in declarations.chunk_source(vue, "vue")] == [(4, 5, "a")]
    long = "def f():\n" + "    x = 1\n" * 80
    got = [(s, e, n) for s, e, n, _ in declarations.chunk_source(long, "python")]
    assert got == [(1, 60, "f"), (51, 81, "")]


def test_issue_items(spark):
    gitlab = spark.createDataFrame(
        [(1, "T", " body\r\n", ("ann",), "2024-01-01T00:00:00Z", "u", "opened", ["x"], ("m", None), [("bob",)], True), (2, "S", None, ("eve",), "2024-01-02T00:00:00Z", "v", "closed", [], None, [], False)],
        "iid int, title string, description string, author struct<username string>, updated_at string, web_url string, state string, labels array<string>, milestone struct<title string, due_date string>, assignees array<struct<username string>>, confidential boolean",
    )
    notes = spark.createDataFrame([("issues/1", "7", "hi", "dan", None, False), ("issues/1", "8", "sys", "x", None, True), ("issues/1", "9", "  ", "x", None, False)], issues.NOTE)
    rows = {r.item_path: r for r in issues.items(issues.from_gitlab(gitlab), notes).collect()}
    assert set(rows) == {"issues/1", "issues/2", "issues/1#note_7"}
    a = rows["issues/1"]
    assert (a.content, a.state, a.labels, a.milestone, a.confidential) == ("# T\n\nbody", "open", '["x"]', '{"title":"m","due_date":null}', "true")
    note = rows["issues/1#note_7"]
    assert (note.author, note.timestamp, note.labels, note.item_url) == ("dan", "2024-01-01T00:00:00Z", '["x"]', "u#note_7")
    assert rows["issues/2"].content == "# S" and rows["issues/2"].milestone == ""
    assert issues.since(issues.from_gitlab(gitlab), "2024-01-02T00:00:30Z").count() == 1
    bad = spark.createDataFrame([("", "nope", "[]", "[1", "false")], "state string, labels string, assignees string, milestone string, confidential string")
    got = issues.parse_metadata(bad).first()
    assert (got.state, got.labels, got.assignees, got.milestone, got.confidential) == (None, [], [], None, False)


def test_github_rows(spark):
    schema = "number int, title string, body string, user struct<login string>, state string, updated_at string, html_url string, labels array<struct<name string>>, milestone struct<title string>, assignees array<struct<login string>>, pull_request string"
    raw = spark.createDataFrame([(1, "a", "b", None, "open", "t", "u", [("l",)], None, [], None), (2, "pr", "", ("x",), "open", "t", "u", [], None, [], "yes")], schema)
    got = issues.from_github(raw).collect()
    assert [(r.key, r.author, r.labels, r.confidential) for r in got] == [("issues/1", "unknown", ["l"], False)]


def test_store(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    assert table.read() is None and table.count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    table.upsert(rows)
    table.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int"))
    assert {r.chunk_id: r.v for r in table.read().collect()} == {"a": 1, "b": 3, "c": 4}
    assert {r.chunk_id for r in table.read(1).collect()} == {"a", "b"}
    table.delete(F.col("v") > 3)
    table.delete_ids(spark.createDataFrame([("a",)], "chunk_id string"))
    assert [r.chunk_id for r in table.read().collect()] == ["b"]
    done = table.compact(purge=True)
    assert done["versionsPruned"] == 3 and done["hadRealWork"] and table.versions() == [4]
    assert table.repair() == 4
    table.recreate(rows.schema, chunk_id_scheme=2)
    assert table.count() == 0
    assert not needs_migration(table.meta()) and needs_migration({}) and needs_migration({"chunk_id_scheme": "1"})


def test_a_failed_write_harms_nothing(spark, tmp_path):
    """A job that dies leaves a folder that no version names; writes, upserts and deletes go on; the folder goes later."""
    table = Table(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    table.write(rows, "p/s")
    broken = rows.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    for write in (lambda: table.write(broken, "p/s"), lambda: table.upsert(broken, part="p/s"), lambda: table.append(broken, "p/s")):
        with pytest.raises(Exception, match="lost"):
            write()
    (tmp_path / "t" / "v=2.json").write_text('{"cut sho')
    assert table.versions() == [1] and table.count() == 2
    assert table.upsert(spark.createDataFrame([("b", 5), ("c", 6)], "chunk_id string, v int"), part="p/s") == 3
    table.delete(F.col("v") == 6)
    assert {r.chunk_id: r.v for r in table.read().collect()} == {"a": 1, "b": 5}
    assert table.prune_orphans()["folders"] == 0 and table.prune_orphans(older_than=-60)["folders"] >= 3
    assert table.count() == 2


def test_writers_that_meet(spark, tmp_path):
    """Another writer makes a version in the middle of one: other parts are kept, the same part is made anew, and there is an end to it."""
    table, other = (Table(spark, f"file://{tmp_path}/t") for _ in range(2))

    def rows(*ids):
        return spark.createDataFrame([(i, 0) for i in ids], "chunk_id string, v int")

    table.write(rows("a"), "p/x")
    table.write(rows("b"), "p/y")
    calls = []

    def meddling(part):
        def change(current):
            calls.append(part)
            if len(calls) < 3:
                other.append(rows(f"new{len(calls)}"), part)
            return current.filter("chunk_id <> 'a'")

        return change

    table.rewrite(meddling("p/y"), "p/x")
    assert calls == ["p/y"] and {r.chunk_id for r in table.read().collect()} == {"b", "new1"}
    table.rewrite(meddling("p/x"), "p/x")
    assert calls == ["p/y", "p/x", "p/x"] and {r.chunk_id for r in table.read(parts=["p/x"]).collect()} == {"new2"}

    def always(current):
        other.append(rows("z"), "p/x")
        return current

    with pytest.raises(Conflict):
        table.rewrite(always, "p/x")
    before = table.latest()["parts"]["p/y"]
    table.upsert(rows("q"), part="p/x")
    assert table.latest()["parts"]["p/y"] == before and table.drop_parts(["p/y"]) and table.parts() == ["p/x"]


def test_registry_errors(spark, tmp_path, monkeypatch):
    r = registry.Registry(spark, f"file://{tmp_path}/r")
    r.add_project("p", "first")
    with pytest.raises(ValueError):
        r.add_project("p")
    with pytest.raises(KeyError):
        r.add_source("p", {"id": "s", "type": "nope"})
    r.add_source("p", {"id": "s", "type": "code", "root": "/x"})
    assert [s["id"] for s in r.list_sources("p", "code")] == ["s"] and not r.list_sources("p", "text")
    r.remove_source("p", "s")
    r.remove_project("p")
    assert r.list_projects() == []
    monkeypatch.setenv("A_TOKEN", "v")
    assert registry.resolve_env("x${A_TOKEN}") == "xv"
    with pytest.raises(KeyError, match="NOT_THERE"):
        registry.resolve_env("${NOT_THERE}")


def test_engine_round_trip(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "src" / "a.ts").write_text(TS)
    (tree / "src" / "b.py").write_text("def zebra_sentinel():\n    return 1\n")
    (tree / "node_modules").mkdir()
    (tree / "node_modules" / "c.ts").write_text("function no() {}")
    e = Engine(spark, f"file://{tmp_path}/index", dims=32)
    e.registry.add_project("p")
    with pytest.raises(LookupError, match="NO_CODE_SOURCES"):
        e.search_code("p", "x")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": f"file://{tree}"})
    first = e.index_source("p", "s", "main")
    assert first["reindexed"] == 2 and first["prepared"] == 8 == first["persisted"]
    again = e.index_source("p", "s", "main")
    assert again == {"scanned": 2, "reindexed": 0, "removed": 0, "prepared": 0, "persisted": 0}
    hit = e.search_code("p", "zebra_sentinel", 3).collect()
    assert hit[0].symbol_name == "zebra_sentinel" and hit[0].branches == ["main"]
    (tree / "src" / "b.py").unlink()
    (tree / "src" / "a.ts").write_text(TS.replace("hello", "bye"))
    third = e.index_source("p", "s", "main")
    assert (third["removed"], third["reindexed"], third["persisted"]) == (1, 1, 1)
    assert e.gc(dry_run=True) == {"orphans": 2}
    assert e.gc()["orphans"] == 2 and e.chunks.count() == 7
    assert [r.symbol_name for r in e.lookup_symbol("p", "transform").collect()] == ["Engine.transform"]
    items = spark.createDataFrame([("src/n.py", "def fresh():\n    pass\n", "python")], "item_path string, content string, language string")
    assert e.index_ephemeral("p", "s", "refs/heads/pr/7", items)["label"] == "_ephemeral/7"
    assert e.list_branches("p", "s") == ["_ephemeral/7", "main"]
    assert e.search_code("p", "fresh", 2, branch="_ephemeral/7").count() == 1
    with pytest.raises(ValueError):
        e.drop_ephemeral("p", "s", "main")
    assert e.drop_ephemeral("p", "s", "_ephemeral/7")["orphans"] == 1
    assert e.pin_branches("p", "s", ["main", "dev", "main"])["branches"] == ["main", "dev"]
    assert e.unpin_branches("p", "s", ["main"]) == {"branches": ["dev"], "removed": ["main"]}
    e.remove_source("p", "s")
    assert e.chunks.count() == 0


def test_engine_knowledge(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", dims=32)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "t", "type": "ticket", "issues": "", "notes": ""})
    talk = spark.createDataFrame([(2, 0, "user", "printer on fire"), (2, 1, "assistant", "unplug it"), (3, 0, "user", "coffee")], "conv_id long, turn long, role string, text string")
    items = issues.items(*issues.from_conversations(talk))
    assert e.index_source("p", "t", items=items)["persisted"] == 3
    hit = e.search_knowledge("p", "unplug", 2).first()
    assert hit.item_path == "issues/2#note_1" and hit.labels == ["l0", "l1"]
    assert {r.item_type for r in e.search_knowledge("p", "printer unplug", 5, item_types=["issue"]).collect()} == {"issue"}
    edited = items.filter("item_path = 'issues/2'").withColumn("content", F.lit("now solved"))
    e.index_source("p", "t", items=edited)
    assert e.knowledge.read().filter("item_path like 'issues/2%'").count() == 1
    with pytest.raises(LookupError):
        e.search_knowledge("p", "x", source="nope")
