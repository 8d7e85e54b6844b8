"""What a run of a source writes on its way: shuffles, folders of its own, and the same index by each path."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone import api
from siltstone.api import Engine
from siltstone.operators import blocks, changes, retrieval
from siltstone.sources import declarations


def engine(spark, path, **options):
    e = Engine(spark, f"file://{path}/index", dims=4, hybrid=False, **options)
    e.registry.add_project("p")
    e.registry.add_source("p", {"id": "s", "type": "code", "root": ""})
    return e


def files(spark, some):
    return spark.createDataFrame([(path, text, "markdown") for path, text in some], "item_path string, content string, language string")


def texts(n, lines, seed=1, words=1):
    rng = random.Random(seed)
    return [(f"f{i}", "\n".join(" ".join(f"{rng.getrandbits(256):x}" for _ in range(words)) for _ in range(lines))) for i in range(n)]


def stages(spark):
    jvm = spark._jvm
    found = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}


def postings(e):
    kept = e.terms.read()
    return sorted(map(tuple, blocks.flat(kept, kept).select("term", "chunk_id", "length", "tf").collect()))


def wanted(e):
    return sorted(map(tuple, retrieval.postings(e.chunks.read())[0].select("term", "chunk_id", "length", "tf").collect()))


def test_texts_and_postings_are_shuffled_once(spark, tmp_path):
    some = texts(40, 400)
    e = engine(spark, tmp_path)
    size = sum(len(t) for _, t in some)
    before = max(stages(spark), default=-1)
    e.index_source("p", "s", "main", items=files(spark, some))
    first = sum(n for k, n in stages(spark).items() if k > before)
    assert first < 5 * size, first / size
    before = max(stages(spark))
    e.index_source("p", "s", "main", items=files(spark, some[4:]))
    assert e.gc()["orphans"] > 0
    later = sum(n for k, n in stages(spark).items() if k > before)
    assert later < size, later / size
    assert postings(e) == wanted(e)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_the_same_index_by_each_path(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(changes, "FEW", few)
    monkeypatch.setattr(blocks, "LOST", few)
    monkeypatch.setattr(api, "TEXT_BYTES", 3000 if few else 1 << 30)
    some = [(p, t + "\nsame words\n" * 200) for p, t in texts(6, 30, words=2)]
    e = engine(spark, tmp_path)
    one = e.index_source("p", "s", "main", items=files(spark, [*some, ("twice", "a b"), ("twice", "a b")]))
    assert one["scanned"] == 8 and e.chunks.count() == e.chunks.read().select("chunk_id").distinct().count() == one["persisted"] == 6 * 3 + 1
    assert len(e.terms.latest()["parts"]["p/s"]) > 1 if few else len(e.terms.latest()["parts"]["p/s"]) == 1
    assert postings(e) == wanted(e)
    two = e.index_source("p", "s", "main", items=files(spark, [(p, t + "!" * (p == "f1")) for p, t in some[1:]]))
    assert (two["reindexed"], two["persisted"]) == (1, 1)
    assert e.index_source("p", "s", "main", items=files(spark, [(p, t + "!" * (p == "f1")) for p, t in some[1:]]))["persisted"] == 0
    assert e.gc()["orphans"] == 3 + 1 + 1 and postings(e) == wanted(e) and e.lengths.count() == e.chunks.count()
    assert e.chunks.read().join(e.tags.read(), "chunk_id", "left_anti").isEmpty()


def test_marks_of_equal_texts():
    assert [c[4] for c in declarations.marked([(9, 9, "", "x"), (1, 2, "", "x"), (3, 3, "", "y"), (1, 2, "", "x")])] == [True, False, False, True]


def test_a_failed_run_leaves_no_texts(spark, tmp_path):
    def refuse(text, dims):
        raise OSError("no model")

    e = engine(spark, tmp_path, encode=refuse)
    with pytest.raises(Exception, match="no model"):
        e.index_source("p", "s", "main", items=files(spark, [("a", "one two")]))
    assert e.made.folders().isEmpty()


def test_hashes_choose_no_row_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(changes.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = spark.createDataFrame([(i, str(i)) for i in range(9)], "chunk_id long, content string")
    gone = rows.filter("chunk_id % 3 = 0")
    assert {r.chunk_id for r in changes.among(rows, gone, "chunk_id").collect()} == {0, 3, 6}
    assert {r.chunk_id for r in changes.not_among(rows, gone, "chunk_id").collect()} == {1, 2, 4, 5, 7, 8}
