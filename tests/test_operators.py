"""Operators on small literals, by the behaviour that they must have."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import embedding
from siltstone.functions import text as T
from siltstone.functions.vectors import cosine
from siltstone.operators import branches, changes, chunking, lookup, maintenance, ranking, retrieval, temporal
from siltstone.sources import declarations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_trim(spark):
    assert one(spark, T.normalize_content(F.lit("\ufeffa\r\nb\rc\n"))) == "a\nb\nc\n"
    assert one(spark, T.trim_blank(F.lit("\u00a0\ufeff\t a b \n\u3000"))) == "a b"
    assert one(spark, T.normalize_content(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("path", "language"), [("a/b.ts", "typescript"), ("x.min.js", None), ("Form.Designer.cs", None), ("A.PY", "python"), ("Makefile", None), ("a.b/c", None), ("q.vue", "vue"), (".py", None)])
def test_language(spark, path, language):
    assert one(spark, T.language_of(F.lit(path))) == language


def test_ephemeral_ticket_semver(spark):
    assert one(spark, T.ephemeral_label(F.lit("refs/heads/a/b"))) == "_ephemeral/b"
    assert one(spark, T.ephemeral_label(F.lit("_ephemeral/x"))) == "_ephemeral/x"
    assert one(spark, T.ticket_path(F.lit("tickets/7"), F.lit("u#note_9"))) == "issues/7#note_9"
    assert one(spark, T.ticket_path(F.lit("src/a"), F.lit(""))) == "src/a"
    versions = ["1.10.0", "1.2.0", "2.0.0-rc1", "v2.0.0"]
    rows = spark.createDataFrame([(v,) for v in versions], "v string").orderBy(T.semver_key(F.col("v"))).collect()
    assert [r.v for r in rows] == ["1.2.0", "1.10.0", "2.0.0-rc1", "v2.0.0"]


def brute_windows(lines, size, overlap, cap):
    out = []
    for at in range(0, len(lines), size - overlap):
        part = lines[at : at + size]
        if cap is not None:
            used = chars = 0
            for line in part:
                if used and chars + len(line) > cap:
                    break
                used, chars = used + 1, chars + len(line)
            part = part[:used]
        text = "".join(part)[:cap].strip()
        if text:
            out.append((at + 1, at + len(part), text))
    return out


@pytest.mark.parametrize("cap", [None, 20])
def test_window_chunks(spark, cap):
    rng = random.Random(4)
    texts = ["", "\n\n", "one", "a\nb\n", "x" * 50 + "\ny\n", *("".join(rng.choice(["ab\n", "\n", "cdef\n", "g" * 30 + "\n", "h"]) for _ in range(rng.randint(0, 40))) for _ in range(20))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = {}
    for r in chunking.window_chunks(rows, size=6, overlap=2, max_chars=cap).collect():
        got.setdefault(r.i, []).append((r.start_line, r.end_line, r.chunk))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_windows(t.splitlines(keepends=True), 6, 2, cap), t


def test_windows_of_the_worker_equal_those_of_the_engine(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "\n", " ", "\u00a0", "\u2028", "\x0b", "b\n", "word\n" * 30]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    files = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    for cap in (None, 90):
        got = sorted((r.k, r.start_line, r.end_line, r.chunk) for r in chunking.window_chunks(files, max_chars=cap).collect())
        assert got == sorted((k, s, e, t) for k, text in enumerate(texts) for s, e, t in declarations.windows(declarations.lines_of(text), 0, cap))


def test_windows_have_no_early_stop(spark):
    rows = spark.createDataFrame([("\n".join(f"l{i}" for i in range(55)),)], "content string")
    assert sorted((r.start_line, r.end_line) for r in chunking.window_chunks(rows).collect()) == [(1, 55), (51, 55)]
    with pytest.raises(ValueError):
        chunking.window_chunks(rows, size=5, overlap=5)


def test_chunk_id_ignores_lines_but_not_path(spark):
    ids = [one(spark, T.chunk_id(*map(F.lit, ("p", "s", path, "", "code", "x")))) for path in ("a", "a", "b")]
    assert ids[0] == ids[1] != ids[2]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "1"), ("d", "1")], "path string, hash string")
    full = {r.path: r.change for r in changes.snapshot_diff(old, new).collect()}
    assert full == {"a": "removed", "b": "changed", "c": "same", "d": "added"}
    kept = changes.merged_snapshot(changes.snapshot_diff(old, new, keep_missing=True))
    assert {r.path: r.hash for r in kept.collect()} == {"a": "1", "b": "2", "c": "1", "d": "1"}


def test_resolve_and_annotate(spark):
    tags = spark.createDataFrame([("p", "s", b, "f", "c1") for b in ("zeta", "main", "alpha", "master", "origin/dev")], "project_id string, source_id string, branch string, item_path string, chunk_id string")
    names = spark.createDataFrame([("main",), ("dev",), ("origin/zeta",), ("none",)], "name string")
    assert {r.name: r.resolved for r in branches.resolve(names, tags).collect()} == {"main": "main", "dev": "origin/dev", "origin/zeta": "zeta", "none": None}
    rows = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    assert {r.chunk_id: r.branches for r in branches.annotate(rows, tags).collect()} == {"c1": ["master", "main", "alpha", "origin/dev", "zeta"], "c2": []}


def test_gc_never_removes_a_shared_chunk(spark):
    tags = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a")], "chunk_id string, branch string")
    chunks = spark.createDataFrame([("c1", "s"), ("c2", "s"), ("c3", "s")], "chunk_id string, source_id string")
    left = maintenance.collect_garbage(chunks, branches.without_branch(tags, "a"))
    assert [r.chunk_id for r in left.collect()] == ["c1"]


def test_cosine_of_identical_orthogonal_and_zero(spark):
    rows = spark.createDataFrame([("same", [1.0, 0.0]), ("ortho", [0.0, 1.0]), ("zero", [0.0, 0.0])], "chunk_id string, vector array<float>")
    got = {r.chunk_id: r.s for r in rows.select("chunk_id", cosine(F.col("vector"), F.array(F.lit(2.0), F.lit(0.0))).alias("s")).collect()}
    assert got == {"same": 1.0, "ortho": 0.0, "zero": 0.0}


def test_blocked_search_is_exact_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DATA_BLOCK", 17)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500 + i, [1.0] * 8) for i in range(30)]
    vectors = spark.createDataFrame(data, "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in data[:7]] + [(99, [1.0] * 8)], "query_id long, vector array<float>")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.search(vectors, queries, 5, 8).collect()}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 6)

    for q, v in [*data[:7], (99, [1.0] * 8)]:
        want = sorted(data, key=lambda d: (-cos(v, d[1]), d[0]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [w[0] for w in want]


def test_approximate_search_recall(spark):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(2000)], "chunk_id long, vector array<float>")
    queries = vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = retrieval.search(vectors, queries, 10, 16)
    recall = ranking.recall_of(retrieval.search_approximate(vectors, queries, 10, 16), exact).first()["recall"]
    assert recall >= 0.9


def test_reciprocal_rank_counts_repeats_and_keeps_first_seen(spark):
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "b"), (1, 1, "c")], "list_no int, rank int, key string")
    got = ranking.reciprocal_rank(lists, ["key"]).orderBy("rank").collect()
    assert [r.key for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 63)


@pytest.mark.parametrize(("n", "scores"), [(1, [0.3]), (4, [0.1, 0.9, 0.5, None]), (14, [0.5] * 14)])
def test_blend(spark, n, scores):
    rows = spark.createDataFrame([(0, f"c{i}", i + 1, s) for i, s in enumerate(scores)], "g int, chunk_id string, rank int, rerank double")
    s = [x or 0.0 for x in scores]
    want = []
    for i, x in enumerate(s):
        place = 1.0 if n == 1 else 1 - i / (n - 1)
        scaled = 1.0 if max(s) - min(s) < 1e-10 else (x - min(s)) / (max(s) - min(s))
        t = min(1.0, max(0.0, (i + 1 - 3) / 8))
        want.append((round((0.75 - 0.35 * t) * place + (0.25 + 0.35 * t) * scaled, 9), -i))
    order = [f"c{-i}" for _, i in sorted(want, reverse=True)]
    got = ranking.blend(rows, 10, ["g"]).orderBy("new_rank").collect()
    assert [r.chunk_id for r in got] == order[:10]


def test_lookup(spark):
    columns = "chunk_id string, symbol_name string, language string, item_path string, start_line int"
    chunks = spark.createDataFrame([("1", "A.run", "ts", "b", 3), ("2", "run", "ts", "a", 1), ("3", "A.r_n", "ts", "a", 9), ("4", "", "ts", "a", 2), ("5", "B.RUN", "go", "z", 1)], columns)
    tags = spark.createDataFrame([("1", "main"), ("5", "dev")], "chunk_id string, branch string")

    def ids(*a, **k):
        return [r.chunk_id for r in lookup.lookup_symbol(chunks, tags, *a, **k).collect()]

    assert ids("run") == ["2", "1"]
    assert ids("r_n") == ["3", "1"]  # an underscore is a wildcard in a suffix
    assert ids("r_n", literal=True) == ["3"]
    assert ids("run", case_sensitive=False) == ["5", "2", "1"]
    assert ids("run", branch="main") == ["1"]
    for bad in (dict(name=" "), dict(name="x", limit=201), dict(name="x", match="prefix")):
        with pytest.raises(ValueError):
            lookup.lookup_symbol(chunks, tags, **bad)


def test_nearest_sample_ties_and_reach(spark):
    samples = spark.createDataFrame([(i, float(t)) for i, t in enumerate((0, 60, 120, 180, 240, 1000))], "sample int, ts_s double")
    crashes = spark.createDataFrame([("A", 125.0), ("B", 500.0), ("C", 198.0), ("D", 90.0)], "crash string, at double")
    got = {r.crash: r.sample for r in temporal.nearest(crashes, samples, 120.0, "crash").collect()}
    assert got == {"A": 2, "B": None, "C": 3, "D": 1}
    spans = spark.createDataFrame([(1, 90.0, 160.0), (2, 200.0, 202.0)], "span_id int, start_s double, end_s double")
    near = {(r.crash, r.span_id) for r in temporal.near_spans(crashes, spans, 3.0, "crash").collect()}
    assert near == {("A", 1), ("C", 2), ("D", 1)}


def test_batches_are_filled_across_lists():
    rng = random.Random(4)
    texts = sorted(("x" * rng.randint(0, 900) for _ in range(400)), key=len)
    lists = [texts[i : i + 7] for i in range(0, len(texts), 7)] + [[]]

    def padded(run):
        """(vectors, calls, padded slots) of a run."""
        calls = []
        call = lambda some: calls.append(some) or [[float(len(t))] for t in some]
        vectors = run(call)
        slots = [len(c) * max(min(512, len(t) // 4 + 2) for t in c) for c in calls]
        assert max(slots) <= embedding.SLOTS
        return vectors, len(calls), sum(slots)

    whole, n_calls, slots = padded(lambda call: list(embedding.encode_stream(iter(lists), call, 1)))
    apart, more_calls, _ = padded(lambda call: [embedding.encode_all(t, call, 1) for t in lists])
    assert whole == apart == [[[float(len(t))] for t in some] for some in lists]
    assert n_calls < more_calls / 2
    # Texts as they come, in no order, take more padding; their vectors are the same and none waits without bound.
    rng.shuffle(texts)
    mixed = [texts[i : i + 7] for i in range(0, len(texts), 7)]
    got, _, loose = padded(lambda call: list(embedding.encode_stream(iter(mixed), call, 1)))
    assert got == [[[float(len(t))] for t in some] for some in mixed] and slots < loose


def test_vectors_do_not_depend_on_arrow_batches(spark):
    rows = spark.createDataFrame([(i, "word " * (i * 37 % 91)) for i in range(300)] + [(300, None)], "id long, body string").repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for n in ("10000", "5"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        found.append(sorted((r.id, tuple(r.vector)) for r in embedding.embed(rows, "body", 8).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and len(found[0]) == 301


def test_plan_batches_and_caps():
    lengths = [500, 3, 10, 510, 600, 1]
    plan = embedding.plan_batches(lengths)
    assert sorted(i for b in plan for i in b) == list(range(6))
    assert all(len(b) == 1 or len(b) * max(min(512, lengths[i] + 2) for i in b) <= embedding.SLOTS for b in plan)
    assert embedding.cap_text("a b c d", 2) == "a b "
    calls = []

    def call(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise ValueError
        return texts

    assert embedding.adaptive(call, list("abcde")) == list("abcde")
    assert max(calls[1:]) < 5


def test_empty_inputs(spark):
    files = spark.createDataFrame([], "content string")
    assert chunking.window_chunks(files).count() == 0
    vectors = spark.createDataFrame([], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([], "query_id long, vector array<float>")
    assert retrieval.search(vectors, queries, 3, 4).count() == 0
    rows = spark.createDataFrame([], "chunk_id long, content string")
    assert retrieval.bm25(rows, spark.createDataFrame([(1, "a")], "query_id long, query string"), 3).count() == 0


def test_bm25_by_brute_force(spark, monkeypatch):
    """Batches, query blocks, ties, words of other scripts, and the kept postings, against plain sums."""
    rng = random.Random(8)
    words = ["the", "über", "поиск", "код", "café", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 65])]) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "поиск по коду"), (902, "w1 w2"), (903, "W1, w2!")]
    queries = [(1, "Поиск"), (2, "the über the"), (3, "w1 w2 w3"), (4, "nothing here"), (5, None), (6, "café")]
    split = [(i, [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]) for i, t in docs]
    mean = sum(len(w) for _, w in split) / len(split)
    want = {}
    for q, t in queries:
        terms = {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}
        score = {}
        for term in terms:
            df = sum(term in w for _, w in split)
            for i, w in split:
                tf = w.count(term)
                if tf:
                    score[i] = score.get(i, 0) + math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        for rank, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7], 1):
            want[q, rank] = (i, round(s, 6))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rows = spark.createDataFrame(docs, "chunk_id long, content string").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in retrieval.bm25(rows, asked, 7).collect()}
    assert got == want
    kept = {(r.query_id, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in retrieval.bm25_kept(*retrieval.postings(rows), asked, 7).collect()}
    assert kept == want
    assert retrieval.bm25(rows.limit(0), asked, 3).count() == 0 and retrieval.bm25(rows, asked.limit(0), 3).count() == 0


def test_all_pairs_in_parts_and_packed(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PACKED", 7)
    monkeypatch.setattr(retrieval, "PAIRS", 20)
    rows = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5), 0.0 if i % 35 == 3 else i % 3 - 1.0]) for i in range(60)], "chunk_id long, vector array<float>")
    asked = rows.filter("chunk_id % 4 = 0").selectExpr("chunk_id as query_id", "vector")
    got = retrieval.similarities(rows, asked, 3)
    q = asked.withColumnRenamed("vector", "q")
    want = rows.join(q).select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("vector")), 6).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "zip_with" not in got._jdf.queryExecution().executedPlan().toString()  # no walk over the components of every pair
