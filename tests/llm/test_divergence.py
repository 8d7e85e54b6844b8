import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    by, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t.translate(LOWER) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        by[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted(t for t, k in docs[lang].items() if k >= 30)
        total = Counter()
        for (x, _), c in by.items():
            if x == lang:
                total.update(c)

        def shares(c):
            n = sum(c[t] for t in kept) + 5 * len(kept)
            return [1 + 10**9 * (c[t] + 5) // n for t in kept]

        whole = shares(total)
        groups = {s: shares(c) for (x, s), c in by.items() if x == lang}
        for s, p in groups.items():
            pair = sorted((-sum(abs(a - b) for a, b in zip(p, q, strict=True)), o.encode(), o) for o, q in groups.items() if o != s)
            term = sorted((b - a, t.encode(), t) for a, b, t in zip(p, whole, kept, strict=True) if a > b and by[lang, s][t])
            out += [(lang, s, part, item, -v, k + 1) for part, ranked in (("pair", pair), ("term", term[:50])) for k, (v, _, item) in enumerate(ranked)]
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(140)] + ["Été", "日本", "🙂", "x y", "Ä"]
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", "_RARE9", " unique%s" % chr(97 + n % 26)]), rng.choice(["en", "de", None]), rng.choice([None, *(f"s{k}" for k in range(9))])) for n in range(n)]


@pytest.mark.parametrize(("chunk", "block"), [(divergence.CHUNK, divergence.BLOCK), (7, 2), (1, 1)])
def test_against_brute_force(spark, chunk, block):
    rows = made(chunk, 500) + [("few words", "fr", "a"), (None, "fr", "b"), ("", "fr", "é")]
    want = brute(rows)
    assert any(r[2] == "term" and r[5] == 50 for r in want) and any(r[4] == 0 for r in want)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    assert result(divergence.audit(docs, chunk, block)) == want


def test_ties_are_ranked_by_bytes(spark):
    rows = [(t, "en", s) for s in ("a", "b", "￮", "🙂") for t in ["zz 🙂 ￮ aa"] * 30]
    assert result(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), 2, 1)) == brute(rows)


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.choice([0, 3, 10**6, 10**12, 8 * 10**15])
        counts = [rng.randint(0, total) for _ in range(5)] + [total]
        got = divergence.shares(np.array(counts), total, 1)
        assert got.tolist() == [1 + 10**9 * (c + 5) // (total + 5) for c in counts]


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in edge_docs.collect()] * 30
    many = edge_docs
    for _ in range(29):
        many = many.unionByName(edge_docs)
    assert result(divergence.audit(many.selectExpr("*", "1 as term", "2 as n", "3 as docs", "4 as chunk", "5 as total"))) == brute(rows)
    assert divergence.audit(no_docs).count() == 0
    assert divergence.audit(edge_docs.limit(1)).count() == 0
