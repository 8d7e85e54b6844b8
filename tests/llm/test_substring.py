import hashlib
import random
import re
from collections import defaultdict

import pytest

from siltstone.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for s in range(len(w) - 12):
            if i is not None:
                k = tuple(w[s : s + 13])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - 12):
            if i is not None and first[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [2, 4, 3000])
def test_against_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    pool = [[f"w{rng.randrange(vocabulary)}\u00a0" for _ in range(rng.choice([12, 13, 14, 30, 60]))] for _ in range(12)]
    docs = []
    for i in range(90):
        body = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(pool) if rng.random() < 0.6 else [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 40))]
            body += part[rng.randint(0, 3) : len(part) - rng.randint(0, 3)]
        docs.append((i * 7 % 1000, rng.choice([" ", "\n", " \t "]).join(body)))
    docs += [(2001, docs[3][1]), (2002, docs[3][1]), (2003, None), (2004, ""), (2005, "\x0b\x1c x \x85")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as starts", "2 as k1", "3 as h")
    got = sorted((tuple(r) for r in substring.digests(substring.strip_repeats(frame)).collect()), key=str)
    assert got == brute(docs)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sorted((tuple(r) for r in substring.digests(substring.strip_repeats(edge_docs)).collect()), key=str)
    assert got == brute(rows)
    assert substring.strip_repeats(no_docs).count() == 0


def test_doubling_goes_on_until_nothing_survives(spark):
    rng = random.Random(11)
    shared = [f"s{rng.randrange(40)}" for _ in range(120)]
    docs = [(i, " ".join([f"a{i}"] * rng.randint(0, 4) + shared[: rng.choice([0, 14, 27, 60, 110])] + [f"b{i}x{k}" for k in range(20)])) for i in range(12)]
    words = [(i, tuple(t.split())) for i, t in docs]
    want = {}
    for length in (13, 26, 52, 104):
        owners = defaultdict(set)
        for i, w in words:
            for s in range(len(w) - length + 1):
                owners[w[s : s + length]].add(w)
        for i, w in words:
            for s in range(len(w) - length + 1):
                if len(owners[w[s : s + length]]) > 1:
                    want[i, s] = length
    got = {(r.doc_id, r.start): r.length for r in substring.longest_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert max(got.values()) == 104 and got == want


def test_long_repeats_write_no_more_tables_than_short_ones(spark, monkeypatch):
    """All lengths are asked in one exchange: tables and shuffles do not grow with the longest repeat."""
    written = []
    write = substring.materialise
    monkeypatch.setattr(substring, "materialise", lambda df, name: written.append(name) or write(df, name))
    counts = []
    for n in (14, 300):
        shared = " ".join(f"s{k}" for k in range(n))
        written.clear()
        got = substring.longest_repeats(spark.createDataFrame([(1, shared), (2, shared + " x")], "doc_id long, text string")).collect()
        counts.append((len(written), max(r.length for r in got)))
    assert counts[0][0] == counts[1][0] and (counts[0][1], counts[1][1]) == (13, 208)


def test_halves_of_two_texts_of_one_id_make_no_window(spark):
    p, q, x = ([f"{c}{k}" for k in range(13)] for c in "pqx")
    docs = [(1, " ".join(p + x)), (1, " ".join(x[::-1] + q)), (2, " ".join(p + q))]
    got = {(r.doc_id, r.start): r.length for r in substring.longest_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 0): 13, (1, 13): 13, (2, 0): 13, (2, 13): 13}
