import random
import re
from collections import defaultdict

from siltstone.llm import exact


def test_fingerprints_compose():
    rng = random.Random(1)
    for size in (0, 1, 4095, 4096, 4097, 3 << 20):
        a, b = rng.randbytes(size), rng.randbytes(rng.randint(0, 9000))
        assert exact.combine(exact.fingerprint(a), exact.fingerprint(b)) == exact.fingerprint(a + b)
    naive = 0
    for byte in b"some text":
        naive = (naive * exact.MODULI[0][1] + byte) % exact.MODULI[0][0]
    assert exact.fingerprint(b"some text")[0] == naive


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_against_brute_force(spark, edge_docs, no_docs):
    assert result(exact.dedup(edge_docs)) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert exact.dedup(no_docs).count() == 0


def test_two_texts_of_one_fingerprint_stay_apart(spark):
    rows = [(i, "ab"[i % 2] * 3 + ("\u00a0" if i % 5 == 0 else " ") + "x" * (70_000 if i % 3 == 0 else 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(exact.dedup(docs, hashed=lambda raw: (1, 2, 3))) == brute(rows)


def test_keep_first_keeps_columns(spark, edge_docs):
    kept = exact.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 5, 5, 7]
