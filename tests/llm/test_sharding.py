import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import sharding


def check_law(rows, want, shards=16):
    """Every row once; counts at most one apart; slots gapless in each shard; size and checksum of the text."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want)
    assert {r.law for r in rows} <= {"rows"} and {r.grown_shard for r in rows} <= {None}
    held = Counter(r.shard for r in rows)
    assert set(held) <= set(range(shards)) and max(held.values(), default=0) - min((held[s] for s in range(shards)), default=0) <= 1
    for s in held:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(held[s]))


@pytest.mark.parametrize(("n", "parts"), [(1, 1), (15, 3), (16, 2), (1000, 7), (5003, 40)])
def test_exact_sizes(spark, n, parts):
    want = [(i, "é" * (i % 7)) for i in range(n)]
    check_law(sharding.shuffle(spark.createDataFrame(want, "doc_id long, text string").repartition(parts)).collect(), want)


def test_all_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    want = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_law(sharding.shuffle(docs).collect(), want)
    first, again = (sorted(map(tuple, sharding.shuffle(docs).collect())) for _ in range(2))
    assert first == again
    assert first != sorted(map(tuple, sharding.shuffle(docs, seed=99).collect()))


def test_edges(spark, edge_docs, no_docs):
    want = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check_law(sharding.shuffle(edge_docs.withColumnRenamed("rep", "source2").selectExpr("*", "1 as pos", "2 as target", "3 as size", "4 as shard")).collect(), want)
    assert sharding.shuffle(no_docs).count() == 0


def test_matrix_keeps_both_margins():
    sizes = sharding.target_sizes(10_007, 16, 4)
    assert sizes.sum() == 10_007 and np.ptp(sizes.reshape(16, 4).sum(axis=1)) <= 1
    sources = [0, 5000, 7, 5000]
    m = sharding.communication_matrix(sources, sizes, 3)
    assert (m >= 0).all() and m.sum(axis=1).tolist() == sources and m.sum(axis=0).tolist() == sizes.tolist()


def test_matrix_is_hypergeometric(monkeypatch):
    """Counts of many draws against the exact law, by numpy's sampler and by the one for larger populations."""
    from math import comb

    law = [comb(6, k) * comb(14, 8 - k) / comb(20, 8) for k in range(7)]
    for limit in (sharding._NUMPY_LIMIT, 0):
        monkeypatch.setattr(sharding, "_NUMPY_LIMIT", limit)
        seen = Counter(int(sharding.communication_matrix([8, 12], np.array([6, 14]), s)[0, 0]) for s in range(6000))
        chi = sum((seen[k] - 6000 * p) ** 2 / (6000 * p) for k, p in enumerate(law) if 6000 * p > 5)
        assert chi < 25  # 6 degrees of freedom: 22.5 is passed once in a thousand


def test_large_populations_have_the_right_mean_and_spread():
    rng = np.random.default_rng(1)
    good, bad, drawn = 40_000_000_000, 60_000_000_000, 30_000_000_000
    x = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(400)], dtype=float)
    mean, spread = drawn * 0.4, (drawn * 0.4 * 0.6 * 0.7) ** 0.5
    assert abs(x.mean() - mean) < 5 * spread / 20 and 0.8 < x.std() / spread < 1.2


def test_uniform(spark):
    """Over seeds, each row stands in each shard and in each half of its slots alike, wherever it came from."""
    docs = spark.createDataFrame([(i, "") for i in range(64)], "doc_id long, text string").repartition(5)
    together, low = Counter(), Counter()
    for seed in range(30):
        for r in sharding.shuffle(docs, 4, seed).collect():
            together[r.doc_id // 16, r.shard] += 1
            low[r.doc_id // 16] += r.slot < 8
    assert all(abs(v - 120) < 45 for v in together.values()) and all(abs(v - 240) < 60 for v in low.values())
