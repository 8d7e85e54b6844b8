import hashlib
import itertools
import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from siltstone.llm import contamination, exact


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def edits(a, b):
    """Edit distance, a row of the table at a time."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return row[-1]


def one_of_each(texts):
    """Least ids of the components of all pairs of word edit similarity 0.8 or more, every pair looked at."""
    number = {}
    w = {i: np.array([number.setdefault(x, len(number)) for x in re.findall(r"[^\W_]+", t.lower())], dtype=np.int64) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = {i: Counter(x.tolist()) for i, x in w.items()}
    for i, j in itertools.combinations(sorted(texts), 2):
        most = int(0.2 * max(len(w[i]), len(w[j])) + 1e-9)
        if max(len(w[i]), len(w[j])) - (bags[i] & bags[j]).total() <= most and edits(w[i], w[j]) <= most:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {find(i) for i in texts}


def test_stages_against_brute_force(spark, sf001, tmp_path):
    """Each stage is judged on its own input, written and read again as the driver does."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    columns = docs.columns
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf001)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns, name
        gone = {i: before[i].text for i in before.keys() - after.keys()}
        if k == 0:
            assert set(gone) == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
            known = [i for i in after if before[i].lang is not None]
            assert sum(after[i].lang == before[i].lang for i in known) >= 0.97 * len(known)
            assert all(after[i].text == before[i].text for i in after)
        elif k == 1:
            first = {}
            for i in sorted(before):
                first.setdefault(exact.normalise(before[i].text), i)
            assert set(after) == set(first.values())
        elif k == 2:
            assert set(after) == one_of_each({i: r.text for i, r in before.items()})
        elif k == 3:
            leaks = {i for i, r in before.items() if any(q and len(q & shingles(r.text)) >= contamination.THRESHOLD * len(q) for q in items)}
            assert set(gone) == leaks
        else:
            ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
            library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(ranks), special_tokens={})
            assert set(after) == set(before)
            for i, row in after.items():
                ids = library.encode(before[i].text, disallowed_special=())
                assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                assert row.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf001).count() == docs.count()


@pytest.mark.parametrize("stage", range(5))
def test_edges(spark, sf001, stage, edge_docs, no_docs):
    plain = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, plain, sf001)
    ids = sorted((r.doc_id or 0) for r in out.select("doc_id").collect())
    assert ids == [[0, 3, 4, 5, 5, 6, 7], [0, 0, 1, 3, 5, 5, 7], [0, 0, 1, 3, 5, 5, 7], [0, 0, 1, 2, 3, 4, 5, 5, 6, 7], [0, 0, 1, 2, 3, 4, 5, 5, 6, 7]][stage], name
    assert f(spark, no_docs, sf001).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
