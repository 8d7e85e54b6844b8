import random
import re

from siltstone.llm import contamination


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for i, t in items:
        q = shingles(t)
        for d, x in docs:
            n = len(q & shingles(x)) if q and d is not None else 0
            if q and n >= 0.8 * len(q):
                out.add((d, i, n, len(q)))
    return out


def test_short_items_inside_long_documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 15, 40, 120])))) for i in range(40)] + [(100, None), (101, ""), (102, "one two three four five six one two three four five six")]
    docs = []
    for d in range(120):
        body = [rng.choice(words) for _ in range(rng.choice([20, 400, 6000]))]
        for _, t in rng.sample(items[:40], rng.randint(0, 2)):
            passage = t.upper().split()
            if rng.random() < 0.5 and len(passage) > 30:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = passage
        docs.append((d, ", ".join(body)))
    docs += [(500, None), (501, ""), (502, "One, two: three four five six. one two three four five six"), (502, "other text"), (None, items[3][1]), (503, "é " * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as k", "3 as w", "4 as h")
    found = contamination.search(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in found.collect()}
    want = brute(docs, items)
    assert want and got == want
    kept = contamination.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, *_ in want}


def test_rows_of_one_id_are_one_document(spark):
    item = [f"t{i}" for i in range(60)]
    filler = [f"f{i}" for i in range(3000)]
    rows = [(1, " ".join(item[:32])), (1, " ".join(filler + item[28:])), (2, " ".join(item[:32])), (3, " ".join(item)), (3, " ".join(item))]
    found = contamination.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_shared, r.n_shingles) for r in found.collect()) == [(1, 56, 56), (3, 56, 56)]


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contamination.search(no_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert contamination.search(docs, items.limit(0)).count() == 0
    assert contamination.search(docs, items).count() == 1
