import random

import numpy as np
import pytest

from siltstone.llm import neardup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_exact_up_to_its_bound():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randint(1, rng.choice([3, 9, 90])) for _ in range(rng.randint(0, 120))]
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            k = rng.randint(0, len(b))
            o = rng.random()
            if o < 0.3 and b:
                del b[k - 1]
            elif o < 0.6:
                b.insert(k, rng.randint(1, 9))
            elif b:
                b[k - 1] = rng.randint(1, 9)
        most = rng.choice([0, 3, 10, 30, 100])
        got = neardup.edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most)
        assert got == min(distance(a, b), most + 1)


def test_sketches_depend_on_order_and_repeats():
    h = neardup._hashed([f"w{i}" for i in range(60)])
    assert np.array_equal(neardup.sketches(h), neardup.sketches(h.copy()))
    swapped = np.concatenate([h[30:], h[:30]])
    assert (neardup.sketches(h) == neardup.sketches(swapped)).mean() < 0.95
    assert len(set(neardup.labelled_kmers(neardup._hashed(["a"] * 20), 5).tolist())) == 16


def components(docs):
    texts = {}
    for i, t in docs:
        if i is not None:
            texts.setdefault(tuple(neardup.words(t)), []).append(i)
    keys = list(texts)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(keys)):
        for y in range(x):
            a, b = keys[x], keys[y]
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                parent[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(texts[k])
    return {i: min(g) for g in groups.values() for i in g}


def test_classes_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs) * 13 % 997, " ".join(copy)))
    docs += [(2000, docs[0][1].upper()), (2000, docs[0][1].upper()), (2001, None), (2002, ""), (2003, "one two"), (2004, "One, two!"), (None, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as id", "3 as class_id", "4 as a", "5 as n", "6 as bucket")
    rows = neardup.classes(frame).collect()
    assert len(rows) == len(docs)
    want = components(docs)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == want
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {None, *want.values()}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)]
    got = {r.id: r.class_id for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(500, 580), 500)}


def test_edges(spark, edge_docs, no_docs):
    rows = neardup.classes(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, None: None}
    assert neardup.classes(no_docs).count() == 0


def test_ids_with_several_texts_lose_no_link(spark):
    rng = random.Random(11)
    a, b, c = ([f"{k}{rng.randint(0, 10**6)}" for _ in range(80)] for k in "abc")
    change = lambda w, at: " ".join([*w[:at], "changed", *w[at + 1 :]])
    # Ids 1 and 6 each have two texts; text a's copy under id 6 must not be taken for id 6's other text.
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, change(a, 9)), (3, change(b, 40)), (6, " ".join(a)), (6, " ".join(c)), (7, change(c, 70)), (8, change(c, 3)), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {(r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()}
    assert stay == {rows[i] for i in (0, 1, 5, 8)}
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in neardup.classes(docs).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (6, 1, False), (6, 6, True), (7, 6, False), (8, 6, False), (9, 9, True)]


def test_pairs_among_strangers_that_share_a_passage(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(20_000)]
    passage = [rng.choice(words) for _ in range(150)]
    docs, pairs = [], []
    for i in range(160):
        base = passage + [rng.choice(words) for _ in range(45)]
        docs.append((i, base))
        if i >= 120:
            copy = list(base)
            for k in rng.sample(range(195), 24):
                copy[k] = rng.choice(words)
            docs.append((i + 1000, copy))
            pairs.append((i, i + 1000))
    of = {i: set(enumerate(neardup.sketches(neardup._hashed(w)).tolist())) for i, w in docs}
    met = [(a, b) for a, b in pairs if of[a] & of[b]]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert len(met) > 20 and [p for p in met if got[p[0]] != got[p[1]]] == []


def edited(rng, words, edits, kind):
    """``words`` after so many edits at random places (``even``: at equal distances)."""
    out = list(words)
    if kind == "even":
        for k in np.linspace(0, len(words) - 1, edits).astype(int):
            out[k] = int(rng.integers(1, 1 << 62))
    elif kind == "substitute":
        for k in rng.choice(len(words), edits, replace=False):
            out[k] = int(rng.integers(1, 1 << 62))
    else:
        for _ in range(edits):
            k = int(rng.integers(0, len(out)))
            if rng.random() < 0.5:
                del out[k]
            else:
                out.insert(k, int(rng.integers(1, 1 << 62)))
    return out


@pytest.mark.parametrize("share", [0.2, 0.18, 0.15, 0.1])
@pytest.mark.parametrize("n", [5, 8, 12, 16, 20, 26, 40, 60, 200, 1000])
@pytest.mark.parametrize("kind", ["substitute", "even", "mixed"])
def test_isolated_pairs_share_a_sketch(n, share, kind):
    """Pairs that nothing else links: of those within the bound, at least 95 % meet in a bucket."""
    rng = np.random.default_rng(n)
    met = similar = 0
    for _ in range(100):
        a = [int(x) for x in rng.integers(1, 1 << 62, n)]
        x, y = (np.array(w, dtype=np.uint64) for w in (a, edited(rng, a, int(share * n), kind)))
        if neardup.similar(x, y):
            similar += 1
            place = [dict(zip(range(0 if len(w) >= neardup.PAIRED else neardup.SKETCHES, 200), neardup.sketches(w).tolist(), strict=False)) for w in (x, y)]
            met += bool(place[0].items() & place[1].items())
    assert similar >= 50 and met >= 0.95 * similar, (met, similar)


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    for _ in range(400):
        a = rng.integers(1, 30, rng.integers(1, 60)).astype(np.uint64)
        b = np.array(edited(rng, a.tolist(), int(rng.integers(0, min(20, len(a)))), "mixed"), dtype=np.uint64)
        d = distance(a.tolist(), b.tolist())
        x, y = neardup._slots(a), neardup._slots(b)
        k = neardup.SLOTS
        assert neardup.least_edits(x[:k], y[None, :k], 1)[0] <= d and neardup.least_edits(x[k:], y[None, k:], 2)[0] <= d


def families(rng, words, n_families, size, most):
    """Families of copies of copies, edited about as far as the bound."""
    docs = []
    for _ in range(n_families):
        base = [rng.choice(words) for _ in range(rng.randint(6, 70))]
        own = [base]
        for _ in range(rng.randint(1, size)):
            copy = list(rng.choice(own))
            for _ in range(rng.randint(0, int(most * len(copy)))):
                k, o = rng.randrange(len(copy)), rng.random()
                if o < 0.7:
                    copy[k] = rng.choice(words)
                elif o < 0.85:
                    copy.insert(k, rng.choice(words))
                elif len(copy) > 5:
                    del copy[k]
            own.append(copy)
        docs += own
    return docs


@pytest.mark.parametrize("block", [2, 256])
def test_every_pair_of_a_bucket_is_decided(spark, monkeypatch, block):
    """Classes are the components of all similar pairs that share a sketch, aligned one by one; with tiny blocks too."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(25)]
    docs = families(rng, words, 12, 14, 0.25) + [passage + [rng.choice(words) for _ in range(rng.randint(4, 12))] for _ in range(40)]
    texts = {}
    for i, w in enumerate(docs):
        texts.setdefault(tuple(w), i)
    keys = list(texts)
    hashes = [neardup._hashed(list(k)) for k in keys]
    held = [set(enumerate(neardup.sketches(h).tolist(), 0 if len(h) >= neardup.PAIRED else neardup.SKETCHES)) for h in hashes]
    parent = {i: i for i in range(len(keys))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    apart = 0
    for x in range(len(keys)):
        for y in range(x):
            if held[x] & held[y]:
                most = int(0.2 * max(len(keys[x]), len(keys[y])) + 1e-9)
                if distance(keys[x], keys[y]) <= most:
                    parent[max(find(x), find(y))] = min(find(x), find(y))
                else:
                    apart += 1
    want = {}
    for i, w in enumerate(docs):
        want[i] = texts[keys[find(keys.index(tuple(w)))]]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(frame).collect()}
    assert apart > 100 and got == want
