import random
import re
import zlib
from collections import Counter

import pytest

from siltstone.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = sorted(set("".join(n)))
    near = {}
    for w in n:
        other = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in letters}
        near[w] = sorted((-n[d], d) for d in other - {w} if d in n)
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def misspelled(seed, n, stems):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            while rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice("aeAXéÿ") * rng.randint(0, 1) + w[at + rng.randint(0, 1) :]
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "_7", "一"]).join(words)))
    return rows


STEMS = ["banana", "bandana", "colour", "color", "aaaaaa", "aaaaa", "Straße", "ÉCOLE", "internationalisation", "abcde", "abcd", "co÷rd"]


@pytest.mark.parametrize("hot", [spelling.HOT, 3, 40])
def test_against_brute_force(spark, hot):
    rows = misspelled(hot, 500, STEMS)
    want = brute(rows)
    assert len(want) > 300 and any(r[1] and r[1] != r[2] for r in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(spelling.variants(docs, hot)) == want


def test_words_of_the_shortest_length_and_one_common_half(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("abcde" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.variants(docs, 5)) == brute(rows)


def test_automaton_numbers_words_in_order_and_is_minimal():
    words = sorted({"tap", "taps", "top", "tops", "a", "", "été", "stop", "stops"})
    automaton = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.follow(automaton.start, 0, w)
        assert state[0] and number == k
    ends = {id(automaton.follow(automaton.start, 0, w)[0]) for w in ("tap", "top", "stop")}
    assert len(ends) == 1  # one state for what the three go on with
    assert automaton.one_error("tops", 0) == {words.index(w) for w in ("top", "taps", "stops")}
    assert automaton.one_error("tops", 2) == {words.index("top")}
    assert spelling.Automaton([]).one_error("a", 0) == set()


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(spelling.variants(edge_docs)) == brute(rows)
    assert spelling.variants(no_docs).count() == 0
    clashing = spark.createDataFrame([(None, "Words words WORDS wordıs", 1, 2, "a", 3)], "doc_id long, text string, n long, key long, word string, back int")
    assert result(spelling.variants(clashing)) == brute([(None, "Words words WORDS wordıs")])
