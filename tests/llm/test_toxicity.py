import itertools
import random
import re
import zlib

import numpy as np

from siltstone.llm import toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    move = rng.normal(size=(2, 2))
    lengths = np.array([7, 5, 5, 1, 0])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    score = rng.normal(size=lengths.sum()) * 2
    ahead, behind = toxicity.recursions(score, start, lengths, move)
    got = 1 / (1 + np.exp(-(ahead + behind)))
    for s, n in zip(start, lengths):
        weight, marginal = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[s + i] for i in range(n) if states[i]) + sum(move[a, b] for a, b in zip(states, states[1:])))
            weight += w
            marginal += w * np.array(states)
        if n:
            assert np.allclose(got[s : s + n], marginal / weight)


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(400)], ["vilex", "vilexes", "grosso", "grossen", "nastik"]
    docs, labels = [], []
    for i in range(700):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (None, "vilex")]
    labels += [(900, None), (901, None), (None, 1), (3, None), (4, 0), (4, 1), (99999, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as toxic", "1 as score")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(docs)
    truth, texts = dict(labels[:700]), dict(docs)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in rows if r.held_out} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    found = [texts[r.doc_id][s.start : s.end] for r in held for s in r.spans]
    assert found and sum(any(b[:4] in f for b in bad) for f in found) >= 0.95 * len(found)


def test_nothing_to_learn(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(edge_docs, labels)
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(r.score == 0.0 for r in rows)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_offsets_where_lower_case_is_longer():
    text = "İx idiot word"
    words = toxicity.tokens(text)
    assert words[1:] == ["idiot", "word"]
    assert [text[s:e] for s, e in toxicity.spans(text, np.array([float(w == "idiot") for w in words]))] == ["idiot"]
    for text in ("ΑΣ Σ ß", "plain text", None, "", "ǅ İİ a_b 1"):
        assert len(toxicity.tokens(text)) == len(re.findall(r"\w+", text or ""))


def test_score_and_spans_against_enumeration():
    """Every labelling of a short text is weighed with the chain's own features; score and offsets follow from the marginals."""
    rng = random.Random(9)
    plain, bad = [f"w{i}" for i in range(60)], ["vilex", "grosso"]
    sample = [(" ".join(rng.choice(plain) for _ in range(20)), "0") for _ in range(120)]
    sample += [(" ".join([rng.choice(plain) for _ in range(10)] + [rng.choice(bad)] + [rng.choice(plain) for _ in range(9)]), "1") for _ in range(60)]
    model = toxicity.Model(sample)
    hot = 0
    for _ in range(40):
        text = ", ".join(rng.choice(plain + bad * 5).upper() for _ in range(rng.randint(1, 8)))
        found = list(re.finditer(r"\w+", text))
        words = [m.group().lower() for m in found]
        local = [model.chain.bias + sum(model.chain.weights.get(f, 0.0) for f in model.chain._features(words, i, w)) for i, w in enumerate(words)]
        total, marginal = 0.0, np.zeros(len(words))
        for states in itertools.product((0, 1), repeat=len(words)):
            weight = np.exp(sum(x for x, y in zip(local, states) if y) + sum(model.chain.move[a, b] for a, b in zip(states, states[1:])))
            total += weight
            marginal += weight * np.array(states)
        marginal /= total
        evidence = marginal.max(), np.log1p(marginal[marginal > 0.2].sum())
        score = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * evidence[0] + model.curve[2] * evidence[1])))
        got = model.marginals([toxicity.tokens(text)])[0]
        assert np.allclose(got, marginal, atol=1e-6) and np.isclose(model.score(got), score, atol=1e-6)
        inside = set()
        for m, p, before in zip(found, marginal, [0.0, *marginal]):
            if p >= 0.5:
                inside |= set(range(m.start() - 2 * (before >= 0.5), m.end()))
        spans = toxicity.spans(text, got)
        assert inside == {i for s, e in spans for i in range(s, e)}
        hot += len(spans)
    assert hot > 10


def test_a_very_long_text_with_a_fitted_model(spark):
    sample = [("good day here", "0")] * 3 + [(f"a{i} day", "0") for i in range(60)] + [(f"vilex b{i}", "1") for i in range(60)]
    docs = spark.createDataFrame([(1, "day " * 400_000 + "vilex b1"), (2, "x" * 3_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(docs, toxicity.Model(sample)).collect()}
    assert [(s.start, s.end) for s in rows[1].spans][-1][0] >= 1_600_000 and rows[2].predicted == 0
