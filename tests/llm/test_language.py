import random
import zlib

from siltstone.llm import language

SOUNDS = {"en": ["the", "wh", "ing", "ed", "sh"], "de": ["sch", "ung", "ich", "keit", "ß"], "fr": ["eau", "tion", "oi", "é", "ç"], "es": ["ción", "ñ", "ado", "os", "ll"]}


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    docs = []
    for i in range(800):
        lang = rng.choice(list(SOUNDS))
        docs.append((i, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 120))), lang))
    extra = [(900, None, "en"), (901, "12 $$ 34", "en"), (902, "", None), (903, "the whing", None), (None, "the whing shed", "fr")]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as __label")
    model = language.fit(frame)
    assert set(model.families) == {"germanic", "romance"} and set(model.pairs) == {("de", "en"), ("es", "fr")}
    rows = {r.doc_id: r for r in language.predict(frame, model).collect()}
    truth = {i: lang for i, _, lang in docs}
    held = [r for i, r in rows.items() if i in truth and r.held_out]
    assert {i for i, r in rows.items() if r.held_out} == {i for i in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert [rows[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = language.keep_known(frame, model)
    assert kept.columns == frame.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


def test_one_language_and_none(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(i, "some words", "xx") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs)).collect()} == {("xx", 1.0)}
    empty = language.fit(no_docs)
    assert language.predict(no_docs, empty).count() == 0
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert len(language.predict(edge_docs, language.fit(edge_docs)).collect()) == edge_docs.count()
