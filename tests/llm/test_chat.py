import hashlib
import random

from siltstone.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string"


def turns_of(spark, log):
    read = chat.read_back(chat.render(chat.fold_events(spark.createDataFrame(log, SCHEMA)).repartition(3)))
    return {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in read.collect()}


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 0, 2, "edit", None, "hello"),
        (1, 1, 3, "message", "assistant", ""), (1, 1, 4, "delta", None, "wro"), (1, 1, 5, "delta", None, "ng"),
        (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "ri"), (1, 1, 8, "delta", None, "ght"),
        (2, 0, 1, "delta", "assistant", "only"), (2, 0, 2, "delta", None, " deltas"),
        (3, 0, 0, None, None, None),
        (4, 5, 0, "message", "user", "same"), (4, 5, 0, "message", "user", "same"),
    ]
    random.Random(1).shuffle(log)
    assert turns_of(spark, log) == {
        1: [("user", "hello", False), ("assistant", "right", True)],
        2: [("assistant", "only deltas", True)],
        3: [("", "", False)],
        4: [("user", "same", False), ("user", "same", False)],
    }


def test_control_strings_survive(spark):
    rng = random.Random(3)
    bits = ["<|turn|>", "<|end|>", "\n", "<", "|", "\\", "<\\|", "<\\\\|end|>", "assistant", "$1", "\\s", "\\n", "é", "🙂", "### Assistant:", "</turn>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    log = [(i // 100, i % 100, 0, "message", rng.choice(["user", "assistant", "a\\b\n<|turn|>"]), t) for i, t in enumerate(texts)]
    got = turns_of(spark, log)
    for c in range(3):
        assert got[c] == [(r, t, r == "assistant") for k, _, _, _, r, t in log if k == c]


def test_mask_covers_the_output_and_only_assistant_text(spark):
    log = [(1, i, 0, "message", "assistant" if i % 2 else "user", "t<|end|>" * i) for i in range(200)]
    r = chat.render(chat.fold_events(spark.createDataFrame(log, SCHEMA))).first()
    assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
    at, text = 0, []
    for m in r.loss_mask:
        if m.loss:
            text.append(r.formatted[at : at + m.chars])
        at += m.chars
    assert text == [("t<\\|end|>" * i) for i in range(1, 200, 2)]


def test_digests(spark):
    log = spark.createDataFrame([(9, 1, 0, "message", "assistant", "b🙂"), (9, 0, 0, "message", "user", None)], SCHEMA)
    r = chat.digests(chat.render(chat.fold_events(log))).first()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (9, 2, 2)
    assert r.turns_sha256 == hashlib.sha256("user\n\nassistant\nb🙂\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256("b🙂".encode()).hexdigest()


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.render(chat.fold_events(none))).count() == 0
    log = spark.createDataFrame([(1, None, None, None, None, "x" * 2_000_000)], SCHEMA).withColumn("formatted", F.lit(1)).withColumn("part", F.lit(7))
    assert chat.digests(chat.render(chat.fold_events(log))).first().formatted_chars == 2_000_000 + len(chat.TURN) + 1 + len(chat.END)


def test_log_of_finished_turns_folds_back(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "é🙂" * 40, "x" * 47, "y" * 48, "z" * 49, "<|end|>" * 2000])) for c in range(4) for t in range(30)]
    rows += [(1, 3, "user", "again"), (1, 3, "user", "again"), (1, 4, "assistant", "b" * 500), (1, 4, "assistant", "a" * 500), (9, None, "user", "late")]
    log = chat.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["message"] == len(rows) and min(kinds.get(k, 0) for k in ("delta", "edit", "regenerate")) > 30
    assert log.groupBy("conv_id", "turn", "message").agg(F.count_distinct("seq").alias("a"), F.count(F.lit(1)).alias("b"), (F.max("seq") - F.min("seq")).alias("w")).filter("a <> b or w >= 128").count() == 0
    read = chat.read_back(chat.render(chat.fold_events(log))).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read}
    for c in got:
        want = sorted(((t if t is not None else -1), r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c] == [(r, x) for _, r, x in want]
