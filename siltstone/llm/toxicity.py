"""Toxic spans by a linear-chain conditional random field.

Tokens of a bounded sample of labelled documents are labelled from the document
labels: a token of a toxic document is toxic if its word, or a beginning of the
word, is significantly and much commoner in toxic documents than in others.  A
two-state chain with word, affix and neighbour features is fitted to them;
forward-backward marginals of all tokens of a whole text give offending spans
(code-point offsets of the source) and, through a logistic curve fitted on the
sample, a document score.

Defined results: null and empty texts have no token and get the curve's score
for no evidence; rows that repeat give equal rows; a document with several
labels counts by its largest; null labels are not learned; with no label of
either kind every score is 0.5 times that kind's share; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import choose_ids, crc_bucket, in_slices

#: Bound of the training sample: texts per label, characters of a text.
PER_LABEL, MAX_CHARS = 1500, 20_000
#: Texts per label whose tokens train the chain, the first by a hash of the id; all of the sample give the word statistics and the curve.
CHAIN_TEXTS = 300
#: A unit is toxic at so many times the rate elsewhere, with that share of false discoveries among all units tested.
TIMES, FALSE_SHARE = 20, 0.01
#: Rows that a worker scores at once: recursions run over them together.
ROWS = 512

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """The source's tokens, each in lower case."""
    lower = (text or "").lower()
    if len(lower) == len(text or ""):  # then each character became one
        return _TOKEN.findall(lower)
    return [w.lower() for w in _TOKEN.findall(text or "")]


def units(w: str) -> list[str]:
    """A word and its beginnings: inflected and compounded forms share those."""
    return [f"w={w}", *(f"p={w[:n]}" for n in (3, 4, 5) if len(w) >= n)]


def token_labels(texts: list[list[str]], toxic: list[bool]) -> set[str]:
    """Units much commoner in toxic texts.

    Contexts (the two neighbouring words) are counted, each once, so that a
    group of copies counts little more than one text.  A unit's contexts fall to
    toxic texts by chance with the share that these have of all contexts; the
    probability of at least as many is bounded by Chernoff, and the units are
    chosen by Benjamini and Hochberg's rule, so the bar follows the number of
    units tested and not the size of the sample.
    """
    inside: dict[str, set] = {}
    outside: dict[str, set] = {}
    for words, bad in zip(texts, toxic, strict=True):
        into = inside if bad else outside
        padded = ["", *words, ""]
        for before, w, after in zip(padded, words, padded[2:], strict=False):
            context = hash((before, after))
            for u in units(w):
                into.setdefault(u, set()).add(context)
    n1, n0 = (max(1, sum(map(len, side.values()))) for side in (inside, outside))
    share = n1 / (n1 + n0)
    found = []
    for u, contexts in inside.items():
        k, m = len(contexts), len(outside.get(u, ()))
        if k / n1 >= TIMES * (m + 0.5) / n0:
            part = k / (k + m)
            found.append((-(k * math.log(part / share) + (m * math.log((1 - part) / (1 - share)) if m else 0.0)), u))
    tested = len(inside.keys() | outside.keys())
    found.sort()
    passed = [i for i, (log_p, _) in enumerate(found, 1) if log_p <= math.log(FALSE_SHARE * i / tested)]
    return {u for _, u in found[: passed[-1]]} if passed else set()


class Chain:
    """Weights of the features of state 1 (against 0), and log transition weights."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias = -4.0
        self.move = np.zeros((2, 2))

    @staticmethod
    def word_features(w: str) -> list[str]:
        return [*units(w), f"s={w[-3:]}"]

    def parts(self, w: str) -> tuple[float, float, float]:
        """What a word adds to its own score, to the next token's and to the one's before."""
        g = self.weights.get
        return sum(g(f, 0.0) for f in self.word_features(w)), g(f"<{w}", 0.0), g(f">{w}", 0.0)

    def fit(self, texts: list[list[str]], toxic_words: list[set[str]], rounds: int = 60, rate: float = 0.5, penalty: float = 1e-3) -> None:
        counts: Counter = Counter()
        for words in texts:
            for i, w in enumerate(words):
                counts.update(self._features(words, i, w))
        index = {f: k for k, (f, n) in enumerate(sorted(counts.items())) if n >= 3}
        index = {f: k for k, f in enumerate(index)}
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        texts, toxic_words = [texts[i] for i in order], [toxic_words[i] for i in order]
        length = np.array([len(t) for t in texts])
        token_of, feature_of, gold = [], [], []
        for words, bad in zip(texts, toxic_words, strict=True):
            for i, w in enumerate(words):
                for f in self._features(words, i, w):
                    if f in index:
                        token_of.append(len(gold))
                        feature_of.append(index[f])
                gold.append(w in bad)
        token_of, feature_of, gold = np.array(token_of, dtype=np.int64), np.array(feature_of, dtype=np.int64), np.array(gold, dtype=float)
        if not len(gold):
            return
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        w, seen = np.zeros(len(index)), np.full(len(index), 1e-8)
        bias_seen, move_seen = 1e-8, np.full((2, 2), 1e-8)
        has_next = np.ones(len(gold), dtype=bool)
        has_next[(start + length - 1)[length > 0]] = False
        pairs = np.flatnonzero(has_next)
        gold_moves = np.zeros((2, 2))
        np.add.at(gold_moves, (gold[pairs].astype(int), gold[pairs + 1].astype(int)), 1)
        for _ in range(rounds):
            score = self.bias + np.bincount(token_of, weights=w[feature_of], minlength=len(gold))
            ahead, behind = recursions(score, start, length, self.move)
            p = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
            # Expected moves between neighbours, from the same recursions.
            a, b = ahead[pairs], score[pairs + 1] + behind[pairs + 1]
            log = np.stack([np.zeros_like(a) + self.move[0, 0], b + self.move[0, 1], a + self.move[1, 0], a + b + self.move[1, 1]])
            log -= log.max(axis=0)
            joint = np.exp(log)
            joint /= joint.sum(axis=0)
            gradient = np.bincount(feature_of, weights=(gold - p)[token_of], minlength=len(index)) - penalty * w
            seen += gradient**2
            w += rate * gradient / np.sqrt(seen)
            g = float((gold - p).sum())
            bias_seen += g * g
            self.bias += rate * g / math.sqrt(bias_seen)
            g = gold_moves - joint.sum(axis=1).reshape(2, 2) - penalty * self.move
            move_seen += g**2
            self.move += rate * g / np.sqrt(move_seen)
        self.weights = {f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-3}

    def _features(self, words: list[str], i: int, w: str) -> list[str]:
        out = self.word_features(w)
        if i:
            out.append(f"<{words[i - 1]}")
        if i + 1 < len(words):
            out.append(f">{words[i + 1]}")
        return out


def recursions(score: np.ndarray, start: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of state 1 for the tokens of many texts, laid end to end, longest text first.

    The marginal's log odds are their sum.  Each step handles one token of every
    text that is that long.
    """
    ahead, behind = np.empty_like(score), np.zeros_like(score)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
    e = np.exp(move)
    for t in range(steps):
        at = start[: active[t]] + t
        if t == 0:
            ahead[at] = score[at]
            continue
        odds = np.exp(np.clip(ahead[at - 1], -500, 500))
        ahead[at] = score[at] + np.log((e[0, 1] + e[1, 1] * odds) / (e[0, 0] + e[1, 0] * odds))
    for t in range(steps - 2, -1, -1):
        at = start[: active[t + 1]] + t
        odds = np.exp(np.clip(score[at + 1] + behind[at + 1], -500, 500))
        behind[at] = np.log((e[1, 0] + e[1, 1] * odds) / (e[0, 0] + e[0, 1] * odds))
    return ahead, behind


class Model:
    def __init__(self, sample: list[tuple[str, str]]):
        texts = [tokens(t) for t, _ in sample]
        toxic = [label == "1" for _, label in sample]
        self.chain = Chain()
        self.known: dict[str, int] = {}
        self.tables = [np.zeros(0)] * 3
        self.curve = np.array([0.0, 0.0, 0.0])
        share = sum(toxic) / len(toxic) if toxic else 0.0
        self.constant = None if toxic and 0 < share < 1 else 0.5 * share
        if self.constant is not None:
            return
        known = token_labels(texts, toxic)
        words = {w for t, y in zip(texts, toxic, strict=True) if y for w in set(t) if not known.isdisjoint(units(w))}
        bad = [i for i, y in enumerate(toxic) if y and words.intersection(texts[i])][:CHAIN_TEXTS]
        good = [i for i, y in enumerate(toxic) if not y][:CHAIN_TEXTS]
        self.chain.fit([texts[i] for i in bad + good], [words] * len(bad) + [set()] * len(good))
        evidence = np.array([self._evidence(m) for m in self.marginals(texts)])
        self.curve = _logistic_fit(evidence, np.array(toxic, dtype=float))

    @staticmethod
    def _evidence(marginal: np.ndarray) -> tuple[float, float]:
        """The largest marginal and, damped, the expected number of clearly toxic tokens."""
        if not len(marginal):
            return 0.0, 0.0
        return float(marginal.max()), math.log1p(float(marginal[marginal > 0.2].sum()))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of each token of each text."""
        if len(self.known) > 500_000:
            self.known.clear()
        known, new = self.known, []
        if not known:
            self.tables = [np.zeros(0)] * 3
        flat = []
        for words in texts:
            for w in words:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    new.append(w)
                flat.append(k)
        if new:
            parts = np.array([self.chain.parts(w) for w in new])
            self.tables = [np.concatenate([t, parts[:, i]]) for i, t in enumerate(self.tables)]
        length = np.array([len(t) for t in texts], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(length) else length
        at = np.array(flat, dtype=np.int64)
        own, following, before = self.tables
        score = self.chain.bias + own[at]
        if len(at) > 1:
            same = np.ones(len(at), dtype=bool)
            same[start[start < len(at)]] = False  # the first token of a text has no neighbour before it
            inner = np.flatnonzero(same)
            score[inner] += following[at[inner - 1]]
            score[inner - 1] += before[at[inner]]
        order = np.argsort(-length, kind="stable")
        ahead, behind = recursions(score, start[order], length[order], self.chain.move)
        p = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
        return [p[s : s + n] for s, n in zip(start, length, strict=True)]

    def score(self, marginal: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        a, b = self._evidence(marginal)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def _logistic_fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Intercept and weights by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
    return w


def spans(text: str | None, marginal: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Code-point offsets (end exclusive) of runs of neighbouring tokens at or over the threshold."""
    hot = set(np.flatnonzero(marginal >= threshold).tolist())
    if not hot:
        return []
    found = list(_TOKEN.finditer(text or ""))
    out: list[tuple[int, int]] = []
    for i in sorted(hot):
        s, e = found[i].span()
        if out and i - 1 in hot:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> Model:
    """A model from labelled documents outside the held-out remainder."""
    label = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("string").alias("__toxic"))
    label = label.filter((crc_bucket("doc_id", modulus) != held_out) & F.col("__toxic").isin("0", "1"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ids and lengths meet the labels; only the chosen ids, a bounded number, fetch texts.
    short = F.length("text") <= MAX_CHARS
    ids = rows.filter(short & F.col("doc_id").isNotNull()).select("doc_id").join(label, "doc_id").withColumnRenamed("__toxic", "__label")
    chosen = choose_ids(ids, PER_LABEL, 2 * PER_LABEL)
    if chosen is None:
        return Model([])
    found = rows.filter(short).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", F.lit(23)).alias("__h"), "text", "__label")
    return Model(list(dict.fromkeys((r["text"], r["__label"]) for r in sorted(found.collect()))))


def score(docs: DataFrame, model: Model, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, spans array<struct<start, end>> of every whole text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # weights of the sample's features
    span_type = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            texts = b.column(2).to_pylist()
            marginals = model.marginals([tokens(t) for t in texts])
            scores = [model.score(m) for m in marginals]
            found = [[{"start": s, "end": e} for s, e in spans(t, m)] for t, m in zip(texts, marginals, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, span_type)], names=["doc_id", "held_out", "score", "predicted", "spans"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_bucket("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "text")
    return in_slices(rows, run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint>>", ROWS)
