"""Language identification by hierarchical discrimination.

One-versus-rest linear SVMs over hashed byte n-grams choose the language family;
one-versus-one linear SVMs then separate the languages of that family by votes,
margins deciding ties.  Models are fitted on a bounded, documented sample of
labelled whole texts; every document is scored whole.

Defined results: a text that is null or has no letter is ``und`` with score 0;
rows that repeat give equal rows; a null language is never learned; every other
one is, from fewer texts each where there are more than ``MAX_TEXTS`` /
``PER_LANGUAGE`` (past ``MAX_TEXTS`` languages, the commonest from one text
each); with no labelled text all is ``und``;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, in_slices, labelled_sample

#: Bound of the training sample: texts per language, texts in all, characters of a text.
PER_LANGUAGE, MAX_TEXTS, MAX_CHARS = 800, 12_800, 8_000
DIMENSIONS = 4096
UNDETERMINED = "und"

# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "indic": "hi bn mr gu pa ur ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_OTHER = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Hashed counts of byte 2-, 3- and 4-grams of the lower-case letters, square-rooted, of length one."""
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    raw = f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()
    for start in range(0, len(raw), 1 << 20):
        b = np.frombuffer(raw[start : start + (1 << 20) + 3], dtype=np.uint8).astype(np.uint32)
        code = b
        for n in (2, 3, 4):
            if len(b) < n:
                break
            code = (code[:-1] * np.uint32(0x01000193)) ^ b[n - 1 :]
            mixed = (code ^ np.uint32(n << 24)) * np.uint32(0x9E3779B1)
            out += np.bincount(mixed >> np.uint32(20), minlength=DIMENSIONS)
    x = np.sqrt(out.astype(np.float32))
    return x / max(1e-9, float(np.linalg.norm(x)))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 12) -> np.ndarray:
    """Weights and bias of an L2-loss linear SVM, by dual coordinate descent; y is 1 or -1."""
    n = len(y)
    x = np.hstack([x, np.ones((n, 1), dtype=x.dtype)])
    squared = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(n):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - gradient / squared[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """families: name -> languages; rest: weights of each family; pairs: weights of each pair within a family."""

    def __init__(self, sample: list[tuple[str, str]]):
        texts = [(t, lang) for t, lang in sample if has_letter(t)]
        langs = sorted({lang for _, lang in texts})
        self.families: dict[str, list[str]] = {}
        for lang in langs:
            self.families.setdefault(family(lang), []).append(lang)
        self.names = sorted(self.families)
        x = np.stack([features(t) for t, _ in texts]) if texts else np.zeros((0, DIMENSIONS), np.float32)
        own = np.array([lang for _, lang in texts], dtype=object)
        kin = np.array([family(lang) for lang in own], dtype=object)
        self.rest = np.stack([fit_svm(x, np.where(kin == f, 1.0, -1.0)) for f in self.names]) if len(self.names) > 1 else None
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (own == a) | (own == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        if not known or not self.names:
            return out
        x = np.stack([features(texts[i]) for i in known])
        x = np.hstack([x, np.ones((len(known), 1), np.float32)])
        margins = x @ self.rest.T if self.rest is not None else np.ones((len(known), 1))
        pairs = {k: x @ w for k, w in self.pairs.items()}
        for row, i in enumerate(known):
            best = int(np.argmax(margins[row]))
            score = _logistic(margins[row, best]) if self.rest is not None else 1.0
            members = self.families[self.names[best]]
            votes, sums, least = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
            for a, b in combinations(members, 2):
                m = float(pairs[a, b][row])
                votes[a if m >= 0 else b] += 1
                for lang, side in ((a, m), (b, -m)):
                    sums[lang] += side
                    least[lang] = min(least[lang], _logistic(side))
            lang = max(members, key=lambda c: (votes[c], sums[c]))
            out[i] = (lang, float(min(1.0, max(0.0, score * least[lang]))))
        return out


def _logistic(margin: float) -> float:
    """A margin of 1, the SVM's aim, counts as 0.95."""
    return float(1 / (1 + np.exp(-3.0 * margin)))


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """A model from the documents outside the held-out remainder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(crc_bucket("doc_id", modulus) != held_out)
    return Model(labelled_sample(rows, "lang", PER_LANGUAGE, MAX_TEXTS, MAX_CHARS))


def predict(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # weights: bounded by languages and dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shipped.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_bucket("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "text")
    return in_slices(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a language, ``lang`` being the predicted one; those without a letter go."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text_at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lang for lang, _ in shipped.value.predict(b.column(text_at).to_pylist())]
            columns = [pa.array(found, b.column(i).type) if i == lang_at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array([lang != UNDETERMINED for lang in found], pa.bool_()))

    return in_slices(docs, run, docs.schema)
