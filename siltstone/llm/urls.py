"""URL filtering: rules, host word segmentation and a naive Bayes verdict.

Rules decide first: a rule names a host (and all its subdomains) and a path
prefix; the longest that fits wins.  Other urls go to the method: a unigram
Viterbi search splits host labels and path tokens into words, and a multinomial
naive Bayes model scores the words.

Both models come from the corpus.  Unigram counts are those of the words of all
given texts, of which about the ``LEXICON`` commonest are kept.  The Bayes model has
the labelled words below, ``SEED`` each, and what two sources say: the urls
that a rule judges, a host being one unit however many pages it has, and, where
they are given, documents labelled toxic and not, a document being one unit.  What
any rule names (host labels, runs of letters of its path) is masked in all urls of
either verdict and when scoring, so the rules themselves are not learned.  A word
counts only if it stands in at least ``LEAST_UNITS`` units of a source and its
shares in the two classes differ by ``SIGMAS`` standard errors: a word of a few
hosts says nothing of other hosts.  Each class of a source weighs ``MASS``, shared
among all its words, however many units it has.  Both verdicts are as likely
beforehand, and a url is blocked only if its words speak for that.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed; rows that repeat give equal
rows and count as often when fitting; null texts have no words; where no word of a
source counts, the labelled words alone decide; extra columns are ignored; an empty table
gives no rows.  Segmentation is linear in the length of a url.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import choose_ids, commonest, in_slices, materialise

ALLOW, BLOCK = "allow", "block"

# Labelled words, with the model's two classes.  Names of sections that any site has (blog, help, index) are in neither.
TRAINING = {
    BLOCK: "adult ads porn sex xxx nude casino poker betting bets slots jackpot lottery gamble gambling spam scam phish malware virus warez crack keygen torrent pirate popup doubleclick affiliate pills meds viagra pharma loan payday escort hookup",
    ALLOW: "news wiki science school university library museum health garden kitchen recipe travel weather music art book history sport family food house city local world daily times journal research study learn teach course",
}
#: Words of the unigram model, words of the Bayes model from each source, the weight of a labelled word, and of all words of a class of a source.
LEXICON, FEATURES, SEED, MASS = 50_000, 50_000, 2, 10_000
#: Units that a word must stand in, and standard errors between its shares in the two classes.
LEAST_UNITS, SIGMAS = 5, 4.0
#: Labelled documents of each class that words are taken from.
PER_LABEL = 1500
#: Letters of the longest word of the unigram model.
LONGEST = 24
#: Words of an unknown name are this many times likelier than chance letters.
UNKNOWN = 10.0
#: Names whose splits a worker remembers, and the longest name that it does.
CACHE_ENTRIES, CACHED = 50_000, 64

_SPLIT = re.compile(r"[^a-z]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a rule is written host + path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's; else null) of every url."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def count_words(*texts: DataFrame, most: int = LEXICON) -> dict[str, int]:
    """The commonest words (runs of the letters a to z, markup apart) of frames of one text column each, with their counts."""
    words = None
    for frame in texts:
        plain = F.regexp_replace(F.lower(F.coalesce(F.col(frame.columns[0]).cast("string"), F.lit(""))), "<[^<>]*>", " ")
        each = frame.select(F.explode(F.split(plain, "[^a-z]+")).alias("word"))
        words = each if words is None else words.unionByName(each)
    held = materialise(words.filter(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "url-words")
    return {r["word"]: r["n"] for r in commonest(held, most).collect()}


class Segmenter:
    """Viterbi search for the likeliest split of a run of letters into words.

    A known word costs its negative log probability; a stretch that no word
    covers costs as a word seen less than once, and ten times more a letter.
    """

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=0)
        self.strange, self.letter = math.log(total / UNKNOWN) if total > UNKNOWN else 0.0, math.log(10.0)
        self.known: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        found = self.known.get(name)
        if found is None:
            found = self._search(name)
            if len(name) <= CACHED:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[name] = found
        return found

    def _search(self, name: str) -> tuple[str, ...]:
        n, inf = len(name), math.inf
        # ended[j], within[j]: least cost of the first j letters, the last of them ending a piece, or standing in a strange one.
        ended, within = [0.0] + [inf] * n, [inf] * (n + 1)
        cut, opened = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            go_on, start = within[j - 1], ended[j - 1] + self.strange
            within[j] = min(go_on, start) + self.letter
            opened[j] = opened[j - 1] if go_on <= start else j - 1
            ended[j], cut[j] = within[j], opened[j]
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(name[i:j])
                if c is not None and ended[i] + c <= ended[j]:
                    ended[j], cut[j] = ended[i] + c, i
        out, j = [], n
        while j:
            out.append(name[cut[j] : j])
            j = cut[j]
        return tuple(reversed(out))


def named(rules: list[tuple[str, str]]) -> frozenset[str]:
    """Runs of letters that the rules themselves name."""
    return frozenset(r for text, _ in rules for r in _SPLIT.split(text.lower()) if r)


def names(host: str, path: str, masked: frozenset[str] = frozenset()) -> list[str]:
    """Runs of letters of the host's labels (without the last, the public suffix) and of the path, but for masked ones."""
    labels = host.split(":")[0].split(".")
    if len(labels) > 1:
        labels = labels[:-1]
    return [r for part in (*labels, path.lower()) for r in _SPLIT.split(part) if r and r not in masked]


class Model:
    """Unigram counts, and a multinomial naive Bayes model with add-one smoothing over (verdict, word) -> weight."""

    def __init__(self, lexicon: dict[str, int], words: dict[tuple[str, str], float], masked: frozenset[str] = frozenset()):
        counts = {c: {w: SEED for w in TRAINING[c].split()} for c in (BLOCK, ALLOW)}
        for (c, w), n in words.items():
            counts[c][w] = counts[c].get(w, 0) + n
        vocabulary = set().union(*counts.values())
        total = {c: sum(counts[c].values()) + len(vocabulary) for c in counts}
        self.weight = {w: math.log((counts[BLOCK].get(w, 0) + 1) / total[BLOCK]) - math.log((counts[ALLOW].get(w, 0) + 1) / total[ALLOW]) for w in vocabulary}
        self.segmenter = Segmenter({**dict.fromkeys((w for c in TRAINING.values() for w in c.split()), SEED), **lexicon})
        self.masked = masked

    def words(self, host: str, path: str) -> list[str]:
        return [w for name in names(host, path, self.masked) for w in self.segmenter.split(name)]

    def score(self, host: str, path: str) -> float:
        """P(block)."""
        odds = sum(self.weight.get(w, 0.0) for w in self.words(host, path))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _telling(units: DataFrame, totals: dict[str, int], most: int) -> dict[tuple[str, str], float]:
    """What a word (word, verdict: one row for each unit) weighs in each class, of the words that tell the classes apart."""
    if not all(totals.get(c) for c in (BLOCK, ALLOW)):
        return {}
    of = {c: F.count_if(F.col("verdict") == c) for c in (BLOCK, ALLOW)}
    counts = materialise(units.groupBy("word").agg(of[BLOCK].alias(BLOCK), of[ALLOW].alias(ALLOW), F.count(F.lit(1)).alias("n")), "url-unit-words")
    all_words = counts.agg(F.sum(BLOCK).alias(BLOCK), F.sum(ALLOW).alias(ALLOW)).first()
    b, a = float(totals[BLOCK]), float(totals[ALLOW])
    share = F.col("n") / (a + b)
    error = F.sqrt(share * (1 - share) * (1 / a + 1 / b))
    apart = F.abs(F.col(BLOCK) / b - F.col(ALLOW) / a) >= F.greatest(SIGMAS * error, F.lit(1e-9))
    found = commonest(counts.filter((F.col("n") >= LEAST_UNITS) & apart), most).collect()
    return {(c, r["word"]): MASS * r[c] / all_words[c] for r in found for c in (BLOCK, ALLOW) if r[c]}


def from_urls(urls: DataFrame, lexicon: dict[str, int], rules: list[tuple[str, str]], most: int = FEATURES) -> dict[tuple[str, str], float]:
    """What the judged rows of ``urls`` (see ``parsed``) say: hosts of each verdict by word."""
    judged = urls.filter(F.col("verdict").isNotNull()).select("host", "path", "verdict")
    shipped = urls.sparkSession.sparkContext.broadcast(Model(lexicon, {}, named(rules)))  # LEXICON words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            hosts, paths, says = (b.column(i).to_pylist() for i in range(3))
            found = sorted({(h, v, w) for h, p, v in zip(hosts, paths, says, strict=True) for w in model.words(h, p)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], names=["host", "verdict", "word"])

    each = in_slices(judged, run, "host string, verdict string, word string", 4096).distinct()
    totals = {r["verdict"]: r["n"] for r in judged.select("host", "verdict").distinct().groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _telling(each, totals, most)


def from_documents(docs: DataFrame, labels: DataFrame, most: int = FEATURES) -> dict[tuple[str, str], float]:
    """What labelled documents say: toxic and other documents by word, of at most ``PER_LABEL`` documents a class."""
    verdict = F.when(F.col("toxic") == 1, BLOCK).when(F.col("toxic") == 0, ALLOW)
    ids = labels.select("doc_id", verdict.alias("__label")).filter("doc_id is not null and __label is not null")
    chosen = choose_ids(ids, PER_LABEL, 2 * PER_LABEL)
    if chosen is None:
        return {}
    chosen = materialise(chosen.select("doc_id", F.col("__label").alias("verdict")), "url-labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * PER_LABEL ids
    word = F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))).alias("word")
    units = texts.select("doc_id", "verdict", word).filter(F.length("word").between(1, LONGEST)).distinct()
    totals = {r["verdict"]: r["n"] for r in chosen.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _telling(units, totals, most)


def fit(urls: DataFrame, lexicon: dict[str, int], rules: list[tuple[str, str]], docs: DataFrame | None = None, labels: DataFrame | None = None) -> Model:
    """A model from all judged rows of ``urls`` and, where given, labelled documents; what reaches the driver is bounded by the parameters."""
    words = from_urls(urls, lexicon, rules)
    for k, n in ({} if docs is None else from_documents(docs, labels)).items():
        words[k] = words.get(k, 0) + n
    return Model(lexicon, words, named(rules))


_RESULT = "page_id long, host string, path string, rule string, verdict string, score double"


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Model) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's P(block)) of every url."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)  # LEXICON and FEATURES words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            hosts, paths, says = (b.column(i).to_pylist() for i in (1, 2, 4))
            scores = [model.score(h, p) for h, p in zip(hosts, paths, strict=True)]
            verdicts = [v or (BLOCK if s > 0.5 else ALLOW) for v, s in zip(says, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return in_slices(parsed(pages, rules), run, _RESULT, 4096)
