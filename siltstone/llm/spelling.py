"""Spelling variant grouping with forward and backward minimal acyclic automata.

Words are counted in one pass over the texts; ``near`` then finds, for each
word, the words at exactly one inserted, deleted or replaced code point.  A
query is cut in two halves: an error lies in one of them, so the other stands
unchanged.  Words that share the first half meet in a forward automaton: the
half is followed exactly and the rest is completed with one error.  Words that
share the last half meet in a backward automaton of reversed words.  Automata
are minimal and acyclic, and carry perfect-hash word numbers: the number of a
word is what its path adds up to, and indexes the words' counts.  Several ways
to complete one word give one number.  A pair that both directions find is kept
by the forward one alone: the backward search passes over words whose first half
is the query's.  So no pairs leave a task, only a count and the best word.

Tasks are dealt by (query length, half): a word stands there for queries of its
own length and of one more and one less.  Halves that more than ``HOT`` rows
share are cut again, the unknown middle in two quarters, and so on: what is left
of the middle has at most one code point in the end, and so has at most
1 + 90 + 90**2 words, so every automaton is bounded whatever words there are.

Roots follow forms by pointer jumping: a form has at least twice its word's
count, so there are no cycles, and a chain is short.

Defined results: null and empty texts have no words; rows that repeat an id or
text count each; a null id reads as the empty string; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, materialise

#: A run loses a code point where the crc32 of its id and itself is divisible by this.
DROP = 97
#: Code points and occurrences that a word needs, and times its count that a form needs.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Rows of one half from which it is cut again, and rows that fill an automaton.
HOT, FILL = 60_000, 20_000
#: Different words that a worker counts before it hands them on.
HELD = 300_000

#: Latin-1 bytes to word bytes: A-Z lowered, a-z and from 0xC0 on kept, all else a space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters up to U+00FF in Latin-1, A-Z lowered; characters beyond are a ``?``, so no letter."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def changed(doc_id: int | None, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(run, run with a code point less) of the runs that this document writes otherwise."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    crc = zlib.crc32
    for w in words:
        h = crc(w if w.isascii() else w.decode("latin-1").encode(), start)
        if not h % DROP:
            at = h % len(w)
            yield w, w[:at] + w[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = [w for w, n in total.items() if n and len(w) >= LEAST_LENGTH]
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([total[w] for w in part], pa.int64())], names=["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = runs(text)
            total.update(found)
            for w, less in changed(doc_id, set(found)):
                n = found.count(w)
                total[w] -= n
                total[less] += n
            if len(total) > HELD:
                yield from out()
                total.clear()
    yield from out()


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words that are long and common enough, of all texts."""
    counted = in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with word numbers.

    A state is (final, {letter: (state, words passed over)}).  States are made
    from the end of a word when the next one leaves its path, and a state that
    exists already is taken again.
    """

    def __init__(self, words: list[str]):
        self._known: dict[tuple, tuple] = {}
        open_: list[tuple[bool, list[tuple[str, tuple, int]]]] = [(False, [])]
        last = ""
        for word in words:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            self._close(open_, last, same)
            open_.extend((False, []) for _ in range(len(word) - same))
            open_[-1] = (True, open_[-1][1])
            last = word
        self._close(open_, last, 0)
        self.start = self._state(*open_[0])[0]
        del self._known

    def _state(self, final: bool, arcs: list[tuple[str, tuple, int]]) -> tuple[tuple, int]:
        """(state, words from there on); arcs are (letter, state, words)."""
        key = (final, *((c, id(s)) for c, s, _ in arcs))
        if (known := self._known.get(key)) is None:
            number, to = int(final), {}
            for c, s, n in arcs:
                to[c] = (s, number)
                number += n
            known = self._known[key] = ((final, to), number)
        return known

    def _close(self, open_: list, word: str, keep: int) -> None:
        while len(open_) > keep + 1:
            state, n = self._state(*open_.pop())
            open_[-1][1].append((word[len(open_) - 1], state, n))

    @staticmethod
    def follow(state: tuple, number: int, rest: str) -> tuple[tuple | None, int]:
        for c in rest:
            arc = state[1].get(c)
            if arc is None:
                return None, 0
            state = arc[0]
            number += arc[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with ``word[:exact]`` and differ from ``word`` by one letter after it."""
        out: set[int] = set()
        state, number = self.follow(self.start, 0, word[:exact])
        for at in range(exact, len(word) + 1):
            if state is None:
                break
            own, after = word[at : at + 1], word[at + 1 : at + 2]
            ends = []
            if own:  # a letter deleted
                ends.append(self.follow(state, number, word[at + 1 :]))
            for c, (to, passed) in state[1].items():
                if own and c != own and (not after or after in to[1]):  # a letter replaced
                    ends.append(self.follow(to, number + passed, word[at + 1 :]))
                if not own or own in to[1]:  # a letter inserted
                    ends.append(self.follow(to, number + passed, word[at:]))
            out.update(k for end, k in ends if end is not None and end[0])
            state, number = self.follow(state, number, own) if own else (None, 0)
        return out


_NEAR = "word string, n long, n_near long, best_n long, best string"
_Row = tuple[str, int, int, int, int, int]


def _solve(back: bool, rows: list[_Row]) -> pa.RecordBatch:
    """One automaton of all words of the rows; each row of a word of its group's query length asks it.

    Other groups' words stand in it too, so what is found must share both exact ends.
    """
    counts = {r[0][::-1] if back else r[0]: r[1] for r in rows}
    names = sorted(counts)
    automaton = Automaton(names)
    out: list[tuple] = []
    for word, n, q_len, before, behind, apart in rows:
        if len(word) != q_len:
            continue
        found = [names[k] for k in automaton.one_error(word[::-1] if back else word, behind if back else before)]
        near = [(-counts[d], d[::-1] if back else d) for d in found]
        if before and back or behind and not back or apart:
            near = [x for x in near if x[1].startswith(word[:before]) and x[1].endswith(word[q_len - behind :]) and (not apart or x[1][:apart] != word[:apart])]
        best = min(near, default=(None, None))
        out.append((word, n, len(near), None if best[0] is None else -best[0], best[1]))
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["word", "n", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by direction and group; an automaton holds whole groups."""
    rows: list[_Row] = []
    group: tuple | None = None
    for b in batches:
        for back, q_len, before, behind, key, word, n, apart in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            here = (back, q_len, before, behind, key)
            if here != group:
                if rows and (len(rows) >= FILL or back != group[0]):
                    yield _solve(group[0], rows)
                    rows = []
                group = here
            rows.append((word, n, q_len, before, behind, apart))
    if rows:
        yield _solve(group[0], rows)


_GROUP = ["back", "q_len", "before", "behind", "key"]


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: once with the first half of its unknown middle taken as exact, once with the last half.

    ``before`` and ``behind`` are the exact code points at the two ends; ``apart``
    is where the first half ended when the last one was taken: words that agree
    with the query up to there are the other row's.
    """
    middle = F.col("q_len") - F.col("before") - F.col("behind")
    first = F.floor(middle / 2).cast("int")
    end = F.col("before") + first
    sides = F.array(
        F.struct(F.lit(False).alias("back"), end.alias("before"), F.col("behind").alias("behind"), F.col("apart").alias("apart")),
        F.struct(F.lit(True).alias("back"), F.col("before").alias("before"), (F.col("behind") + middle - first).alias("behind"), end.alias("apart")),
    )
    cut = rows.select("word", "n", "q_len", F.explode(sides).alias("s")).select("word", "n", "q_len", "s.back", "s.before", "s.behind", "s.apart")
    length = F.length("word")
    cut = cut.filter(length >= F.col("before") + F.col("behind"))
    key = F.xxhash64(F.substr("word", F.lit(1), F.col("before")), F.substr("word", length - F.col("behind") + 1, F.col("behind")))
    return cut.withColumn("key", key)


def _groups(counted: DataFrame, hot: int) -> DataFrame:
    """Near words of every word by group; groups of more than ``hot`` rows are cut while more than one code point of the middle is unknown."""
    length = F.length("word")
    rows = counted.select("word", "n", F.explode(F.sequence(F.greatest(length - 1, F.lit(LEAST_LENGTH)), length + 1)).alias("q_len"))
    rows = rows.select("*", F.lit(0).alias("before"), F.lit(0).alias("behind"), F.lit(0).alias("apart"))
    out = None
    while True:
        rows = _halved(rows)
        large = materialise(rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("__n")).filter((F.col("__n") > hot) & (F.col("q_len") - F.col("before") - F.col("behind") > 1)).select(*_GROUP), "spelling-large")
        done = large.isEmpty()
        small = rows if done else rows.join(large, _GROUP, "left_anti")
        dealt = small.repartition(*_GROUP).sortWithinPartitions(*_GROUP).select(*_GROUP, "word", "n", "apart")
        found = in_slices(dealt, _search, _NEAR, 4096)
        out = found if out is None else out.unionByName(found)
        if done:
            return out
        rows = rows.join(large, _GROUP, "left_semi")


def near(counted: DataFrame, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n of word, n."""
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    each = _groups(counted, hot).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    fits = -F.col("b.less") >= FORM_TIMES * F.col("n")
    return each.select("word", "n", "n_near", F.when(fits, F.col("b.best")).alias("form"), F.when(fits, -F.col("b.less")).alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root of word, form: each round a word's root becomes that of its root, so paths halve; at most log2(log2(count)) rounds."""
    roots = materialise(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        further = materialise(roots.join(on, "root", "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved")), "spelling-roots")
        roots = further.drop("__moved")
        if further.filter("__moved").isEmpty():
            return roots


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    counted = materialise(words(docs), "spelling-words")
    each = materialise(near(counted, hot), "spelling-near")
    roots = _roots(each.filter("form is not null"))
    return each.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
