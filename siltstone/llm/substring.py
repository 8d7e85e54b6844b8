"""Substring deduplication over words by level-wise doubling.

Level one looks at windows of seven words, level two at twice that length cut
to the wanted thirteen.  Only windows repeated at the first length are extended:
a window of thirteen can start in two documents only if its seven-word windows
do.  Of a window's seven-word parts the one of least hash is asked, the same one
wherever the window occurs, so level one handles about a quarter of all
positions and loses none.  Beyond thirteen, ``longest_repeats`` goes on doubling
until no candidate survives.

Documents of the same word sequence are first collapsed to the one of smallest
id; the others are covered whole by it.  Counting is by partial aggregation
keyed by window hash; joins that bring the smallest id back to the windows have
plain exchanges on both sides, so a passage of a third of all documents is split
by the engine's skew handling.  Level one uses 64-bit hashes (a collision there
only lets a candidate through), level two 96 bits: of 10**13 windows no two are
then likely to meet by chance.

Defined results: a null text has no words; every input row gives one row; rows
that repeat an id and text give equal rows, and where such texts differ the
marks of all of them hold by position in each; a row with a null id is never
earlier and loses nothing; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_slices, materialise

#: Words of a window, and of the windows of the level before.
LENGTH, HALF = 13, 7
#: Distinct words whose hashes a worker remembers before it starts afresh.
CACHE_ENTRIES = 400_000

_B1, _B2, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Hashes()


def split(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8; bytes.split() parts at 0x20 and 0x09-0x0D, no other white space."""
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def window_hashes(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash for each window of ``length`` word hashes: a polynomial in ``base``, mixed."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(length):
        out = out * base + h[j : j + n]
    return _mixed(out)


def anchors(h: np.ndarray, length: int = LENGTH, half: int = HALF) -> np.ndarray:
    """For each window of ``length`` words, the least hash of its windows of ``half`` words."""
    part = window_hashes(h, half, _B1)
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = part[:n]
    for j in range(1, length - half + 1):
        out = np.minimum(out, part[j : j + n])
    return out


def _key(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_long(np.concatenate(parts)) if parts else np.empty(0, np.int64), pa.int64()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sets = [], []
        for text in b.column(1).to_pylist():
            words = split(text)
            keys.append(_key(words))
            sets.append(np.unique(anchors(word_hashes(words))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _lists(sets)], names=["doc_id", "k1", "k2", "anchors"])


def _second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of thirteen whose anchor survived; ``later`` if a smaller id has the anchor."""
    names, types = ["w1", "w2", "doc_id", "start", "later"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]

    def batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    for b in batches:
        out: list[list[np.ndarray]] = [[] for _ in names]
        size = 0
        for doc_id, text, first, later in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            h = word_hashes(split(text))
            least = _long(anchors(h))
            behind = np.isin(least, later.values.to_numpy())
            starts = np.flatnonzero(behind | np.isin(least, first.values.to_numpy()))
            w2 = (window_hashes(_mixed(h), LENGTH, _B2)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for column, values in zip(out, (_long(window_hashes(h, LENGTH, _B1)[starts]), w2, np.full(len(starts), doc_id), starts.astype(np.int32), behind[starts]), strict=True):
                column.append(values)
            size += len(starts)
            if size > 1 << 16:
                yield batch(out)
                out, size = [[] for _ in names], 0
        if size:
            yield batch(out)


def _extended(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(extended, standing, copies): the documents that stand for their word sequence with the anchors that level one lets
    through, and the written table that they are read from; ids of documents covered whole by one of smaller id."""
    spark = docs.sparkSession
    level1 = materialise(in_slices(_rows(docs), _first_level, "doc_id long, k1 long, k2 long, anchors array<long>"), "substring-level1")
    key = ["k1", "k2"]
    first = level1.groupBy(*key).agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last")).filter("__first < __last").hint("rebalance")
    copies = materialise(level1.select("doc_id", *key).join(first.hint("merge"), key).filter("doc_id > __first").select("doc_id").distinct(), "substring-copies")

    # An anchor survives if two different word sequences have it.
    seen = level1.filter("doc_id is not null").select("doc_id", "k1", F.explode("anchors").alias("h"))
    repeated = seen.groupBy("h").agg(F.min("k1").alias("__a"), F.max("k1").alias("__b"), F.min("doc_id").alias("__first")).filter("__a < __b").select("h", "__first")
    repeated = materialise(repeated, "substring-repeated")
    discard(spark)
    alive = seen.select("doc_id", "h").join(repeated.hint("merge"), "h")
    per_doc = alive.groupBy("doc_id").agg(F.collect_set(F.when(F.col("doc_id") == F.col("__first"), F.col("h"))).alias("__own"), F.collect_set(F.when(F.col("doc_id") > F.col("__first"), F.col("h"))).alias("__later"))
    standing = materialise(per_doc.join(copies.hint("merge"), "doc_id", "left_anti"), "substring-alive")
    discard(spark, level1, repeated)
    extended = _rows(docs).join(standing.hint("merge"), "doc_id").select("doc_id", "text", "__own", "__later")
    return extended, standing, copies


def _levels(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, least, copies): windows of thirteen that level one lets through, of the documents that stand for their
    word sequence; the least id of each that two of them have; ids of documents covered whole by one of smaller id."""
    spark = docs.sparkSession
    extended, standing, copies = _extended(docs)
    windows = materialise(in_slices(extended, _second_level, "w1 long, w2 int, doc_id long, start int, later boolean"), "substring-level2")
    discard(spark, standing)

    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("__a"), F.max("doc_id").alias("__b")).filter("__a < __b").drop("__b")
    least = materialise(least, "substring-least")
    discard(spark)
    return windows, least, copies


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, copies).

    windows: doc_id, starts of the windows of thirteen that also start in a
    document of smaller id, for the documents that stand for their word
    sequence; copies: doc_id of documents covered whole by one of smaller id.
    """
    windows, least, copies = _levels(docs)
    later = windows.filter("later").select("w1", "w2", "doc_id", "start").join(least.hint("merge"), ["w1", "w2"]).filter("doc_id > __a")
    covered = materialise(later.groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "substring-covered")
    discard(docs.sparkSession, windows, least)
    return covered, copies


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of thirteen whose anchor survived, of a document in one row."""
    for b in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for text, first, later in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            h = word_hashes(split(text))
            least = _long(anchors(h))
            starts = np.flatnonzero(np.isin(least, later.values.to_numpy()) | np.isin(least, first.values.to_numpy()))
            w2 = window_hashes(_mixed(h), LENGTH, _B2)[starts] >> np.uint64(32)
            for column, values in zip(out, (starts.astype(np.uint64), window_hashes(h, LENGTH, _B1)[starts], w2), strict=True):
                column.append(values)
        starts, w1, w2 = map(_lists, out)
        yield pa.RecordBatch.from_arrays([b.column(0), starts.cast(pa.list_(pa.int32())), w1, w2], names=["doc_id", "starts", "w1", "w2"])


def doubled(starts: np.ndarray, w1: np.ndarray, w2: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(length, places among ``starts``, w1, w2) of the windows of 13, 26, 52, ... words of which all parts of thirteen are
    given; a window's hash is made from its halves', w1 from their w1 alone."""
    length, place = LENGTH, np.arange(len(starts))
    while len(place):
        yield length, place, w1, w2
        here = starts[place]
        at = np.minimum(np.searchsorted(here, here + length), len(here) - 1)
        left = np.flatnonzero(here[at] == here + length)
        right = at[left]
        a, b = w1[left], w1[right]
        if w2 is not None:
            w2 = _mixed(a * _B2 + _mixed(b ^ _MIX) + w2[left] * _B1 + w2[right] * _MIX) >> np.uint64(32)
        w1 = _mixed(_mixed(a) * _B1 + b + np.uint64(length))
        place, length = place[left], 2 * length


def _values(cell: pa.ListScalar, kind: type) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _all_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of every length: w1, w2, doc_id; each once for a document and length."""
    for b in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for i, doc_id in enumerate(b.column(0).to_pylist()):
            w1, w2 = (_values(b.column(c)[i], np.int64).view(np.uint64) for c in (2, 3))
            for _, _, x, y in doubled(_values(b.column(1)[i], np.int64), w1, w2):
                one = np.unique(x, return_index=True)[1]
                for column, values in zip(out, (_long(x[one]), y[one].astype(np.uint32).view(np.int32), np.full(len(one), doc_id)), strict=True):
                    column.append(values)
                size += len(one)
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "doc_id"])
                    out, size = [[], [], []], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "doc_id"])


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, length from a document's texts (starts, w1) and the w1 of the windows that no other document has."""
    for b in batches:
        for doc_id, texts, alone in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            gone = _values(alone, np.int64).view(np.uint64) if alone.is_valid else np.zeros(0, np.uint64)
            starts, lengths = [], []
            for text in texts:
                own = _values(text["starts"], np.int64)
                longest = np.zeros(len(own), np.int32)
                for length, place, w1, _ in doubled(own, _values(text["w1"], np.int64).view(np.uint64), None):
                    longest[place[~np.isin(w1, gone)]] = length
                starts.append(own[longest > 0])
                lengths.append(longest[longest > 0])
            start, length = np.concatenate(starts), np.concatenate(lengths)
            if len(starts) > 1:  # texts of one id: the longest at each place
                order = np.lexsort((-length, start))
                first = np.unique(start[order], return_index=True)[1]
                start, length = start[order][first], length[order][first]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), doc_id)), pa.array(start), pa.array(length)], names=["doc_id", "start", "length"])


def longest_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, length: for each window of thirteen that two different texts have, the longest length of 13, 26, 52, ...
    at which the window that begins there is still repeated.

    A window of twice the length is asked only where both its halves passed level
    one; its hash is made from theirs, so no text is read again.  A part of a
    repeated window is repeated, so all lengths are asked in one exchange, and as
    most windows are repeated, only those that no other document has go back to
    theirs.  In one document windows are told apart by 64 bits.
    """
    spark = docs.sparkSession
    extended, standing, _ = _extended(docs)
    rows = materialise(in_slices(extended, _starts, "doc_id long, starts array<int>, w1 array<long>, w2 array<long>"), "substring-starts")
    discard(spark, standing)
    seen = in_slices(rows, _all_levels, "w1 long, w2 int, doc_id long").groupBy("w1", "w2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("__b"))
    alone = materialise(seen.filter("doc_id = __b").select("doc_id", "w1"), "substring-alone")
    discard(spark)
    alone = alone.groupBy("doc_id").agg(F.collect_list("w1").alias("alone"))
    texts = rows.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "w1")).alias("texts"))
    return in_slices(texts.join(alone.hint("merge"), "doc_id", "left").select("doc_id", "texts", "alone"), _longest, "doc_id long, start long, length int")


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that begins at one of the starts."""
    starts = starts[starts < n]
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + LENGTH, n), -1)
    return np.cumsum(marks[:n]) > 0


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts, copy in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            words = split(text)
            if copy and len(words) >= LENGTH:
                rest = []
            elif starts.is_valid and len(starts.values):
                gone = _covered(len(words), starts.values.to_numpy())
                rest = [w for w, g in zip(words, gone, strict=True) if not g]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def strip_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document without the words of its repeated windows."""
    windows, copies = repeated_windows(docs)
    keyed = _rows(docs)
    whole = copies.withColumn("__copy", F.lit(True))
    marked = keyed.join(windows.hint("merge"), "doc_id", "left").join(whole.hint("merge"), "doc_id", "left").select("doc_id", "text", "starts", F.coalesce("__copy", F.lit(False)).alias("__copy"))
    return in_slices(marked, _strip, "doc_id long, n_words long, n_removed long, kept string")


def digests(stripped: DataFrame) -> DataFrame:
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
