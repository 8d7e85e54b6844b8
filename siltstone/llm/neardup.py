"""Near-duplicate documents by Order MinHash.

A document is its sequence of words (lower-case runs of letters and digits).
Its k-mers are runs of two words (of one word in a short text), each labelled
with the number of its occurrence, so repeats stay distinct.  For each of
``SKETCHES`` permutations the ``ELL`` least k-mers are kept *in the order of the
text*; two documents share a sketch with a probability that falls with their
edit distance.  Candidates are verified by banded alignment of the words: edit
distance at most 20 % of the longer document.

Equal word sequences collapse to one representative first.  Documents that
share a sketch stand in one bucket, and every pair of a bucket is decided:

* each member is aligned with the bucket's leaders (the least id, the member
  that meets most others over all buckets, the least hash), which joins nearly
  all that belongs together;
* buckets whose members then still stand in different classes are dealt out as
  pairs of bounded blocks, whatever their size.  In such a cell only pairs of
  different classes are looked at, exact lower bounds of the edit distance
  (lengths, counts of hashed words and of hashed word pairs) dismiss nearly all
  of them at once, and the rest is aligned.  Only links leave the cell.

The classes are the connected components of the verified links.

Defined results: null and empty texts have no words and form no class with
anything but each other; every row gives one row, repeated rows too; where rows of
one id have different texts each text has links and a class of its own, so these
rows can differ in class_id; a row with a null id is a class of its own (class_id
null); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_slices, materialise

SIMILARITY = 0.8
#: Permutations, and k-mers kept for each.
SKETCHES, ELL = 48, 3
#: Texts of at least PAIRED words have k-mers of two words, texts of at most SINGLE words (also) of one: two texts within the bound have a kind in common.
PAIRED, SINGLE = 16, 25
#: Distinct words whose hashes a worker remembers before it starts afresh, and table cells that it permutes at once.
CACHE_ENTRIES, CELLS = 100_000, 1 << 19
#: Members and words of a block of a bucket.
BLOCK, BLOCK_WORDS = 256, 500_000
#: Slots of the counts that bound a distance.
SLOTS = 256

_WORD = re.compile(r"[^\W_]+")
_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Hashes()


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _hashed(w: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, w), dtype=np.uint64, count=len(w))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


#: Permutation j takes x to x * _TIMES[j] + _PLUS[j], modulo 2**64.
_TIMES = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_PLUS = _mix(_TIMES)


def labelled_kmers(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each k-mer and the number of its occurrence, in text order."""
    n = max(1, len(h) - size + 1) if len(h) else 0
    kmer = np.zeros(n, dtype=np.uint64)
    for j in range(min(size, len(h))):
        kmer = kmer * _BASE + h[j : j + n]
    order = np.argsort(kmer, kind="stable")
    ranked = kmer[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = (np.arange(n) - start).astype(np.uint64)
    return _mix(kmer + occurrence * _MIX2)


def sketches(h: np.ndarray) -> np.ndarray:
    """For each permutation, a hash of its least labelled k-mers in text order; ``SKETCHES`` for each size of k-mers that the text has."""
    sizes = [2] * (len(h) >= PAIRED) + [1] * (0 < len(h) <= SINGLE)
    return np.concatenate([np.zeros(0, np.uint64), *(_sketched_by(labelled_kmers(h, size), size) for size in sizes)])


def _sketched_by(kmers: np.ndarray, size: int) -> np.ndarray:
    out, ell = np.empty(SKETCHES, dtype=np.uint64), min(ELL, len(kmers))
    step = max(1, CELLS // len(kmers))
    for at in range(0, SKETCHES, step):
        to = min(SKETCHES, at + step)
        permuted = kmers[None, :] * _TIMES[at:to, None] + _PLUS[at:to, None]
        each, least = np.arange(to - at), np.empty((to - at, ell), dtype=np.int64)
        for j in range(ell):
            least[:, j] = permuted.argmin(axis=1)
            permuted[each, least[:, j]] = _MOST
        least.sort(axis=1)
        value = np.full(to - at, size, dtype=np.uint64)
        for j in range(ell):
            value = value * _BASE + kmers[least[:, j]]
        out[at:to] = _mix(value ^ _TIMES[at:to])
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or ``most + 1`` if it is larger; a band that doubles until it holds the path."""
    n = min(len(a), len(b))
    if n:
        apart = np.flatnonzero(a[:n] != b[:n])
        head = int(apart[0]) if len(apart) else n
        a, b = a[head:], b[head:]
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(apart[0]) if len(apart) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(b) - len(a) > most:
        return min(len(b), most + 1)
    # No alignment can keep more words than the two sequences share.
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if len(b) - int(np.minimum(ca[ia], cb[ib]).sum()) > most:
        return most + 1
    long, short = b.tolist(), a.tolist()
    band = min(most, max(64, len(long) - len(short)))
    while True:
        d = _banded(long, short, band, most)
        if d <= band or band >= most:
            return min(d, most + 1)
        band = min(most, 4 * band)


def _banded(long: list[int], short: list[int], band: int, most: int) -> int:
    """The cost of the best alignment that stays within ``band`` of the diagonal; over ``most`` it may stop early.

    A column of the table is held as bits of vertical differences for the rows
    i - band to i + band; the window moves down by one row with each column, so
    a column costs a few operations on numbers of 2 * band + 1 bits.  Costs add
    up along the diagonal that ends at the last cell.
    """
    width = 2 * band + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for j, w in enumerate(long):
        places[w] = places.get(w, 0) | 1 << (j + band)
    last = 1 << (len(long) - len(short) + band)
    plus, minus = full ^ ((1 << band) - 1), 0
    cost = len(long) - len(short)
    for i, w in enumerate(short):
        equal = places.get(w, 0) >> i & full
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        right = minus | (full ^ (diagonal | plus))
        left = diagonal & plus
        if not diagonal & last:
            cost += 1
            if cost > most:
                return cost
        below = diagonal >> 1
        plus = left | (full ^ (below | right))
        minus = below & right
    return cost


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    return edit_distance(a, b, most) <= most


def least_edits(counts: np.ndarray, others: np.ndarray, share: int) -> np.ndarray:
    """Lower bounds of the edit distances between one text and others, from counts of what hashes to each slot; an edit moves at most ``share`` of them."""
    apart = others.astype(np.int32) - counts
    return -(-np.maximum(np.where(apart > 0, apart, 0).sum(axis=1), np.where(apart < 0, -apart, 0).sum(axis=1)) // share)


def _slots(h: np.ndarray) -> np.ndarray:
    """Counts by slot of words, and of neighbouring pairs."""
    pairs = _mix(h[:-1] * _BASE + h[1:]) if len(h) else h
    return np.concatenate([np.bincount((x & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS) for x in (_mix(h), pairs)]).astype(np.int32)


class _Classes(dict):
    """Classes that links found in a cell have joined."""

    def root(self, c: int) -> int:
        while c in self:
            c = self[c]
        return c


def undecided_links(ids: list[int], classes: list[int], block: np.ndarray, places: np.ndarray, words: list[np.ndarray], at: int, cross: bool) -> list[tuple[int, int]]:
    """Links between members of different classes of a cell; of texts that share several buckets only the first one's cell decides.

    places: the sketches of each member; at: the place that this bucket is for;
    cross: members of two blocks, of which only pairs across count.  A pair whose
    classes have been joined here needs no alignment.
    """
    joined, out = _Classes(), []
    n = np.array([len(w) for w in words])
    counts = np.stack([_slots(w) for w in words])
    of = np.array(classes)
    for x in range(len(ids) - 1):
        y = np.arange(x + 1, len(ids))
        most = ((1 - SIMILARITY) * np.maximum(n[y], n[x]) + 1e-9).astype(np.int64)
        near = (of[y] != of[x]) & (np.abs(n[y] - n[x]) <= most)
        if cross:
            near &= block[y] != block[x]
        y, most = y[near], most[near]
        if not len(y):
            continue
        first = (places[y] == places[x]).argmax(axis=1) == at
        y, most = y[first], most[first]
        close = (least_edits(counts[x, :SLOTS], counts[y, :SLOTS], 1) <= most) & (least_edits(counts[x, SLOTS:], counts[y, SLOTS:], 2) <= most)
        for k in y[close]:
            a, b = joined.root(classes[x]), joined.root(classes[k])
            if a != b and similar(words[x], words[k]):
                joined[max(a, b)] = min(a, b)
                out.append((max(ids[x], ids[k]), min(ids[x], ids[k])))
    return out


_SKETCH = "doc_id long, t long, k1 long, k2 long, n int, sketches array<long>"


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(f.view(np.int64) for f in found)]), pa.int64()))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, found = [], [], []
        for text in b.column(1).to_pylist():
            w = words(text)
            d = hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest()
            keys.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
            sizes.append(len(w))
            found.append(sketches(_hashed(w)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int32()), _lists(found)], names=["doc_id", "t", "k1", "k2", "n", "sketches"])
    _known.clear()  # an idle worker must not hold memory that the next step needs


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, last_words = None, None
    for b in batches:
        a, c = [], []
        for x, y, tx, ty in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if y != last:
                last, last_words = y, _hashed(words(ty))
            if similar(_hashed(words(tx)), last_words):
                a.append(x)
                c.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
    _known.clear()


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _lists([_hashed(words(t)) for t in b.column(1).to_pylist()])], names=["rep", "words"])
    _known.clear()


def _decided(cell: pa.Table) -> pa.Table:
    """a, b: the links of one cell (``undecided_links``); its rows hold rep, class_id, place, block, x, y, sketches and words."""
    rows = cell.combine_chunks()
    at, x, y = (rows.column(c)[0].as_py() for c in ("place", "x", "y"))
    longs = [[v.values.to_numpy().view(np.uint64) for v in rows.column(c)] for c in ("sketches", "words")]
    # Texts with k-mers of one size only, and those with both, keep their sketches at different places.
    places = np.repeat(np.arange(rows.num_rows, dtype=np.uint64)[:, None], 2 * SKETCHES, axis=1)
    for i, (s, w) in enumerate(zip(*longs, strict=True)):
        start = 0 if len(w) >= PAIRED else SKETCHES
        places[i, start : start + len(s)] = s
    links = undecided_links(rows.column("rep").to_pylist(), rows.column("class_id").to_pylist(), rows.column("block").to_numpy(), places, longs[1], at, x != y)
    return pa.table([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _texts_of(rows: DataFrame, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """rep, text: one row for each of the asked representatives; a text is found by its row's id and hash."""
    named = texts.select("rep", F.col("doc").alias("doc_id"), "t").join(asked.hint("merge"), "rep", "left_semi")
    return rows.join(named.hint("merge"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("rep", "text")


def _inner_links(rows: DataFrame, texts: DataFrame, shared: DataFrame, label: DataFrame) -> DataFrame:
    """a, b: links between members of one bucket that the leaders left in different classes."""
    spark = rows.sparkSession
    classed = shared.join(label.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("bucket", "place", "rep", "n", F.coalesce("class_id", "rep").alias("class_id"))
    classed = materialise(classed, "near-classed")
    mixed = classed.groupBy("bucket").agg(F.min("class_id").alias("__x"), F.max("class_id").alias("__y"), F.count(F.lit(1)).alias("__m"), F.sum("n").alias("__w"))
    # Of two members one is a leader: that pair has been aligned.
    mixed = mixed.filter("__x < __y and __m > 2").select("bucket", F.greatest(F.ceil(F.col("__m") / BLOCK), F.ceil(F.col("__w") / BLOCK_WORDS)).cast("int").alias("blocks")).hint("rebalance")
    left = materialise(classed.join(mixed.hint("merge"), "bucket").select("bucket", "place", "rep", "class_id", "blocks"), "near-open")
    asked = left.select("rep").distinct()
    some = in_slices(_texts_of(rows, texts, asked), _hash_lists, "rep long, words array<long>")
    some = materialise(some.join(texts.select("rep", "sketches").hint("merge"), "rep"), "near-open-words")
    block = F.pmod(F.xxhash64("rep", F.lit(9)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = left.select("bucket", "place", "rep", "class_id", block.alias("block"), other.alias("__o")).select("*", F.least("block", "__o").alias("x"), F.greatest("block", "__o").alias("y")).drop("__o")
    met = cells.join(some.hint("merge"), "rep").select("bucket", "place", "x", "y", "rep", "class_id", "block", "sketches", "words")
    links = materialise(met.groupBy("bucket", "x", "y").applyInArrow(_decided, "a long, b long"), "near-inner")
    discard(spark, classed, left, some)
    return links


def _links(rows: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts of the representatives that stand in pairs are read once."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    some = materialise(_texts_of(rows, texts, asked), "near-pair-texts")
    side = pairs.join(some.select(F.col("rep").alias("a"), F.col("text").alias("__ta")).hint("merge"), "a").join(some.select(F.col("rep").alias("b"), F.col("text").alias("__tb")).hint("merge"), "b")
    links = materialise(in_slices(side.select("a", "b", "__ta", "__tb"), _aligned, "a long, b long"), "near-aligned")
    discard(rows.sparkSession, some)
    return links


def components(links: DataFrame) -> DataFrame:
    """id, class_id (least id) of the vertices of ``links`` (a, b).

    Each round every vertex takes its least neighbour as parent, parents are
    followed to their roots by doubling, and the links are drawn anew between
    roots; only roots that still have links go on.
    """
    spark = links.sparkSession
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-links")
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).select("id", F.least("id", "p").alias("p")), "near-parents")
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("root"))
            jumped = materialise(parent.join(up, "p").select("id", F.col("root").alias("p"), (F.col("root") != F.col("p")).alias("moved")), "near-parents")
            still = jumped.filter("moved").isEmpty()
            discard(spark, parent)
            parent = jumped
            if still:
                break
        if label is None:
            label = parent.select("id", F.col("p").alias("class_id"))
        else:
            new = parent.select(F.col("id").alias("class_id"), F.col("p").alias("__p"))
            label = materialise(label.join(new, "class_id", "left").select("id", F.coalesce("__p", "class_id").alias("class_id")), "near-labels")
        ends = edges.join(parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        left = materialise(ends.filter("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "near-links")
        discard(spark, edges)
        edges = left
        if edges.isEmpty():
            discard(spark, edges)
            return label


def _least_ids(label: DataFrame, texts: DataFrame) -> DataFrame:
    """id, class_id: each class named by the least document id among its texts' instead of its least representative."""
    ids = materialise(label.join(texts.select(F.col("rep").alias("id"), "doc").hint("merge"), "id"), "near-classes")
    least = materialise(ids.groupBy("class_id").agg(F.min("doc").alias("least")), "near-least")
    return ids.join(least, "class_id").select("id", F.col("least").alias("class_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the class's least id), kept: one row per input row."""
    return _classed(docs).drop("t")


def _classed(docs: DataFrame) -> DataFrame:
    """``classes`` with the hash of the row's text, t."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    key = ["k1", "k2"]
    sketched = materialise(in_slices(rows, _sketched, _SKETCH), "near-sketches")
    first = F.min(F.struct("doc_id", "t"))
    texts = sketched.filter("doc_id is not null").groupBy(*key).agg(first.alias("f"), F.min("n").alias("n"), F.min("sketches").alias("sketches"))
    texts = materialise(texts.select(*key, F.col("f.doc_id").alias("doc"), F.col("f.t").alias("t"), "n", "sketches"), "near-texts")
    # A text is represented by its least document; texts that would share one, by a hash of their own.
    twins = materialise(texts.groupBy("doc").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select("doc", F.lit(True).alias("__twin")), "near-twins")
    texts = texts.join(twins, "doc", "left").withColumn("rep", F.when(F.col("__twin"), F.xxhash64(*key)).otherwise(F.col("doc"))).drop("__twin")

    # Buckets of two texts or more; a sketch's place tells its permutation and the size of its k-mers.
    place = F.col("i") + F.when(F.col("n") < PAIRED, SKETCHES).otherwise(0)
    keyed = texts.select("rep", "n", F.posexplode("sketches").alias("i", "s")).select("rep", "n", place.alias("place"), F.xxhash64(place, "s").alias("bucket"))
    full = keyed.groupBy("bucket").agg(F.min("rep").alias("__x"), F.max("rep").alias("__y"), F.count(F.lit(1)).alias("size")).filter("__x < __y").select("bucket", "size").hint("rebalance")
    met = materialise(keyed.join(full.hint("merge"), "bucket"), "near-met")
    many = met.groupBy("rep").agg(F.sum("size").alias("others"))
    shared = materialise(met.join(many.hint("merge"), "rep").select("bucket", "place", "rep", "n", "others"), "near-shared")
    discard(spark, met)

    # Each member with its leaders.
    mixed = F.xxhash64("rep")
    leaders = shared.groupBy("bucket").agg(
        F.min(F.struct("rep", "n")).alias("l1"), F.max(F.struct("others", mixed.alias("h"), "rep", "n")).alias("l2"), F.min(F.struct(mixed.alias("h"), "rep", "n")).alias("l3")
    )
    leaders = leaders.select("bucket", F.array(*(F.struct(F.col(f"{c}.rep").alias("rep"), F.col(f"{c}.n").alias("n")) for c in ("l1", "l2", "l3"))).alias("leaders")).hint("rebalance")
    led = shared.join(leaders.hint("merge"), "bucket").select("rep", "n", F.explode(F.array_distinct("leaders")).alias("l"))
    led = led.filter((F.col("rep") != F.col("l.rep")) & (F.abs(F.col("n") - F.col("l.n")) <= (1 - SIMILARITY) * F.greatest("n", "l.n") + 1e-9))
    pairs = materialise(led.select(F.greatest("rep", "l.rep").alias("a"), F.least("rep", "l.rep").alias("b")).distinct(), "near-pairs")
    links = _links(rows, texts, pairs)
    discard(spark, pairs)
    label = components(links)

    # What the leaders left in different classes.
    more = _inner_links(rows, texts, shared, label)
    if not more.isEmpty():
        label = components(links.unionByName(more))
    label = _least_ids(label, texts)
    of_text = texts.select("rep", "doc", *key).join(label.hint("merge"), F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("class_id", "doc").alias("class_id")).hint("rebalance")
    named = sketched.select("doc_id", "t", *key).join(of_text.hint("merge"), key, "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return named.select("doc_id", "t", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row of least id; of rows of one id with different texts each by its own class."""
    gone = materialise(_classed(docs).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct(), "near-gone")
    return docs.join(gone.hint("merge"), (docs["doc_id"].cast("long") == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__t"]), "left_anti")
