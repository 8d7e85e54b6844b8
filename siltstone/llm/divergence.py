"""Source divergence audit by two-dimensional group-block tiling.

A group is a (lang, source).  Each language keeps the terms of at least
``LEAST_DOCS`` of its documents, laid out in vocabulary chunks of about ``CHUNK``
terms; a group's counts in a chunk are one packed vector (places, counts).
Groups are dealt to blocks of about ``BLOCK`` by a hash of the source, and every
vector is replicated to the tiles (own block by other block) of its language.
A tile's task reads its vectors chunk after chunk and adds the distances of all
pairs of its two blocks to one small matrix; ``SPAN`` chunks make one task, so a
language of many terms is many tasks.  Work is groups squared by terms, as the
result asks; no task holds more than two blocks' vectors of one chunk.

Texts are counted in one pass, by dictionaries in the workers before the
shuffle.  All arithmetic is in integers: shares are long divisions in steps of
a thousand, right while a group has under 9 * 10**15 occurrences.

Defined results: null text, lang and source read as empty; rows that repeat an
id are documents each; a group without terms has the same share for each
term; a language without kept terms gives distances of 0; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, materialise

#: Documents of its language that a kept term needs; what is added to each count; parts of the whole; terms reported.
LEAST_DOCS, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a chunk, groups of a block, chunks of a task.
CHUNK, BLOCK, SPAN = 4096, 16, 16
#: Different terms that a worker counts before it hands them on.
HELD = 300_000

#: ASCII letters lowered, bytes of other characters kept, all else a space.
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and other characters beyond ASCII, in UTF-8; only A-Z are lowered."""
    return (text or "").encode().translate(_TERMS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            found = [b"", *n]  # the empty term stands for the group itself
            for k in range(0, len(found), 50_000):
                part = found[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array([t.decode() for t in part]), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms(text)
            size -= len(n)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size > HELD:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs; a row of the empty term for each group."""
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), "text")
    counted = in_slices(rows, _count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms)), in whole numbers."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * wide(n + ADDED), wide(total + ADDED * terms_)) + 1


def shares(counts: np.ndarray, total: int, terms_: int) -> np.ndarray:
    """``share`` over an array: long division with digits of a thousand."""
    below = np.int64(total + ADDED * terms_)
    rest = counts.astype(np.int64) + ADDED
    out = np.zeros(len(counts), dtype=np.int64)
    whole, rest = np.divmod(rest, below)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


_TILE = ["lang", "rows", "columns", "span"]


def _distances(own: list[tuple[str, np.ndarray]], other: list[tuple[str, np.ndarray]] | None) -> np.ndarray:
    """Sums of absolute differences of all pairs of two blocks' vectors."""
    across = np.stack([v for _, v in (own if other is None else other)])
    return np.stack([np.abs(v[None, :] - across).sum(axis=1) for _, v in own])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed vectors sorted by tile, chunk, block and source; gives each tile's pairs with their sums."""
    tile = chunk = None
    held: dict[int, list[tuple[str, np.ndarray]]] = {}
    matrix = names = None

    def add() -> None:
        """The chunk is whole: its distances go to the tile's matrix."""
        nonlocal matrix, names
        own, other = held.get(tile[1], []), None if tile[1] == tile[2] else held.get(tile[2], [])
        names = ([x for x, _ in own], [x for x, _ in (own if other is None else other)])
        if names[0] and names[1]:
            here = _distances(own, other)
            matrix = here if matrix is None else matrix + here

    def out() -> Iterator[pa.RecordBatch]:
        if matrix is None:
            return
        pairs = [(a, b, int(matrix[i, j])) for i, a in enumerate(names[0]) for j, b in enumerate(names[1]) if tile[1] != tile[2] or i < j]
        yield pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(pairs), pa.string()), *(pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))], names=["lang", "a", "b", "value"])

    for b in batches:
        places, counts = b.column(10), b.column(11)
        for r, (lang, rows, columns, span, at, block, source, size, total, kept) in enumerate(zip(*(b.column(i).to_pylist() for i in range(10)), strict=True)):
            if tile != (lang, rows, columns, span) or chunk != at:
                if tile is not None:
                    add()
                if tile != (lang, rows, columns, span):
                    if tile is not None:
                        yield from out()
                    tile, matrix, names = (lang, rows, columns, span), None, None
                chunk, held = at, {}
            vector = np.zeros(size, dtype=np.int64)
            if places[r].is_valid:
                vector[places[r].values.to_numpy()] = counts[r].values.to_numpy()
            held.setdefault(block, []).append((source, shares(vector, total, kept) if size else vector))
    if tile is not None:
        add()
        yield from out()


def _pairs(groups: DataFrame, laid: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of a language's sources."""
    packed = cells.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("v"))
    packed = packed.select("lang", "source", "chunk", F.col("v.place").alias("places"), F.col("v.n").alias("counts"))
    every = groups.join(laid, "lang").join(packed, ["lang", "source", "chunk"], "left")
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    every = every.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = every.select("lang", F.least("block", "other").alias("rows"), F.greatest("block", "other").alias("columns"), F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "block", "source", "size", "total", "terms", "places", "counts")
    dealt = tiles.repartition(*_TILE).sortWithinPartitions(*_TILE, "chunk", "block", "source")
    sums = in_slices(dealt, _tiles, "lang string, a string, b string, value long", 256).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def _best_first(*keys: str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))


def _terms(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of the terms that a group has more of than its language; ranked by chunk first, so a large group is many tasks."""
    shared = cells.join(groups, ["lang", "source"])
    above = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    scored = shared.select("lang", "source", "chunk", F.col("term").alias("item"), above.alias("value")).filter("value > 0").repartition("lang", "source", "chunk")
    some = scored.withColumn("rank", _best_first("lang", "source", "chunk")).filter(F.col("rank") <= TOP)
    return some.drop("chunk").withColumn("rank", _best_first("lang", "source")).filter(F.col("rank") <= TOP)


def audit(docs: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: distances of each group to its language's others, and its foremost terms."""
    counts = materialise(term_counts(docs), "divergence-counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = materialise(kept, "divergence-kept")
    group = counts.filter("term = ''").select("lang", "source")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = group.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(vocabulary, "lang", "left").select("lang", zero("terms"), zero("lang_total"), F.ceil(F.col("sources") / block).cast("int").alias("blocks"))
    langs = materialise(langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk).cast("int"))), "divergence-langs")

    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    placed = kept.join(langs.select("lang", "chunks"), "lang").select("lang", "term", "lang_n", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk")).withColumn("place", place)
    placed = materialise(placed, "divergence-places")
    cells = materialise(counts.filter("term <> ''").select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "divergence-cells")
    sizes = placed.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("size"))
    laid = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(sizes, ["lang", "chunk"], "left").select("lang", "chunk", F.coalesce("size", F.lit(0)).alias("size"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialise(group.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", zero("total"), "terms", "lang_total", "blocks"), "divergence-groups")

    pair = _pairs(groups, laid, cells).withColumn("rank", _best_first("lang", "source"))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return named(pair, "pair").unionByName(named(_terms(groups, cells), "term"))
