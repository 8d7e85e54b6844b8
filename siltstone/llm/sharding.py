"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Of a uniform permutation of N rows, the number that goes from one source block
to one target block is hypergeometric once the sizes of both are fixed.  So the
matrix of these counts is drawn first, row by row without replacement from what
the targets still hold (``communication_matrix``).  Then every source block is
permuted by itself and cut by its row of the matrix, the pieces are exchanged,
and every target block is permuted again; a row's slot is its target's first slot
plus its place there.  Shard sizes are exact by construction: N // shards rows, one
more in the first N % shards shards.

Source blocks are partitions of the input's scan, folded to ``SOURCES``; each
shard is ``BLOCKS`` target blocks, so neither side has one task a shard and the
matrix is SOURCES * 16 * BLOCKS numbers (8 MB), whatever the table's size.  Texts
are read once and never shuffled: their sizes and checksums are.  What is drawn
hangs on the seed and on the positions written with the rows, so a task that runs
again gives the same rows.

Copies of a text are rows like others: a uniform shuffle deals them alike over
the shards.  Defined results: every row is dealt, also rows that repeat an id or
text or have a null id; a null text has size 1 and checksum 0, as an empty one;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, materialise

SHARDS, SEED = 16, 12
#: Source blocks at most, and target blocks of a shard.
SOURCES, BLOCKS = 1024, 64
#: Populations from which numpy's hypergeometric draws end.
_NUMPY_LIMIT = 1_000_000_000


def target_sizes(rows: int, shards: int, blocks: int = BLOCKS) -> np.ndarray:
    """Rows of each target block, shard by shard; both levels at most one apart."""
    shard = rows // shards + (np.arange(shards) < rows % shards)
    return (shard[:, None] // blocks + (np.arange(blocks)[None, :] < shard[:, None] % blocks)).astype(np.int64).ravel()


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` of ``good + bad`` things, taken without replacement, are good; for populations of any size.

    Each thing is taken with the same probability; given how many that makes, they
    are a uniform choice.  What is too few is drawn from the things left, what is too
    many is drawn back from those taken: about the root of the number, so few rounds.
    """
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    share = drawn / (good + bad)
    g, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    left = drawn - g - b
    if abs(left) <= 64:  # one by one
        for _ in range(abs(left)):
            from_good, of = (good - g, good - g + bad - b) if left > 0 else (g, g + b)
            hit = int(rng.integers(of)) < from_good
            step = 1 if left > 0 else -1
            g, b = (g + step, b) if hit else (g, b + step)
        return g
    return g + hypergeometric(rng, good - g, bad - b, left) if left > 0 else g - hypergeometric(rng, g, b, -left)


def communication_matrix(sources: list[int], targets: np.ndarray, seed: int) -> np.ndarray:
    """Rows from each source to each target block, as a uniform permutation has them; both margins are kept."""
    rng = np.random.Generator(np.random.Philox(seed))
    left = targets.astype(np.int64).copy()
    out = np.zeros((len(sources), len(left)), dtype=np.int64)
    for i, n in enumerate(sources):
        if left.sum() < _NUMPY_LIMIT:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, want = int(left.sum()), n
            for j, size in enumerate(left.tolist()):
                rest -= size
                out[i, j] = taken = hypergeometric(rng, size, rest, want)
                want -= taken
        left -= out[i]
    return out


def _cut(sources: dict[int, int], matrix: np.ndarray):
    """Rows sorted by source and random key get the target whose piece of the source they stand in."""
    ends = np.cumsum(matrix, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, place = None, 0
        for b in batches:
            at = b.column(0).to_numpy()
            target = np.empty(len(at), dtype=np.int32)
            edges = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True):
                if lo == hi:
                    continue
                if at[lo] != source:
                    source, place = at[lo], 0
                target[lo:hi] = np.searchsorted(ends[sources[int(source)]], np.arange(place, place + hi - lo), side="right")
                place += hi - lo
            yield pa.RecordBatch.from_arrays([pa.array(target), *b.columns[1:]], names=["target", *b.schema.names[1:]])

    return run


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("pos"), (F.spark_partition_id() % SOURCES).alias("source"))
    rows = materialise(slim, "sharding-rows")
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()}  # at most SOURCES
    total = sum(counts.values())
    sizes = target_sizes(total, shards)
    matrix = communication_matrix(list(counts.values()), sizes, seed)

    columns = ["pos", "doc_id", "size", "text_crc32"]
    local = rows.repartition("source").sortWithinPartitions("source", F.xxhash64("pos", F.lit(seed)), "pos").select("source", *columns)
    dealt = in_slices(local, _cut({s: i for i, s in enumerate(counts)}, matrix), "target int, pos long, doc_id long, size long, text_crc32 long", 1 << 16)
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.xxhash64("pos", F.lit(seed + 1)), "pos")) - 1
    shard, block = F.floor(F.col("target") / BLOCKS).cast("int"), F.col("target") % BLOCKS
    held = F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)
    first = block * F.floor(held / BLOCKS) + F.least(block, held % BLOCKS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), (first + place).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
