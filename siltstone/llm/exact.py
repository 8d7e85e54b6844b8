"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its normalised UTF-8 bytes read as a polynomial, taken
at one point modulo each of two primes, beside its length.  Chunk hashes are
computed on their own and combine by length-shifted arithmetic
(``H(ab) = H(a) * r**len(b) + H(b)``), so a huge document needs no state but one
number a prime.  Texts of equal fingerprint are then compared chunk by chunk
with the group's first document: chunks stream through a join, and a group's
members are spread over tasks whatever its size.

Defined results: a null text counts as empty; every input row gives one row,
repeated rows too; null ids never stand for a group that has another id; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, materialise

#: (prime, point) of the two polynomials.
MODULI = ((2147483647, 1103515245), (2147483629, 1664525013))
#: Bytes of a hashed chunk: byte * power sums over one stay below 2**64.
CHUNK = 4096
#: Characters of a compared chunk.
COMPARED = 1 << 16

_SPACES = re.compile("[\x20\x09-\x0d]+")


def normalise(text: str | None) -> str:
    """Each run of ASCII white space becomes one space."""
    return _SPACES.sub(" ", text or "")


def _powers(prime: int, point: int) -> np.ndarray:
    out = np.empty(CHUNK, dtype=np.uint64)
    x = 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * point % prime
    return out


_POWERS = [_powers(*m) for m in MODULI]


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (h1, h2, length) of two neighbouring parts, from theirs."""
    h = [(x * pow(r, b[2], p) + y) % p for x, y, (p, r) in zip(a[:2], b[:2], MODULI, strict=True)]
    return h[0], h[1], a[2] + b[2]


def fingerprint(raw: bytes) -> tuple[int, int, int]:
    """(h1, h2, length): hashes of all whole chunks at once, folded by ``combine`` with the rest."""
    data = np.frombuffer(raw, dtype=np.uint8)
    whole = len(data) // CHUNK
    out = (0, 0, 0)
    for start in range(0, whole, 256):
        block = data[start * CHUNK : min(whole, start + 256) * CHUNK].reshape(-1, CHUNK).astype(np.uint64)
        hashes = [(block @ pw) % np.uint64(p) for pw, (p, _) in zip(_POWERS, MODULI, strict=True)]
        for h1, h2 in zip(*hashes, strict=True):
            out = combine(out, (int(h1), int(h2), CHUNK))
    rest = data[whole * CHUNK :].astype(np.uint64)
    if len(rest):
        h1, h2 = (int(rest @ pw[-len(rest) :]) % p for pw, (p, _) in zip(_POWERS, MODULI, strict=True))
        out = combine(out, (h1, h2, len(rest)))
    return out


#: Gives (h1, h2, length) of some bytes.
Hash = Callable[[bytes], tuple[int, int, int]]

_DIGEST = "doc_id long, h1 long, h2 long, n_bytes long, text_sha256 string"


def digests(docs: DataFrame, hashed: Hash = fingerprint) -> DataFrame:
    """doc_id, h1, h2, n_bytes, text_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [normalise(t).encode() for t in b.column(1).to_pylist()]
            f = [hashed(r) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([x[i] for x in f], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())],
                names=["doc_id", "h1", "h2", "n_bytes", "text_sha256"],
            )

    return in_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _DIGEST)


def _chunks(members: DataFrame, hashed: Hash) -> DataFrame:
    """One row per compared chunk of a member's text; rows of another text under the same id are passed over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: list[list] = [[] for _ in range(7)]
            size = 0
            for doc_id, text, rep, h1, h2, n in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                norm = normalise(text)
                if hashed(norm.encode()) != (h1, h2, n):
                    continue
                for k in range(max(1, -(-len(norm) // COMPARED))):
                    part = norm[k * COMPARED : (k + 1) * COMPARED]
                    for column, value in zip(kept, (doc_id, rep, h1, h2, n, k, part), strict=True):
                        column.append(value)
                    size += len(part)
                    if size > 1 << 22:
                        yield _batch(kept)
                        kept, size = [[] for _ in range(7)], 0
            yield _batch(kept)

    def _batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "rep", "h1", "h2", "n_bytes", "k", "part"])

    return in_slices(members.select("doc_id", "text", "rep", "h1", "h2", "n_bytes"), run, "doc_id long, rep long, h1 long, h2 long, n_bytes long, k long, part string", 64)


def dedup(docs: DataFrame, hashed: Hash = fingerprint) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Only digests are grouped, with partial sums before the shuffle.  Before a join
    brings a group's figures back to its members they are dealt out anew, so that
    both sides of the join are plain exchanges and a group of a third of all rows
    is split by the engine's skew handling.  Joins
    with texts are sort-merge joins at every size.  A member whose chunks differ from the group's first document
    (two texts of one fingerprint) is grouped anew by its SHA-256.
    """
    key = ["h1", "h2", "n_bytes"]
    all_digests = materialise(digests(docs, hashed), "exact-digests")
    shared = all_digests.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("doc_id").alias("rep")).filter("__n > 1 and rep is not null").drop("__n").hint("rebalance")
    each = all_digests.filter("doc_id is not null").select("doc_id", *key).distinct()
    members = materialise(each.join(shared.hint("merge"), key).select("doc_id", "rep", *key), "exact-members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.hint("merge"), "doc_id")
    chunks = materialise(_chunks(texts, hashed), "exact-chunks")
    first = chunks.filter("doc_id = rep").select("rep", *key, "k", F.col("part").alias("rep_part")).dropDuplicates(["rep", *key, "k"]).hint("rebalance")
    unequal = materialise(chunks.filter("doc_id <> rep").join(first.hint("merge"), ["rep", *key, "k"], "left").filter("not (part <=> rep_part)").select("doc_id", *key, F.lit(True).alias("__apart")).distinct(), "exact-unequal")
    classed = all_digests.join(unequal, ["doc_id", *key], "left").withColumn("__sub", F.when(F.col("__apart"), F.col("text_sha256")).otherwise(""))
    groups = classed.groupBy(*key, "__sub").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).hint("rebalance")
    return classed.join(groups.hint("merge"), [*key, "__sub"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; rows that repeat the id and text of one that stays are that document again and stay too."""
    gone = materialise(dedup(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")), "exact-gone")
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)
    rest = docs.withColumn("__t", sha).join(gone.distinct().hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__t") == F.col("__sha")), "left_anti")
    return rest.drop("__t")
