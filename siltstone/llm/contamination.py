"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Items are partitioned by size: class k holds items of 2**k to 2**(k+1) - 1
distinct shingles of five words.  For each class a document is seen as windows
of 2**(k+3) shingles that overlap by half, so any passage of an item's length
(or stretched to four times the class's lower bound) lies whole in one window,
and containment of 0.8 means a Jaccard similarity of at least 0.8 / 8.2 with
that window, whatever the document's length.  A candidate is a (window, item)
pair that agrees in at least one of ``HASHES`` MinHash values; at the threshold
a pair is missed with probability below (1 - 0.097)**64 = 0.15 %.

Signatures of windows are evaluated lazily.  A window can agree with an item in
hash i only at a shingle that is that item's minimum, so document shingles are
first joined with the items' minima, and the window's minimum is computed only
where a shingle hit.  The candidates are the same as with all signatures.
Candidates are verified by exact containment of the item's shingle texts.

Words are lower-case runs of letters and digits.  Defined results: null and
empty texts have no shingles, items under five words match nothing, rows of one
id are one document whose shingles are those of all its texts (for such ids
every item with a hit is a candidate, as its shingles need not share a window),
rows with a null id give no result, extra columns are ignored, empty tables
give no rows.  An item whose words lie scattered over more than four times its
size in a document stands in no window whole and can be missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORDS, THRESHOLD, HASHES = 5, 0.8, 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(w: Column) -> Column:
    """0-based starts of the shingles of a word array."""
    n = F.size(w) - (WORDS - 1)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingle_texts(w: Column) -> Column:
    return F.transform(_places(w), lambda i: F.array_join(F.slice(w, i + 1, WORDS), " "))


def shingle_hashes(w: Column) -> Column:
    return F.transform(_places(w), lambda i: F.xxhash64(F.slice(w, i + 1, WORDS)))


def _minhash(h: Column, i: Column) -> Column:
    """The i-th hash function of a shingle hash."""
    return F.xxhash64(h, i)


def _signatures(items: DataFrame) -> DataFrame:
    """item_id, k (size class), i, low (i-th MinHash), h (the shingle hash that gives it)."""
    one = items.select("item_id", F.array_distinct(shingle_hashes(F.col("__w"))).alias("__h")).filter(F.size("__h") > 0)
    one = one.withColumn("k", F.floor(F.log2(F.size("__h").cast("double"))).cast("int"))
    each = one.select("item_id", "k", F.explode("__h").alias("h")).select("item_id", "k", "h", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("i"))
    least = each.groupBy("item_id", "k", "i").agg(F.min(F.struct(_minhash(F.col("h"), F.col("i")).alias("low"), F.col("h").alias("h"))).alias("m"))
    return least.select("item_id", "k", "i", "m.low", "m.h")


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of the pairs at or over the threshold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("__w")).filter("doc_id is not null")
    queries = materialise(items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("__w")).filter("item_id is not null").distinct(), "contamination-items")
    signatures = materialise(_signatures(queries), "contamination-signatures")

    # Shingles of documents that are some item's minimum: the planner broadcasts the minima only while they are small.
    minima = materialise(signatures.select("h").distinct(), "contamination-minima")
    hits = texts.select("doc_id", F.explode(shingle_hashes(F.col("__w"))).alias("h")).join(minima, "h", "left_semi")
    hit = materialise(hits.groupBy("doc_id").agg(F.collect_set("h").alias("__hits")), "contamination-hits")

    # The texts with a hit, once; then, around each hit, does the window's i-th minimum equal the item's?
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(hit.hint("merge"), "doc_id")
    near = materialise(found.select("doc_id", "__hits", words(F.col("text")).alias("__w")), "contamination-texts")
    at = F.filter(F.transform("__h", lambda h, p: F.struct(p.alias("p"), h.alias("h"))), lambda x: F.array_contains("__hits", x["h"]))
    hashed = near.select("doc_id", "__hits", shingle_hashes(F.col("__w")).alias("__h"))
    places = hashed.select("doc_id", F.explode(at).alias("__x")).select("doc_id", "__x.p", "__x.h")
    step = F.call_function("shiftleft", F.lit(1), F.col("k") + 2)
    last = F.floor(F.col("p") / step).cast("int")
    asked = places.join(signatures, "h").select("doc_id", "item_id", "k", "i", "low", F.explode(F.array_distinct(F.array(F.greatest(last - 1, F.lit(0)), last))).alias("w"))
    per_doc = asked.groupBy("doc_id", "k", "w").agg(F.collect_set(F.struct("item_id", "i", "low")).alias("__asked"))
    window = F.array_distinct(F.slice("__h", F.col("w") * step + 1, step * 2))
    agree = F.filter("__asked", lambda a: F.array_min(F.transform("__win", lambda h: _minhash(h, a["i"]))) == a["low"])
    windows = hashed.join(per_doc.hint("merge"), "doc_id").select("doc_id", "__asked", window.alias("__win"))
    candidates = windows.select("doc_id", F.explode(F.array_distinct(F.transform(agree, lambda a: a["item_id"]))).alias("item_id"))
    several = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("doc_id")
    of_several = hit.join(several, "doc_id", "left_semi").select("doc_id", F.explode("__hits").alias("h")).join(signatures.select("h", "item_id"), "h").select("doc_id", "item_id")
    candidates = materialise(candidates.unionByName(of_several).distinct(), "contamination-candidates")

    # Exact containment of shingle texts.
    items_of = queries.select("item_id", F.array_distinct(shingle_texts(F.col("__w"))).alias("__q")).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("__q"))).alias("__q"))
    docs_of = near.select("doc_id", F.array_distinct(shingle_texts(F.col("__w"))).alias("__d"))
    both = candidates.join(items_of, "item_id").join(docs_of.hint("merge"), "doc_id")
    shared = both.select("doc_id", "item_id", F.size("__q").cast("long").alias("n_shingles"), F.explode(F.array_intersect("__q", "__d")).alias("__s"))
    counted = shared.groupBy("doc_id", "item_id", "n_shingles").agg(F.count_distinct("__s").alias("n_shared"))
    return counted.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6)).filter(F.col("n_shared") >= threshold * F.col("n_shingles")).select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows with a null id stay."""
    found = materialise(search(docs, items, threshold).select(F.col("doc_id").alias("__id")).distinct(), "contamination-found")
    return docs.join(found.hint("merge"), docs["doc_id"].cast("long") == found["__id"], "left_anti")
