"""Fusing and re-ranking result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Ranks up to FIRST weigh (0.75, 0.25), from LAST on (0.40, 0.60), linear between.
FIRST, LAST, HEAD, TAIL = 3, 11, (0.75, 0.25), (0.40, 0.60)


def reciprocal_rank(lists: DataFrame, key: list[str], by: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists (list_no, rank from 1, key...).

    A row's score is the sum of 1 / (k + rank) over its places, repeats within a
    list too; equal scores keep the order of first appearance.  Adds score,
    first_list, first_rank and rank.  Without ``by`` all rows are ranked in one
    task: for the few hits of one search.
    """
    by = by or []
    place = F.struct("list_no", "rank")
    fused = lists.groupBy(*by, *key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(place).alias("__first"))
    fused = fused.select(*by, *key, "score", F.col("__first.list_no").alias("first_list"), F.col("__first.rank").alias("first_rank"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "first_list", "first_rank", *key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


#: Characters of an item's content that tell it from others of its path.
KEY_CHARS = 40


def knowledge_key(project: Column, source: Column, path: Column, content: Column) -> Column:
    """What counts as one knowledge item when rankings are fused."""
    return F.concat(project, F.lit(":"), source, F.lit(":"), path, F.lit(":"), F.substring(content, 1, KEY_CHARS))


def fetch_count(k: int, rerank: bool) -> int:
    """Rows to fetch before re-ranking: five times k, at most 500."""
    return min(5 * k, 500) if rerank else k


def blend(candidates: DataFrame, top_k: int, by: list[str]) -> DataFrame:
    """Position-aware blend of retrieval rank and re-rank score.

    candidates: group columns, chunk_id, rank (from 1), rerank (missing: 0).
    The rank is scaled to 1..0 over the list, the re-rank score to its range
    (all 1 where they are equal); weights follow the rank.
    """
    group = Window.partitionBy(*by)
    n, low, high = F.count(F.lit(1)).over(group), F.min("__s").over(group), F.max("__s").over(group)
    scored = candidates.withColumn("__s", F.coalesce(F.col("rerank"), F.lit(0.0)))
    place = F.when(n > 1, 1 - (F.col("rank") - 1) / (n - 1)).otherwise(1.0)
    scaled = F.when(high - low < 1e-10, 1.0).otherwise((F.col("__s") - low) / (high - low))
    t = (F.col("rank") - FIRST) / (LAST - FIRST)
    weight = [F.when(F.col("rank") <= FIRST, HEAD[i]).when(F.col("rank") >= LAST, TAIL[i]).otherwise(HEAD[i] + t * (TAIL[i] - HEAD[i])) for i in (0, 1)]
    out = scored.withColumn("score", F.round(weight[0] * place + weight[1] * scaled, 9)).drop("__s")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "rank")
    return out.withColumn("new_rank", F.row_number().over(order).cast("long")).filter(F.col("new_rank") <= top_k)


def mean_reciprocal_rank(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: mrr and n_queries.  relevant (query_id, chunk_id); a query without a hit in k counts 0."""
    first = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    queries = relevant.select("query_id").distinct()
    return queries.join(first, "query_id", "left").agg(F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))


def precision_at(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query_id, hits, relevant, precision: hits in the first k over the number of relevant rows."""
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    return total.join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), "relevant", F.round(F.coalesce("hits", F.lit(0)) / F.col("relevant"), 9).alias("precision"))


def hit_at(ranked: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """One row: n_queries, and the share of them that have a relevant row among the first k."""
    hit = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("__h", F.lit(1))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.coalesce("__h", F.lit(0))), 9).alias("share"))


def recall_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of truth's (query_id, chunk_id) that ``found`` has."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("__hit")).distinct()
    both = truth.join(hit, ["query_id", "chunk_id"], "left").agg(F.count("__hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return both.select("hits", "total", F.round(F.col("hits") / F.col("total"), 6).alias("recall"))


def lexical_scores(candidates: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank, rerank of candidates (query_id, chunk_id, rank): the share of the query's words in the whole passage, a deterministic stand-in for a cross-encoder."""
    from .retrieval import tokens

    asked = queries.select("query_id", F.array_distinct(tokens(F.coalesce("query", F.lit("")))).alias("__q"))
    words = rows.select("chunk_id", F.array_distinct(tokens(F.coalesce("content", F.lit("")))).alias("__w"))
    share = F.size(F.array_intersect("__q", "__w")) / F.greatest(F.size("__q"), F.lit(1))
    return candidates.join(words, "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", "rank", share.alias("rerank"))


def lexical_reranker(hits: DataFrame, query: str) -> DataFrame:
    """chunk_id, rerank: ``lexical_scores`` as a search's re-ranker."""
    one = hits.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    return lexical_scores(hits.select(F.lit(0).alias("query_id"), "chunk_id", "rank"), hits, one).select("chunk_id", "rerank")


def logit_reranker(score, remote: bool = False):  # noqa: ANN001, ANN201
    """A re-ranker from ``score(hits, query)``, which gives chunk_id and logits array<double> of a cross-encoder."""

    def rerank(hits: DataFrame, query: str) -> DataFrame:
        return score(hits, query).select("chunk_id", score_of_logits(F.col("logits")).alias("rerank"))

    rerank.remote = remote
    return rerank


def score_of_logits(logits: Column) -> Column:
    """One logit is the score; of two or more it is the second's softmax; what is not finite counts 0."""
    top = F.array_max(logits)
    spread = F.transform(logits, lambda x: F.exp(x - top))
    soft = F.try_element_at(spread, F.lit(2)) / F.aggregate(spread, F.lit(0.0), lambda s, x: s + x)
    score = F.when(F.size(logits) == 1, F.try_element_at(logits, F.lit(1))).otherwise(soft)
    return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)
