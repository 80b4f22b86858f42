"""Fusing ranked lists: reciprocal ranks, round robin, windowed scores, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_lists(hits: DataFrame) -> DataFrame:
    """query_id, retriever, chunk_id, pos from 1: ranks of logged lists made whole.

    Ranks that start at 0, miss or repeat are only an order: rows go by rank (nulls last), then
    chunk_id; of repeated chunks the best rank counts.
    """
    one = hits.where("query_id is not null and retriever is not null and chunk_id is not null").groupBy("query_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id", "retriever").orderBy(F.col("rank").asc_nulls_last(), "chunk_id")
    return one.select("query_id", "retriever", "chunk_id", F.row_number().over(w).alias("pos"))


def rrf(lists: DataFrame, k: int, rrf_k: int = 60, width: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best by the sum of 1 / (rrf_k + pos), each list cut at width first.

    Equal sums (to 9 digits) go by the first list that holds the chunk (in the order of retriever names), then its place there.
    """
    own = lists.where(F.col("pos") <= width) if width else lists
    fused = own.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (rrf_k + F.col("pos"))).alias("score"), F.min(F.struct("retriever", "pos")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def interleave(lists: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, retriever, rank: round robin over the lists, each chunk at its earliest turn."""
    first = lists.groupBy("query_id", "chunk_id").agg(F.min(F.struct("pos", "retriever")).alias("turn"))
    w = Window.partitionBy("query_id").orderBy("turn", "chunk_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("turn.retriever").alias("retriever"), "rank")


def pool_quota(lists: DataFrame, k: int) -> DataFrame:
    """query_id, retriever, chunks: how many of the k interleaved places each list filled."""
    return interleave(lists, k).groupBy("query_id", "retriever").agg(F.count("*").alias("chunks"))


def fuse_lists(lists: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank of a query's lists (query_id, retriever, chunk_id, pos, score): reciprocal ranks fuse several; a single list keeps its own order and scores, which tell a sure hit from a weak one."""
    number = lists.groupBy("query_id").agg(F.countDistinct("retriever").alias("_lists"))
    raw = lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("_raw"))
    fused = rrf(lists, k, rrf_k).join(number, "query_id").join(raw, ["query_id", "chunk_id"])
    return fused.select("query_id", "chunk_id", F.when(F.col("_lists") == 1, F.col("_raw")).otherwise(F.col("score")).alias("score"), "rank")


def fuse_pools(pools: DataFrame, k: int, how: str = "rrf", rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank of the pools (query_id, retriever: the pool, chunk_id, pos) of a question's sub-questions, by reciprocal ranks or round robin (interleave); k places for each pool the question has. An unknown way raises."""
    width = pools.groupBy("query_id").agg((F.countDistinct("retriever") * k).alias("_width"))
    if how == "rrf":
        fused = rrf(pools, 2**31 - 1, rrf_k)
    elif how == "interleave":
        fused = interleave(pools, 2**31 - 1).select("query_id", "chunk_id", F.lit(None).cast("double").alias("score"), "rank")
    else:
        raise ValueError(f"unknown fusion: {how}")
    return fused.join(width, "query_id").where(F.col("rank") <= F.col("_width")).drop("_width")


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by a new score; equal ones keep their order (pos)."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "pos")
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def passage_windows(words: Column, budget: int) -> Column:
    """Windows of budget words at a stride of half of it; the last one reaches the end."""
    stride = max(1, budget // 2)
    last = F.greatest(F.ceil((F.size(words) - budget) / stride).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * stride + 1, budget))


def windowed_max(pairs: DataFrame, question: Column, passage: Column, budget: int) -> Column:
    """Greatest share of the question's distinct words in any window of the passage; a scorer that needs no model."""
    q = F.array_distinct(question)
    shares = F.transform(passage_windows(passage, budget), lambda w: F.size(F.array_intersect(q, w)) / F.size(q))
    return F.when(F.size(q) > 0, F.array_max(shares))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, n, same_place, same_set: shares over the shorter of the two lists' k first."""
    ka, kb = (x.where(F.col("pos") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("l")).select("query_id", F.col("l.chunk_id").alias(c)) for x, c in ((a, "a"), (b, "b")))
    n = F.least(F.size("a"), F.size("b"))
    same = F.size(F.filter(F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: x == y), lambda x: x))
    both = F.size(F.array_intersect(F.slice("a", 1, n), F.slice("b", 1, n)))
    return ka.join(kb, "query_id").select("query_id", n.alias("n"), (same / n).alias("same_place"), (both / n).alias("same_set"))
