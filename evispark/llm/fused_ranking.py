"""One ranking from several scores: leximin order of percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.ranks import running_sum
from evispark.session import checkpointed


def score_percentiles(hits: DataFrame, kinds: DataFrame) -> DataFrame:
    """query_id, retriever, chunk_id, percentile in [0, 1]: 1 for the one best chunk of a query and retriever.

    percentile = (chunks worse + half the others that tie) / (chunks - 1), and 1 for a lone
    chunk. Null and NaN scores, null ids and retrievers are left out; of repeated
    (query, retriever, chunk) rows the best score counts. Retrievers that `kinds`
    (retriever, better) doesn't name are taken as higher-is-better.
    """
    lower = kinds.where(F.lower("better") == "lower").select("retriever").distinct().withColumn("_lower", F.lit(True))
    usable = hits.select("query_id", "retriever", "chunk_id", F.col("score").cast("double").alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("retriever").isNotNull())
    good = F.when(F.col("_lower"), -F.col("score")).otherwise(F.col("score")) + F.lit(0.0)  # -0.0 becomes 0.0
    best = checkpointed(usable.join(lower, "retriever", "left").groupBy("query_id", "retriever", "chunk_id").agg(F.max(good).alias("good")))
    values = best.groupBy("query_id", "retriever", "good").agg(F.count("*").alias("same"))
    total = values.groupBy("query_id", "retriever").agg(F.sum("same").alias("n"))
    below = running_sum(values, ["query_id", "retriever"], [F.col("good")], F.col("same"), "below").join(total, ["query_id", "retriever"])
    share = F.when(F.col("n") == 1, 1.0).otherwise((F.col("below") + 0.5 * (F.col("same") - 1)) / (F.col("n") - 1))
    return best.join(below, ["query_id", "retriever", "good"]).select("query_id", "retriever", "chunk_id", share.alias("percentile"))


def leximin_vectors(percentiles: DataFrame) -> DataFrame:
    """query_id, chunk_id, vector (percentiles ascending), n_retrievers.

    A usable retriever of the query that doesn't list the chunk counts as percentile 0.
    """
    percentiles = checkpointed(percentiles)
    lists = percentiles.select("query_id", "retriever").distinct().groupBy("query_id").agg(F.count("*").alias("n_retrievers"))
    own = percentiles.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("percentile")).alias("own"))  # at most a value for each retriever
    pad = F.array_repeat(F.lit(0.0), (F.col("n_retrievers") - F.size("own")).cast("int"))
    return own.join(lists, "query_id").select("query_id", "chunk_id", F.concat(pad, "own").alias("vector"), "n_retrievers")


def leximin_ranking(hits: DataFrame, kinds: DataFrame) -> DataFrame:
    """leximin_vectors with rank from 1: the chunk whose weakest percentile is greatest comes first, then by the next weakest; ties by chunk_id.

    An empty table gives no rows; extra columns are ignored.
    """
    v = leximin_vectors(score_percentiles(hits, kinds))
    ranked = running_sum(v, ["query_id"], [F.col("vector").desc(), F.col("chunk_id")], F.lit(1), "ahead")
    return ranked.withColumn("rank", (F.col("ahead") + 1).cast("long")).drop("ahead")


def majority_first(ranked: DataFrame) -> DataFrame:
    """The rows of a leximin ranking whose chunk is the one best in more than half of the query's retrievers.

    Its ascending vector tells: the percentile in the middle, and so all behind it, is 1.
    """
    return ranked.where(F.element_at("vector", F.ceil(F.col("n_retrievers") / 2).cast("int")) == 1.0)
