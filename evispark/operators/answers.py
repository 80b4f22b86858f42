"""Answer tables: context blocks, selection for judging, judge means, differences, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.evaluation import refused


def context_blocks(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, context: "[S1] (ticker or source form date, section)" and text of each hit by rank, with blank lines between. A context is one prompt: its hits are few."""
    own = hits.where(F.col("rank") <= limit) if limit else hits
    head = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("ticker", "source", F.lit("")), F.lit(" "), F.coalesce("form", F.lit("")), F.lit(" "), F.coalesce("date", F.lit("")), F.lit(", "), F.coalesce("section", F.lit("")), F.lit(")\n"), F.coalesce("text", F.lit("")))
    return own.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"))


def cited_sources(answer: Column, hits: Column) -> Column:
    """The hits (array of structs) whose marks the answer cites."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1))
    return F.filter(F.transform(hits, lambda h, i: F.struct((i + 1).alias("mark"), h.alias("hit"))), lambda x: F.array_contains(marks, x["mark"].cast("string")))


def selection_reason(kind: Column, answer: Column, contexts: Column, reference: Column) -> Column:
    """Why a record isn't judged, the first of: negative, empty, refused, no contexts, no reference; null if it is."""
    blank = lambda c: ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))
    return (
        F.when(kind.isin("unanswerable", "out_of_scope"), "negative").when(blank(answer), "empty").when(refused(answer), "refused")
        .when(F.coalesce(contexts, F.lit(0)) == 0, "no contexts").when(blank(reference), "no reference")
    )


def judge_means(scores: DataFrame, group: str, score: str) -> DataFrame:
    """group, mean, n_scored, n_failed: NaN is a failed call, left out and counted; null was never asked."""
    x = F.col(score).cast("double")
    return scores.groupBy(group).agg(F.avg(F.when(~F.isnan(x), x)).alias("mean"), F.count_if(x.isNotNull() & ~F.isnan(x)).alias("n_scored"), F.count_if(F.coalesce(F.isnan(x), F.lit(False))).alias("n_failed"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, before, after of the fields that differ between two versions, null-safe."""
    o, n = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields]), new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("before"), F.col(f"n_{f}").alias("after")) for f in fields])
    return o.join(n, key).select(key, F.explode(F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x")).select(key, "x.*")


def full_grid(cells: DataFrame, axes: list[str], value: Column, name: str) -> DataFrame:
    """Every combination of the axes' values with the aggregated value, null (never 0) where there is no cell. The axes are configurations, so the grid is small."""
    have = cells.groupBy(*axes).agg(value.alias(name))
    grid = reduce(lambda a, b: a.crossJoin(b), [cells.select(a).where(F.col(a).isNotNull()).distinct() for a in axes])
    return grid.join(have, axes, "left")


def retrieval_latency(total: Column, retrieval: Column, retrieve_only: Column) -> Column:
    """Retrieval latency, for older retrieve-only runs the combined one."""
    return F.coalesce(retrieval, F.when(retrieve_only, total))


def flatten_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, chunk_id, score (to 4 digits), doc_id, ticker, date, section, text of each hit; chunks has a row for each chunk_id. Only the hits' texts are read on."""
    own = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "doc_id", "ticker", "date", "section", F.coalesce("text", F.lit("")).alias("text"))
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score")).join(own, "chunk_id", "left").select("query_id", "rank", "chunk_id", "score", "doc_id", "ticker", "date", "section", "text")
