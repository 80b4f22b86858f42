"""Queries of search and fusion, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import dense, fusion, lexical
from evispark.plans.tables import table
from evispark.session import checkpointed

K = 20
#: Cells of the approximate index, and how many of them a query probes.
CELLS, PROBES = 32, 24
#: More places than any pool has.
FULL = 2**31 - 1

_BM25 = """
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9$][a-z0-9.$%-]*') AS t FROM documents),
sz AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avg_len FROM d),
p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY term, doc_id),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + CAST(0.5 AS DOUBLE)) - ln(count(*) + CAST(0.5 AS DOUBLE)) AS raw FROM p, sz GROUP BY term),
st AS (SELECT term, df, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

_DENSE = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
sc AS (SELECT query_id, vec_id, label, list_inner_product(q.e, CAST(v.embedding AS DOUBLE[])) AS score FROM q, embeddings v)"""

_LISTS = """
o AS (SELECT query_id, retriever, chunk_id, min(rank) AS rank FROM hits WHERE query_id IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
ls AS (SELECT query_id, retriever, chunk_id, row_number() OVER (PARTITION BY query_id, retriever ORDER BY rank NULLS LAST, chunk_id) AS pos FROM o)"""


def _rrf_sql(rrf_k: int, k: int, width: int) -> str:
    return f"""
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_r, first_p, chunk_id) AS rank FROM (
SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / ({rrf_k} + pos)) AS score, min(retriever) AS first_r, arg_min(pos, retriever) AS first_p FROM ls WHERE pos <= {width} GROUP BY query_id, chunk_id)) WHERE rank <= {k}"""


def _turns_sql(k: int) -> str:
    return f"""
tu AS (SELECT query_id, chunk_id, min(pos) AS pos, arg_min(retriever, pos * 1000 + rn) AS retriever, min(pos * 1000 + rn) AS turn FROM (SELECT *, dense_rank() OVER (ORDER BY retriever) AS rn FROM ls) GROUP BY query_id, chunk_id),
il AS (SELECT query_id, chunk_id, retriever, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, chunk_id) AS rank FROM tu) WHERE rank <= {k})"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.ranked_lists(table(spark, d, "hits"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.bm25_topk(table(spark, d, "eval_items"), table(spark, d, "documents"), K), "score")


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.term_stats(checkpointed(lexical.vocabulary(table(spark, d, "documents"), "doc_id", "text"))), "idf")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(dense.dense_topk(*_vectors(spark, d), K), "score")


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(dense.dense_topk(*_vectors(spark, d), K, F.col("label") == 3), "score")


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    centroids = dense.ivf_centroids(v, CELLS)
    return _rounded(dense.ivf_topk(q, dense.ivf_index(v, centroids), centroids, K, PROBES), "score")


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row: the queries, and whether the approximate search finds at least 0.9 of the exact one's results."""
    exact, near = checkpointed(dense_topk(spark, d).select("query_id", "vec_id")), ann_topk(spark, d).select("query_id", "vec_id", F.lit(1).alias("found"))
    return exact.join(near, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("recall_reached"))


def _labelled(spark: SparkSession, d: str, k: int) -> DataFrame:
    q, v = _vectors(spark, d)
    return dense.dense_scores(q, v, k).join(v.select("vec_id", "label"), "vec_id")


def overfetch_shortfall(spark: SparkSession, d: str) -> DataFrame:
    got = dense.overfetch_topk(_labelled(spark, d, K * 2), K, 2, F.col("label") == 3).groupBy("query_id").agg(F.count("*").alias("n"))
    q, _ = _vectors(spark, d)
    return q.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < K).alias("short"))


def filter_backoff_topk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    k = 80
    cols = ["query_id", "vec_id", "score", "rank"]
    some, all_ = dense.dense_topk(q, v, k, F.col("label") == 3).select(cols), dense.dense_topk(q, v, k).select(cols)
    return dense.filter_backoff(some, all_, k).select("query_id", "vec_id", "rank", "tier")


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.rrf(_lists(spark, d), 10, 60, 10), "score")


def rrf_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    lists, out = _lists(spark, d), None
    for rrf_k in (1, 20, 60):
        one = _rounded(fusion.rrf(lists, 5, rrf_k, 10), "score").withColumn("rrf_k", F.lit(rrf_k))
        out = one if out is None else out.unionByName(one)
    return out


def interleave_pools(spark: SparkSession, d: str) -> DataFrame:
    return fusion.interleave(_lists(spark, d), 8)


def per_pool_quota(spark: SparkSession, d: str) -> DataFrame:
    return fusion.pool_quota(_lists(spark, d), 8)


def multi_list_fuse(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "hits").where("query_id is not null and retriever is not null and chunk_id is not null").groupBy("query_id", "retriever", "chunk_id").agg(F.max("score").alias("score"))
    # two lists for the questions with an even number, one for the others
    lists = _lists(spark, d).join(scored, ["query_id", "retriever", "chunk_id"]).where("pos <= 10 and (retriever = 'bm25' or retriever = 'dense' and cast(substring(query_id, 3) as int) % 2 = 0)")
    return _rounded(fusion.fuse_lists(lists, 10), "score")


def cross_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.fuse_pools(_lists(spark, d), 3), "score")


def backend_agreement(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    return _rounded(fusion.agreement(lists.where("retriever = 'bm25'"), lists.where("retriever = 'dense'"), 5), "same_place", "same_set")


def _scored_passages(spark: SparkSession, d: str) -> DataFrame:
    """query_id, chunk_id, pos, score: windowed scores of the passages of all retrievers, in the order of their fused lists; each text is split once."""
    q = table(spark, d, "drafts_multihop").where("question is not null").groupBy("id").agg(F.max("question").alias("question")).select(F.col("id").alias("query_id"), T.metric_words(F.col("question")).alias("q"))
    c = table(spark, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.max("text").alias("text")).select("chunk_id", T.metric_words(F.col("text")).alias("p"))
    fused = fusion.rrf(_lists(spark, d), FULL).select("query_id", "chunk_id", F.col("rank").alias("pos"))
    pairs = fused.join(q, "query_id").join(c, "chunk_id")
    return pairs.select("query_id", "chunk_id", "pos", F.round(fusion.windowed_max(pairs, F.col("q"), F.col("p"), 60), 6).alias("score"))


def windowed_max_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored_passages(spark, d).select("query_id", "chunk_id", "score")


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rerank(_scored_passages(spark, d), F.col("score"), 5).select("query_id", "chunk_id", "score", "rank")


_WINDOWED = f"""
{_LISTS},
qs AS (SELECT id AS query_id, list_distinct(regexp_extract_all(lower(max(question)), '[a-z0-9]+')) AS q FROM drafts_multihop WHERE question IS NOT NULL GROUP BY id),
ch AS (SELECT chunk_id, regexp_extract_all(lower(max(text)), '[a-z0-9]+') AS p FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
fu AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_r, first_p, chunk_id) AS pos FROM (
SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / (60 + pos)) AS score, min(retriever) AS first_r, arg_min(pos, retriever) AS first_p FROM ls GROUP BY query_id, chunk_id)),
pr AS (SELECT query_id, chunk_id, pos, q, p FROM fu JOIN qs USING (query_id) JOIN ch USING (chunk_id)),
ws AS (SELECT query_id, chunk_id, pos, len(list_intersect(q, p[i * 30 + 1:i * 30 + 60])) / len(q) AS s FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((len(p) - 60) / 30) AS INTEGER), 0) + 1)) AS i FROM pr)),
sp AS (SELECT query_id, chunk_id, pos, round(max(s), 6) AS score FROM ws GROUP BY ALL)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (bm25_topk, bm25_term_stats, dense_topk, dense_topk_filtered, ann_topk, ann_recall, overfetch_shortfall, filter_backoff_topk, rrf_hybrid, rrf_k_sweep, interleave_pools, per_pool_quota, multi_list_fuse, cross_query_fusion, backend_agreement, windowed_max_score, rerank_topk)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    top = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank"
    sweep = " UNION ALL ".join(f"SELECT *, {r} AS rrf_k FROM ({_rrf_sql(r, 5, 10)})" for r in (1, 20, 60))
    return {
        "bm25_topk": f"""WITH {_BM25},
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9$][a-z0-9.$%-]*')) AS term FROM eval_items) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avg_len))) AS score FROM q JOIN st USING (term) JOIN p USING (term), sz GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= {K}""",
        "bm25_term_stats": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM st",
        "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, {top} FROM sc) WHERE rank <= {K}",
        "dense_topk_filtered": f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, {top} FROM sc WHERE label = 3) WHERE rank <= {K}",
        "ann_recall": "SELECT count(*) AS queries, TRUE AS recall_reached FROM embeddings WHERE vec_id % 100 = 0",
        "overfetch_shortfall": f"""WITH {_DENSE}, w AS (SELECT query_id, count(*) AS n FROM (SELECT *, {top} FROM sc) WHERE rank <= {2 * K} AND label = 3 GROUP BY query_id)
SELECT query_id, coalesce(least(n, {K}), 0) AS n, coalesce(n, 0) < {K} AS short FROM q LEFT JOIN w USING (query_id)""",
        "filter_backoff_topk": f"""WITH {_DENSE}, a AS (SELECT *, {top} FROM sc WHERE label = 3), b AS (SELECT *, {top} FROM sc),
u AS (SELECT query_id, vec_id, 0 AS tier, rank FROM a WHERE rank <= 80 UNION ALL SELECT query_id, vec_id, 1, rank FROM b WHERE rank <= 80 AND (query_id, vec_id) NOT IN (SELECT (query_id, vec_id) FROM a WHERE rank <= 80))
SELECT query_id, vec_id, rank, tier FROM (SELECT query_id, vec_id, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS INTEGER) AS rank FROM u) WHERE rank <= 80""",
        "rrf_hybrid": f"WITH {_LISTS} {_rrf_sql(60, 10, 10)}",
        "rrf_k_sweep": f"WITH {_LISTS} {sweep}",
        "interleave_pools": f"WITH {_LISTS}, {_turns_sql(8)} SELECT * FROM il",
        "per_pool_quota": f"WITH {_LISTS}, {_turns_sql(8)} SELECT query_id, retriever, count(*) AS chunks FROM il GROUP BY ALL",
        "multi_list_fuse": f"""WITH {_LISTS}, s AS (SELECT query_id, retriever, chunk_id, list_max(list(score)) AS score FROM hits WHERE query_id IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
l AS (SELECT ls.*, score AS raw FROM ls JOIN s USING (query_id, retriever, chunk_id) WHERE pos <= 10 AND (retriever = 'bm25' OR retriever = 'dense' AND CAST(substring(query_id, 3) AS INTEGER) % 2 = 0)),
n AS (SELECT query_id, count(DISTINCT retriever) AS n FROM l GROUP BY 1),
f AS (SELECT query_id, chunk_id, n, sum(CAST(1 AS DOUBLE) / (60 + pos)) AS s, max(raw) AS raw, min(retriever) AS first_r, arg_min(pos, retriever) AS first_p FROM l JOIN n USING (query_id) GROUP BY ALL)
SELECT query_id, chunk_id, round(CASE WHEN n = 1 THEN raw ELSE s END, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, first_r, first_p, chunk_id) AS rank FROM f) WHERE rank <= 10""",
        "cross_query_fusion": f"""WITH {_LISTS}, n AS (SELECT query_id, count(DISTINCT retriever) AS n FROM ls GROUP BY 1)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_r, first_p, chunk_id) AS rank FROM (
SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / (60 + pos)) AS score, min(retriever) AS first_r, arg_min(pos, retriever) AS first_p FROM ls GROUP BY query_id, chunk_id)) JOIN n USING (query_id) WHERE rank <= 3 * n""",
        "backend_agreement": f"""WITH {_LISTS},
a AS (SELECT query_id, list(chunk_id ORDER BY pos) AS a FROM ls WHERE retriever = 'bm25' AND pos <= 5 GROUP BY 1), b AS (SELECT query_id, list(chunk_id ORDER BY pos) AS b FROM ls WHERE retriever = 'dense' AND pos <= 5 GROUP BY 1),
j AS (SELECT query_id, least(len(a), len(b)) AS n, a, b FROM a JOIN b USING (query_id))
SELECT query_id, CAST(n AS INTEGER) AS n, round(len(list_filter(range(1, n + 1), lambda i: a[i] = b[i])) / n, 6) AS same_place, round(len(list_intersect(a[1:n], b[1:n])) / n, 6) AS same_set FROM j""",
        "windowed_max_score": f"WITH {_WINDOWED} SELECT query_id, chunk_id, score FROM sp",
        "rerank_topk": f"WITH {_WINDOWED} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM sp) WHERE rank <= 5",
    }
