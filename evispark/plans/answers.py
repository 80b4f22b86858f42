"""Queries of answer tables and the whole retrieval pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import answers as an
from evispark.operators import fusion, retrieve
from evispark.operators.once import one_row_each
from evispark.plans.evaluation import _ANSWERS, _RECORDS, _answers, _records
from evispark.plans.retrieval import _LISTS
from evispark.plans.tables import table


def retrieve_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set, questions whose number is divisible by 100, against all chunks; sub-questions are those logged last with the answers."""
    q = table(spark, d, "drafts_multihop").where("question is not null and cast(substring(id, 3) as int) % 100 = 0").groupBy("id").agg(F.max("question").alias("question"))
    logged = table(spark, d, "answers").where("id is not null and size(sub_questions) > 1").groupBy("id").agg(F.max_by("sub_questions", F.struct("logged_at", "trace_id")).alias("sub_questions"))
    return retrieve.retrieve(q.join(logged, "id", "left"), table(spark, d, "chunks"))


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    lists = fusion.ranked_lists(table(spark, d, "hits")).where("retriever = 'rerank' and pos <= 5")
    c = table(spark, d, "chunks").where("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("ticker", "source", "form", "date", "section", "text")).alias("x")).select("chunk_id", "x.*")
    return an.context_blocks(lists.withColumnRenamed("pos", "rank").join(c, "chunk_id"))


def flatten_hits(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").where("retriever = 'rerank' and query_id is not null and chunk_id is not null and score is not null and not isnan(score)").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    rest = ["doc_id", "ticker", "date", "section", "text"]
    return an.flatten_hits(h, one_row_each(table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", *rest), "chunk_id", rest))


def answer_selection(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).join(table(spark, d, "hits").groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("contexts")), "id", "left")
    why = an.selection_reason(F.col("type"), F.col("answer"), F.col("contexts"), F.col("ground_truth"))
    return r.groupBy("config", F.coalesce(why, F.lit("judged")).alias("reason")).agg(F.count("*").alias("n"))


def judge_means(spark: SparkSession, d: str) -> DataFrame:
    return an.judge_means(table(spark, d, "hits").where("retriever is not null"), "retriever", "score").withColumn("mean", F.round("mean", 6))


def label_rescore_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "complaints").where("complaint_id is not null")
    order = F.struct("date_received", F.coalesce("company_response", F.lit("")))
    fields = ["company_response", "state"]
    old, new = (c.groupBy("complaint_id").agg(f(F.struct(*fields), order).alias("x")).select("complaint_id", "x.*") for f in (F.min_by, F.max_by))
    return an.changed_fields(old, new, "complaint_id", fields)


def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    return an.full_grid(_answers(spark, d), ["config", "route"], F.round(F.avg("retrieval_ms"), 6), "mean_ms")


def type_spread(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy("config", "type").agg(F.count("*").alias("n"), F.count_if(F.coalesce("abstained", F.lit(False))).alias("abstained"))


def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("ticker", "form", F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (retrieve_pipeline, context_blocks, flatten_hits, answer_selection, judge_means, label_rescore_diff, ablation_grid, type_spread, cell_counts)
    return {f.__name__: f for f in fs}


_SOLID = r"[^\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def oracle_sql() -> dict[str, str]:
    order = "date_received {0}, coalesce(company_response, '') {0}"
    return {
        "context_blocks": f"""WITH {_LISTS}, c AS (SELECT chunk_id, min({{'a': ticker, 'b': source, 'c': form, 'd': date, 'e': section, 'f': text}}) AS x FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
b AS (SELECT query_id, pos, '[S' || pos || '] (' || coalesce(x.a, x.b, '') || ' ' || coalesce(x.c, '') || ' ' || coalesce(x.d, '') || ', ' || coalesce(x.e, '') || ')' || chr(10) || coalesce(x.f, '') AS t FROM ls JOIN c USING (chunk_id) WHERE retriever = 'rerank' AND pos <= 5)
SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS context FROM b GROUP BY 1""",
        "flatten_hits": """WITH h AS (SELECT query_id, chunk_id, max(score) AS score, min(rank) AS rank FROM hits WHERE retriever = 'rerank' AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id NULLS FIRST, ticker NULLS FIRST, date NULLS FIRST, section NULLS FIRST, text NULLS FIRST) AS rn FROM chunks WHERE chunk_id IS NOT NULL)
SELECT query_id, rank, h.chunk_id, round(score, 4) AS score, doc_id, ticker, date, section, CASE WHEN c.chunk_id IS NOT NULL THEN coalesce(text, '') END AS text FROM h LEFT JOIN c ON h.chunk_id = c.chunk_id AND rn = 1""",
        "answer_selection": rf"""WITH {_RECORDS}, h AS (SELECT query_id AS id, count(*) AS contexts FROM hits GROUP BY 1),
x AS (SELECT config, CASE WHEN type IN ('unanswerable', 'out_of_scope') THEN 'negative' WHEN NOT coalesce(regexp_matches(answer, '{_SOLID}'), false) THEN 'empty' WHEN starts_with(regexp_replace(answer, '^\s+', ''), 'INSUFFICIENT_CONTEXT') THEN 'refused' WHEN coalesce(contexts, 0) = 0 THEN 'no contexts' WHEN NOT coalesce(regexp_matches(ground_truth, '{_SOLID}'), false) THEN 'no reference' ELSE 'judged' END AS reason FROM rc LEFT JOIN h ON h.id = rc.id)
SELECT config, reason, count(*) AS n FROM x GROUP BY ALL""",
        "judge_means": "SELECT retriever, round(avg(score) FILTER (WHERE NOT isnan(score)), 6) AS mean, count(*) FILTER (WHERE NOT isnan(score)) AS n_scored, count(*) FILTER (WHERE isnan(score)) AS n_failed FROM hits WHERE retriever IS NOT NULL GROUP BY 1",
        "label_rescore_diff": f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY {order.format('ASC NULLS FIRST')}) AS a, row_number() OVER (PARTITION BY complaint_id ORDER BY {order.format('DESC NULLS LAST')}) AS b FROM complaints WHERE complaint_id IS NOT NULL),
j AS (SELECT x.complaint_id, x.company_response AS r0, y.company_response AS r1, x.state AS s0, y.state AS s1 FROM o x JOIN o y ON x.complaint_id = y.complaint_id WHERE x.a = 1 AND y.b = 1)
SELECT complaint_id, 'company_response' AS field, r0 AS before, r1 AS after FROM j WHERE r0 IS DISTINCT FROM r1 UNION ALL SELECT complaint_id, 'state', s0, s1 FROM j WHERE s0 IS DISTINCT FROM s1""",
        "ablation_grid": f"WITH {_ANSWERS}, c AS (SELECT config, route, round(avg(retrieval_ms), 6) AS mean_ms FROM an GROUP BY ALL) SELECT a.config, b.route, mean_ms FROM (SELECT DISTINCT config FROM an WHERE config IS NOT NULL) a CROSS JOIN (SELECT DISTINCT route FROM an WHERE route IS NOT NULL) b LEFT JOIN c ON c.config = a.config AND c.route = b.route",
        "type_spread": f"WITH {_RECORDS} SELECT config, type, count(*) AS n, count(*) FILTER (WHERE coalesce(abstained, false)) AS abstained FROM rc GROUP BY ALL",
        "cell_counts": "SELECT ticker, form, left(date, 4) AS year, count(*) AS n FROM chunks GROUP BY ALL",
    }
