"""Queries of landed files and stored tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import chunking
from evispark.plans.corpus import _header_sql
from evispark.plans.tables import table
from evispark.sources import landed, stores

AS_OF = "2025-06-30"


def filing_selection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("ticker is not null and doc_id is not null and date is not null").select("ticker", "form", "date", F.col("doc_id").alias("accession"), F.col("doc_id").alias("primary_doc")).distinct()
    return landed.select_filings(c, F.lit(AS_OF).cast("date")).select("ticker", "form", "date", "accession")


def length_floors(spark: SparkSession, d: str) -> DataFrame:
    return landed.length_floor(table(spark, d, "chunks").select("source", "text")).groupBy("source").agg(F.count("*").alias("n"))


def texts_to_embed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_id is not null")
    c = c.select("chunk_id", T.context_header(*[F.col(x) for x in ("source", "ticker", "form", "date", "section")]).alias("header"), "text")
    return stores.export_texts(c).select("chunk_id", F.md5("text").alias("digest")).distinct()


def vectors_missing(spark: SparkSession, d: str) -> DataFrame:
    # the scored passages stand in for the vectors
    known = table(spark, d, "chunks").where("chunk_id is not null").select("chunk_id").distinct()
    vectors = table(spark, d, "hits").select("chunk_id").distinct().join(known, "chunk_id", "left_semi")
    return stores.import_vectors(vectors, known)[1]


def keyed_replacement(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").select("doc_id", "lang", "source")
    new = old.where("doc_id % 7 = 0").withColumn("lang", F.lit("new")).unionByName(old.where("doc_id % 14 = 0").withColumn("lang", F.lit("newer")))
    new = new.withColumn("seq", F.length("lang"))
    return stores.upsert(old, new, "doc_id", "seq").groupBy("lang").agg(F.count("*").alias("n"))


def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    todo = table(spark, d, "drafts_multihop").where("id is not null").select("id").distinct()
    return stores.pending(todo, table(spark, d, "answers").where("answer is not null and id is not null"))


def question_keys(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "drafts_multihop").where("id is not null and question is not null").select("id", "question").distinct()
    return q.select("id", T.question_key(F.col("question")).alias("key"))


def chunks_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.chunk_documents(docs, "sentence_window", width=3).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("error").alias("failed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (filing_selection, length_floors, texts_to_embed, vectors_missing, keyed_replacement, resumed_run, question_keys, chunks_by_strategy)}


def oracle_sql() -> dict[str, str]:
    header = _header_sql().replace("SELECT DISTINCT chunk_id, ", "SELECT chunk_id, text, ", 1)
    return {
        "filing_selection": f"""WITH f AS (SELECT DISTINCT ticker, form, date, doc_id AS accession FROM chunks WHERE ticker IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> '' AND date IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, form ORDER BY date DESC, accession DESC) AS rn FROM f)
SELECT ticker, form, date, accession FROM r WHERE form = '10-K' AND rn <= 3 OR form = '10-Q' AND rn <= 6 OR form = '8-K' AND try_cast(date AS DATE) >= DATE '{AS_OF}' - 548""",
        "length_floors": "SELECT source, count(*) AS n FROM chunks WHERE length(text) >= CASE source WHEN 'edgar' THEN 500 WHEN 'fomc' THEN 500 WHEN 'cfpb' THEN 200 ELSE 0 END GROUP BY source",
        "texts_to_embed": f"SELECT DISTINCT chunk_id, md5(concat_ws(chr(10), header, text)) AS digest FROM ({header}) WHERE chunk_id IS NOT NULL",
        "vectors_missing": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM hits WHERE chunk_id IS NOT NULL)",
        "keyed_replacement": "SELECT CASE WHEN doc_id % 14 = 0 THEN 'newer' WHEN doc_id % 7 = 0 THEN 'new' ELSE lang END AS lang, count(*) AS n FROM documents GROUP BY 1",
        "resumed_run": "SELECT DISTINCT id FROM drafts_multihop WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM answers WHERE answer IS NOT NULL AND id IS NOT NULL)",
        "question_keys": "SELECT DISTINCT id, array_to_string(list_sort(regexp_extract_all(lower(question), '[a-z0-9]+')), ' ') AS key FROM (SELECT DISTINCT id, question FROM drafts_multihop WHERE id IS NOT NULL AND question IS NOT NULL)",
        "chunks_by_strategy": r"""WITH s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, list_sum(list_transform(p, lambda x: CASE WHEN len(regexp_split_to_array(x, '\s+')) > 400 THEN CAST(ceil(len(regexp_split_to_array(x, '\s+')) / 250) AS BIGINT) ELSE 1 END)) AS n FROM s0)
SELECT doc_id, CAST(n AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS failed FROM s1 WHERE n > 0""",
    }
