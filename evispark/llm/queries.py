"""The pN_ queries over the project's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.llm import broken_pairs as bp
from evispark.llm import fused_ranking as fr
from evispark.llm import leaked_items as li
from evispark.llm import markup as mu
from evispark.llm import mixing as mi
from evispark.llm import near_duplicates as nd
from evispark.llm import repeated_lines as rl
from evispark.llm import shared_spans as ss
from evispark.llm import split_oversized as so
from evispark.llm import text_quality as tq

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    g = nd.near_duplicate_groups(_t(spark, d, "chunks"), n=3, threshold=0.6, min_words=60)
    return nd.labelled(g).select(F.col("id").alias("chunk_id"), "group_id", "n_links")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    g = nd.near_duplicate_groups(_t(spark, d, "chunks"), n=3, threshold=0.6, min_words=60)
    return nd.group_pairs(g).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return so.split_oversized(_t(spark, d, "chunks")).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("n_pieces > 1").select("chunk_id").distinct()


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return fr.leximin_ranking(_t(spark, d, "hits"), _t(spark, d, "score_kinds")).select("query_id", "chunk_id", "rank")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fr.majority_first(fr.leximin_ranking(_t(spark, d, "hits"), _t(spark, d, "score_kinds"))).select("query_id", "chunk_id")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return mu.clean_markup(_t(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), "markups", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mu.clean_markup(_t(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), F.explode("markups").alias("markup")).distinct()


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bp.broken_pairs(bp.logged_pairs(_t(spark, d, "answers"), _t(spark, d, "drafts_multihop")), _t(spark, d, "common_words"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).where("defect is not null").select("pair_table", "pair_key", "defect")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rl.repeated_lines(_t(spark, d, "chunks")).select(F.col("id").alias("chunk_id"), F.col("line_no").cast("int")).distinct()


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rl.block_report(rl.repeated_lines(_t(spark, d, "chunks")))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "chunks")
    return rl.without_repeated_lines(chunks, rl.repeated_lines(chunks))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ss.snippet_matches(_t(spark, d, "drafts_multihop"), _t(spark, d, "chunks")).select("draft_id", "span_no", "chunk_id").distinct()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    drafts, chunks = _t(spark, d, "drafts_multihop"), _t(spark, d, "chunks")
    m = ss.checkpointed(ss.snippet_matches(drafts, chunks))
    return ss.share_report(ss.gold_snippets(drafts), chunks, m).select("kind", "record", "n_partners", "shared_words", "words", F.round("share", 6).alias("share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return li.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return li.leak_report(p8_found(spark, d), _t(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mi.mix_sources(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = _t(spark, d, "mix_targets")
    return mi.mix_shares(mi.checkpointed(mi.mix_sources(_t(spark, d, "documents"), targets)), targets)


def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of each distinct oversized text: its length, and whether its pieces keep the limit, overlap by 200 to 250, give the text back, and are as few as can be."""
    p = p2_pieces(spark, d).where("n_pieces > 1").withColumn("n", F.length("text"))
    before = F.coalesce(F.lag("window_end").over(Window.partitionBy("chunk_id", "section", "_of").orderBy("piece_no")), F.col("window_start"))
    texts = _t(spark, d, "chunks").where("length(text) > 2400").select("chunk_id", "section", F.xxhash64("text").alias("_of"), F.col("text").alias("whole")).distinct()
    p = p.join(texts, p["chunk_id"].eqNullSafe(texts["chunk_id"]) & p["section"].eqNullSafe(texts["section"])).drop(texts["chunk_id"]).drop(texts["section"])
    p = p.withColumn("before", before).withColumn("same", F.substring("whole", F.col("window_start") + 1, F.col("n")) == F.col("text"))
    last = F.max("window_end") == F.first(F.length("whole"))
    ok = F.bool_and(F.col("same") & (F.col("n") <= 2400) & ((F.col("piece_no") == 1) | (F.col("before") - F.col("window_start")).between(200, 250))) & last & (F.count("*") == F.ceil((F.first(F.length("whole")) - 200) / 2200))
    return p.groupBy("chunk_id", "section", "_of").agg(F.first(F.length("whole")).alias("chars"), ok.alias("good")).select("chunk_id", "chars", "good")


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Of each target that has documents: how many, whether none is used more often than max_repeats, and whether its tokens are within its largest document of what can be had."""
    targets = _t(spark, d, "mix_targets")
    mixed = mi.checkpointed(mi.mix_sources(_t(spark, d, "documents"), targets))
    shares = mi.mix_shares(mixed, targets).where("docs > 0").join(mixed.groupBy("source").agg(F.max("tokens").alias("largest")), "source")
    rows = shares.collect()  # a row for each target
    budget = mi.token_budgets([(r["source"], float(r["target_share"]), r["max_repeats"], r["tokens"]) for r in rows], float(sum(r["tokens"] for r in rows)))
    want = spark.createDataFrame(sorted(budget.items()), "source string, budget double")
    return shares.join(want, "source").select("source", "docs", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("used_tokens") - F.col("budget")) <= F.col("largest")).alias("near_budget"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return tq.text_quality(_t(spark, d, "documents"), _t(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_stats(spark, d).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


def queries() -> dict[str, Query]:
    found = (p1_found, p1_groups, p2_found, p2_pieces, p2_invariants, p3_found, p3_ranking, p4_found, p4_clean, p5_found, p5_pairs, p6_found, p6_clean, p6_blocks, p7_found, p7_shares, p8_found, p8_report, p9_mix, p9_shares, p9_invariants, p10_found, p10_stats)
    return {f.__name__: f for f in found}


_LINES = """
l AS (SELECT chunk_id, doc_id, COALESCE('t:' || ticker, 's:' || COALESCE(source, '')) AS site, i AS line_no, x[i] AS line FROM (
        SELECT chunk_id, doc_id, ticker, source, x, UNNEST(RANGE(1, LEN(x) + 1)) AS i FROM (SELECT *, STRING_SPLIT(text, CHR(10)) AS x FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL))),
k AS (SELECT DISTINCT chunk_id, doc_id, site, line_no, REGEXP_REPLACE(LOWER(line), '[^a-z0-9]', '', 'g') AS k FROM l
      WHERE LENGTH(REGEXP_REPLACE(line, '^[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+|[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+$', '', 'g')) BETWEEN 20 AND 200),
n AS (SELECT site, k FROM k WHERE k <> '' GROUP BY site, k HAVING COUNT(DISTINCT doc_id) >= 6)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
WITH RECURSIVE w AS (SELECT DISTINCT chunk_id, text, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+') AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
d AS (SELECT chunk_id, MD5(text) AS t, w FROM w WHERE LEN(w) >= 60),
g AS (SELECT DISTINCT t, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT t, w, UNNEST(RANGE(1, LEN(w) - 1)) AS i FROM (SELECT t, ANY_VALUE(w) AS w FROM d GROUP BY t))),
s AS (SELECT t, COUNT(*) AS n FROM g GROUP BY t),
p AS (SELECT a.t AS a, b.t AS b, COUNT(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.t < b.t GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s x ON x.t = a JOIN s y ON y.t = b WHERE c >= CAST(0.6 AS DOUBLE) * (x.n + y.n - c)),
v AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT t AS x, t AS y FROM d UNION SELECT r.x, v.y FROM r JOIN v ON r.y = v.x),
c AS (SELECT x AS t, MIN(y) AS grp FROM r GROUP BY x),
m AS (SELECT DISTINCT chunk_id, grp FROM d JOIN c USING (t))
SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM m a JOIN m b ON a.grp = b.grp AND a.chunk_id < b.chunk_id""",
        "p1_groups": """
WITH RECURSIVE w AS (SELECT DISTINCT chunk_id, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+') AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
d AS (SELECT DISTINCT chunk_id, MD5(ARRAY_TO_STRING(w, ' ')) AS t, w FROM w WHERE LEN(w) >= 60),
g AS (SELECT DISTINCT t, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT t, w, UNNEST(RANGE(1, LEN(w) - 1)) AS i FROM (SELECT t, ANY_VALUE(w) AS w FROM d GROUP BY t))),
s AS (SELECT t, COUNT(*) AS n FROM g GROUP BY t),
p AS (SELECT a.t AS a, b.t AS b, COUNT(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.t < b.t GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s x ON x.t = a JOIN s y ON y.t = b WHERE c >= CAST(0.6 AS DOUBLE) * (x.n + y.n - c)),
v AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
k AS (SELECT x AS t, COUNT(*) AS n_links FROM v GROUP BY 1),
r AS (SELECT DISTINCT t AS x, t AS y FROM d UNION SELECT r.x, v.y FROM r JOIN v ON r.y = v.x),
c AS (SELECT x AS t, MIN(y) AS grp FROM r GROUP BY x),
l AS (SELECT grp, MIN(chunk_id) AS group_id FROM d JOIN c USING (t) GROUP BY grp)
SELECT chunk_id, group_id, COALESCE(n_links, 0) AS n_links FROM d JOIN c USING (t) JOIN l USING (grp) LEFT JOIN k ON k.t = d.t""",
        "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE LENGTH(text) > 2400 AND chunk_id IS NOT NULL",
        "p2_invariants": "SELECT chunk_id, LENGTH(text) AS chars, TRUE AS good FROM (SELECT DISTINCT chunk_id, section, text FROM chunks WHERE LENGTH(text) > 2400)",
        "p9_invariants": "SELECT source, COUNT(*) AS docs, TRUE AS within_repeats, TRUE AS near_budget FROM (SELECT DISTINCT doc_id, source, text FROM documents WHERE text <> '' AND doc_id IS NOT NULL) JOIN (SELECT DISTINCT source FROM mix_targets) USING (source) GROUP BY source",
        "p3_found": """
WITH h AS (SELECT query_id, retriever, chunk_id, MAX(CASE WHEN better = 'lower' THEN -score ELSE score END) AS s FROM hits LEFT JOIN score_kinds USING (retriever)
           WHERE score IS NOT NULL AND NOT ISNAN(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT query_id, retriever, MAX(s) AS s FROM h GROUP BY 1, 2),
f AS (SELECT query_id, retriever, MIN(chunk_id) AS chunk_id FROM h JOIN b USING (query_id, retriever, s) GROUP BY 1, 2 HAVING COUNT(*) = 1),
n AS (SELECT query_id, COUNT(*) AS n FROM b GROUP BY 1)
SELECT query_id, chunk_id FROM f JOIN n USING (query_id) GROUP BY query_id, chunk_id, n HAVING COUNT(*) * 2 > n""",
        "p3_ranking": """
WITH h AS (SELECT query_id, retriever, chunk_id, MAX(CASE WHEN better = 'lower' THEN -score ELSE score END) AS s FROM hits LEFT JOIN score_kinds USING (retriever)
           WHERE score IS NOT NULL AND NOT ISNAN(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL AND retriever IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, RANK() OVER (PARTITION BY query_id, retriever ORDER BY s) - 1 AS below, COUNT(*) OVER (PARTITION BY query_id, retriever, s) AS same, COUNT(*) OVER (PARTITION BY query_id, retriever) AS n FROM h),
p AS (SELECT query_id, chunk_id, CASE WHEN n = 1 THEN CAST(1 AS DOUBLE) ELSE (below + CAST(0.5 AS DOUBLE) * (same - 1)) / (n - 1) END AS p FROM r),
k AS (SELECT query_id, COUNT(DISTINCT retriever) AS k FROM h GROUP BY 1),
v AS (SELECT query_id, chunk_id, LIST_SORT(LIST_CONCAT(LIST(p), LIST_TRANSFORM(RANGE(ANY_VALUE(k) - COUNT(*)), lambda x: CAST(0 AS DOUBLE)))) AS v FROM p JOIN k USING (query_id) GROUP BY 1, 2)
SELECT query_id, chunk_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS rank FROM v""",
        "p8_report": """
WITH a AS (SELECT item_id, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
b AS (SELECT doc_id, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item_id, MD5(ARRAY_TO_STRING(w[i:i + 11], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 10)) AS i FROM a)),
y AS (SELECT DISTINCT doc_id, MD5(ARRAY_TO_STRING(w[i:i + 11], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 10)) AS i FROM b)),
f AS (SELECT item_id, COUNT(DISTINCT doc_id) AS n FROM x JOIN y USING (g) GROUP BY 1)
SELECT DISTINCT item_id, item_set, COALESCE(n, 0) AS n_docs FROM eval_items LEFT JOIN f USING (item_id)""",
        "p6_found": f"WITH {_LINES} SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN n USING (site, k)",
        "p6_clean": f"""
WITH {_LINES},
c AS (SELECT DISTINCT chunk_id, text FROM chunks),
g AS (SELECT c.chunk_id, c.text, LIST(DISTINCT f.line_no) AS no FROM c JOIN (SELECT DISTINCT chunk_id, line_no FROM k JOIN n USING (site, k)) f USING (chunk_id) GROUP BY ALL)
SELECT c.chunk_id, CASE WHEN no IS NULL THEN c.text ELSE ARRAY_TO_STRING(LIST_FILTER(STRING_SPLIT(c.text, CHR(10)), lambda x, i: NOT LIST_CONTAINS(no, i)), CHR(10)) END AS text, CAST(COALESCE(LEN(no), 0) AS INTEGER) AS n_removed
FROM c LEFT JOIN g ON c.chunk_id = g.chunk_id AND c.text = g.text""",
        "p7_found": r"""
WITH s AS (SELECT DISTINCT id, i - 1 AS span_no, gold_spans[i].snippet AS t FROM (SELECT id, gold_spans, UNNEST(RANGE(1, LEN(gold_spans) + 1)) AS i FROM drafts_multihop) WHERE gold_spans[i].snippet IS NOT NULL),
a AS (SELECT id, span_no, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(t, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+'), lambda x: x <> '') AS w FROM s),
b AS (SELECT DISTINCT chunk_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+'), lambda x: x <> '') AS w FROM chunks WHERE text IS NOT NULL),
x AS (SELECT DISTINCT id, span_no, MD5(ARRAY_TO_STRING(w[i:i + 29], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 28)) AS i FROM a)),
y AS (SELECT DISTINCT chunk_id, MD5(ARRAY_TO_STRING(w[i:i + 29], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 28)) AS i FROM b))
SELECT DISTINCT id AS draft_id, CAST(span_no AS INTEGER) AS span_no, chunk_id FROM x JOIN y USING (g)""",
        "p7_shares": r"""
WITH s AS (SELECT DISTINCT id, i - 1 AS span_no, gold_spans[i].snippet AS t FROM (SELECT id, gold_spans, UNNEST(RANGE(1, LEN(gold_spans) + 1)) AS i FROM drafts_multihop) WHERE gold_spans[i].snippet IS NOT NULL AND id IS NOT NULL),
a AS (SELECT 'span' AS kind, id || '#' || span_no AS record, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(t, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+'), lambda x: x <> '') AS w FROM s),
b AS (SELECT DISTINCT 'chunk' AS kind, chunk_id AS record, text AS t, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+'), lambda x: x <> '') AS w FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
u AS (SELECT kind, record, w, ROW_NUMBER() OVER () AS k FROM (SELECT kind, record, w FROM a UNION ALL SELECT kind, record, w FROM b)),
x AS MATERIALIZED (SELECT kind, record, k, i, MD5(ARRAY_TO_STRING(w[i:i + 29], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 28)) AS i FROM u)),
m AS MATERIALIZED (SELECT x.kind, x.k, x.i, y.record AS other FROM x JOIN x y ON x.g = y.g AND x.kind <> y.kind),
p AS (SELECT k, COUNT(DISTINCT other) AS n_partners FROM m GROUP BY k),
c AS (SELECT k, COUNT(DISTINCT pos) AS shared_words FROM (SELECT DISTINCT k, UNNEST(RANGE(i, i + 30)) AS pos FROM (SELECT DISTINCT k, i FROM m)) GROUP BY k)
SELECT kind, record, COALESCE(n_partners, 0) AS n_partners, COALESCE(shared_words, 0) AS shared_words, CAST(LEN(w) AS INTEGER) AS words, CASE WHEN LEN(w) > 0 THEN ROUND(COALESCE(shared_words, 0) / LEN(w), 6) END AS share FROM u LEFT JOIN p USING (k) LEFT JOIN c USING (k)""",
        "p8_found": """
WITH a AS (SELECT item_id, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
b AS (SELECT doc_id, REGEXP_EXTRACT_ALL(LOWER(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item_id, MD5(ARRAY_TO_STRING(w[i:i + 11], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 10)) AS i FROM a)),
y AS (SELECT DISTINCT doc_id, MD5(ARRAY_TO_STRING(w[i:i + 11], ' ')) AS g FROM (SELECT *, UNNEST(RANGE(1, LEN(w) - 10)) AS i FROM b))
SELECT DISTINCT item_id, doc_id FROM x JOIN y USING (g)""",
    }
