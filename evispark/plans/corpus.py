"""Queries of text functions, normalisation and chunking, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import chunking, normalise
from evispark.plans.tables import table

_CHUNKS = ["chunk_id", "text"]


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "chunks").where("chunk_id is not null and text is not null").select(*cols).distinct()


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, *_CHUNKS).select("chunk_id", T.html_to_text(F.col("text")).alias("text"))


def tighten_money(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, *_CHUNKS).select("chunk_id", T.tighten_money(F.col("text")).alias("text"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.fingerprint(F.col("text")).alias("fp"), T.prefix_fingerprint(F.col("text")).alias("prefix_fp"))


def figures(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, *_CHUNKS).select("chunk_id", F.array_join(F.array_sort(T.figures(F.col("text"))), " ").alias("figures"))


def section_longest_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(T.sections(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.name").alias("name"), F.length("s.text").alias("chars"))


def context_headers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "source", "ticker", "form", "date", "section").distinct()
    return c.select("chunk_id", T.context_header(*[F.col(x) for x in ("source", "ticker", "form", "date", "section")]).alias("header")).distinct()


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("doc_id is not null and chunk_id is not null").select("doc_id", "section", "chunk_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("chunk_id")) - 1  # a document's chunks
    return c.withColumn("i", place).select("chunk_id", "doc_id", "section", T.chunk_id(F.col("doc_id"), F.col("section"), F.col("i")).alias("name"))


def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_windows(table(spark, d, "documents"), 3)


def window_expand(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").select("chunk_id").where("chunk_id is not null").distinct()
    return chunking.expand_windows(hits, table(spark, d, "chunks"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, d, "documents"), 80, 25).select("doc_id", "chunk_no", "start", "end", "text")


def semantic_breaks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_breaks(table(spark, d, "documents")).where(F.size("s") > 0).select("doc_id", F.array_join(F.transform("breaks", lambda x: x.cast("string")), ",").alias("breaks"))


def semantic_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_chunks(table(spark, d, "documents"), 80).select("doc_id", "chunk_no", "start", "end", "text")


def chunk_size_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.size_stats(table(spark, d, "chunks"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat_ws("_", F.coalesce("ticker", "source", F.lit("none")), F.coalesce("form", F.lit("none")), F.coalesce("date", F.lit("none")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), doc.alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("section"), "text", "date", "source")


def normalize_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return normalise.normalise(_corpus(spark, d), "seq").select("seq", "reason")


def normalize_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return normalize_dedupe(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def near_dup_openings(spark: SparkSession, d: str) -> DataFrame:
    return normalise.near_duplicate_openings(normalise.normalise(_corpus(spark, d), "seq").where("reason is null"))


def distractor_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_id is not null and source is not null").select("chunk_id", "source").distinct()
    gold = table(spark, d, "drafts_multihop").where("type = 'comparative'").select(F.explode(F.split("drafted_from_chunk", r"\|")).alias("chunk_id")).distinct()
    return normalise.proportional_sample(c, "source", "chunk_id", 300, gold).select("chunk_id", "source")


def temporal_pairs(spark: SparkSession, d: str) -> DataFrame:
    return normalise.temporal_pairs(table(spark, d, "chunks"), 300)


def cross_entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return normalise.cross_entity_pairs(table(spark, d, "chunks"), 300, 3)


def quarter_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = normalise.last_wins(table(spark, d, "complaints"), "complaint_id", F.struct("date_received", F.coalesce("company_response", F.lit(""))))
    return normalise.quarter_sample(rows.where("product is not null"), "product", "date_received", 120, "complaint_id").select("complaint_id", "product", F.col("quarter").cast("string").alias("quarter"))


def last_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("date_received", F.coalesce("company_response", F.lit("")))
    return normalise.last_wins(table(spark, d, "complaints").select("complaint_id", "date_received", "company_response"), "complaint_id", order).select("complaint_id", "company_response")


def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    drafts = table(spark, d, "drafts_multihop").select("id", "type").distinct()
    must = table(spark, d, "answers").where("abstained").select("id")
    return normalise.stratified_pick(drafts, "type", "id", 40, must).select("id", "type")


def round_robin_strata(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("ticker is not null and section is not null").select("ticker", "section", "chunk_id").distinct()
    return normalise.round_robin(c, ["ticker", "section"], "chunk_id", 100)


def narrowest_cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("ticker is not null").groupBy("ticker", "form", F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n"))
    return c.orderBy("n", "ticker", "form", "year").limit(3)


def zip3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "complaints").groupBy(T.zip3(F.col("zip_code")).alias("zip3")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (html_to_text, tighten_money, fingerprints, figures, section_longest_match, context_headers, chunk_ids, sentence_windows, window_expand, fixed_chunks, semantic_breaks, semantic_pack, chunk_size_stats, normalize_dedupe, normalize_drop_reasons, near_dup_openings, quarter_stratified_sample, last_wins_merge, stratified_pick, round_robin_strata, narrowest_cells, zip3, distractor_sample, temporal_pairs, cross_entity_pairs)
    return {f.__name__: f for f in fs}


_TIGHT = r"regexp_replace(regexp_replace({}, '([$(])\s+([\d.(])', '\1\2', 'g'), '([\d.])\s+([%)])', '\1\2', 'g')"
_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_SENT = r"""
s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN len(regexp_split_to_array(x, '\s+')) > 400 THEN list_transform(range(1, len(regexp_split_to_array(x, '\s+')) + 1, 250), lambda i: array_to_string(regexp_split_to_array(x, '\s+')[i:i + 249], ' ')) ELSE [x] END)) AS s FROM s0),
s2 AS (SELECT doc_id, s, list_transform(s, lambda x: CAST(len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) AS INTEGER)) AS c FROM s1 WHERE len(s) > 0)"""
_BREAKS = r"""
w AS (SELECT doc_id, s, c, list_transform(s, lambda x: list_distinct(regexp_extract_all(lower(x), '[a-z0-9]+'))) AS w FROM s2),
di AS (SELECT doc_id, s, c, list_transform(range(1, len(s)), lambda i: CAST(1 AS DOUBLE) - CASE WHEN len(w[i]) * len(w[i + 1]) > 0 THEN len(list_intersect(w[i], w[i + 1])) / sqrt(CAST(len(w[i]) * len(w[i + 1]) AS DOUBLE)) ELSE 0 END) AS d FROM w),
cu AS (SELECT *, list_sort(d) AS v, CAST(0.9 AS DOUBLE) * (len(d) - 1) AS pos FROM di),
ct AS (SELECT *, CASE WHEN len(s) >= 3 THEN v[CAST(floor(pos) AS INTEGER) + 1] + (v[least(CAST(floor(pos) AS INTEGER) + 1, len(v) - 1) + 1] - v[CAST(floor(pos) AS INTEGER) + 1]) * (pos - floor(pos)) END AS cut FROM cu),
br AS (SELECT doc_id, s, c, CASE WHEN cut IS NULL THEN [] ELSE list_filter(range(1, len(s)), lambda i: d[i] > cut) END AS b FROM ct)"""
_CORPUS = r"""
c0 AS (SELECT doc_id AS seq, concat_ws('_', coalesce(ticker, source, 'none'), coalesce(form, 'none'), coalesce(date, 'none')) || '_' || coalesce(lang, 'und') AS k, text, date FROM documents),
c1 AS MATERIALIZED (SELECT *, CASE WHEN text IS NULL OR length(text) < 200 THEN 'too_short' WHEN NOT coalesce(regexp_matches(date, '^\d{4}-\d{2}-\d{2}$'), false) THEN 'bad_date' END AS gate, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS f FROM c0),
c2 AS MATERIALIZED (SELECT seq, hash(k) AS k, hash(f) AS f, row_number() OVER (ORDER BY seq) AS i FROM c1 WHERE gate IS NULL),
rs AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST([] AS UBIGINT[]) AS ks, CAST([] AS UBIGINT[]) AS fs, CAST(NULL AS VARCHAR) AS reason
  UNION ALL SELECT c2.i, c2.seq, CASE WHEN list_contains(ks, k) OR list_contains(fs, f) THEN ks ELSE list_append(ks, k) END, CASE WHEN list_contains(ks, k) OR list_contains(fs, f) THEN fs ELSE list_append(fs, f) END,
    CASE WHEN list_contains(ks, k) THEN 'duplicate_key' WHEN list_contains(fs, f) THEN 'duplicate_text' END FROM rs JOIN c2 ON c2.i = rs.i + 1),
nz AS (SELECT c1.seq, coalesce(gate, reason) AS reason FROM c1 LEFT JOIN rs ON rs.seq = c1.seq)"""


def _header_sql() -> str:
    def names(c: str, m: dict[str, str], other: str) -> str:
        return f"CASE {' '.join(f"WHEN {c} = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in m.items())} ELSE {other} END"

    form = names("form", T.FORMS, "coalesce(nullif(form, ''), 'filing')")
    who = f"CASE WHEN source = 'fomc' THEN 'Federal Open Market Committee' ELSE {names('ticker', {k: f'{v} ({k})' for k, v in T.ISSUERS.items()}, "coalesce(nullif(ticker, ''), 'Unknown issuer')")} END"
    place = names("section", T.SECTIONS, "replace(coalesce(section, ''), '_', ' ')")
    date = "coalesce(nullif(date, ''), 'undated')"
    return f"""SELECT DISTINCT chunk_id, CASE WHEN source = 'cfpb' THEN 'Consumer complaint to the CFPB' || CASE WHEN trim(coalesce(section, '')) <> '' THEN ' about a ' || lower(trim(section)) ELSE '' END || ', ' || {date} || '.'
ELSE {who} || ' ' || {form} || ', ' || {date} || CASE WHEN {place} <> '' THEN ', ' || {place} ELSE '' END || '.' END AS header FROM chunks"""


def oracle_sql() -> dict[str, str]:
    chunks = "(SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)"
    html = r"regexp_replace(regexp_replace(text, '<!--(?s:.*?)-->', ' ', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&#160;", " "), ("&mdash;", "—"), ("&#8217;", "’"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = f"replace({html}, '{a}', '{b}')"
    return {
        "html_to_text": f"SELECT chunk_id, {_TIGHT.format(_NORM.format(html))} AS text FROM {chunks}",
        "tighten_money": f"SELECT chunk_id, {_TIGHT.format('text')} AS text FROM {chunks}",
        "fingerprints": f"SELECT doc_id, sha256({_NORM.format('lower(text)')}) AS fp, sha256(left({_NORM.format('lower(text)')}, 500)) AS prefix_fp FROM documents WHERE text IS NOT NULL",
        "figures": rf"SELECT chunk_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(replace(text, ',', ''), '\d+(?:\.\d+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END))), ' ') AS figures FROM {chunks}",
        "section_longest_match": "SELECT doc_id, 'full_document' AS name, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL",
        "context_headers": _header_sql(),
        "chunk_ids": r"SELECT chunk_id, doc_id, section, doc_id || '_' || regexp_replace(regexp_replace(lower(coalesce(nullif(section, ''), 'unknown')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || printf('%03d', row_number() OVER (PARTITION BY doc_id, section ORDER BY chunk_id) - 1) AS name FROM (SELECT DISTINCT doc_id, section, chunk_id FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL)",
        "sentence_windows": f"WITH {_SENT} SELECT doc_id, CAST(i AS INTEGER) AS i, s[i + 1] AS text, CAST(greatest(i - 3, 0) AS INTEGER) AS window_start, CAST(least(i + 4, n) AS INTEGER) AS window_end FROM (SELECT doc_id, s, len(s) AS n, unnest(range(0, len(s))) AS i FROM s2)",
        "window_expand": r"""WITH o AS (SELECT chunk_id, min({'a': doc_id, 'b': section, 'c': window_start, 'd': window_end, 'e': text}) AS x FROM chunks WHERE chunk_id IS NOT NULL AND NOT (doc_id IS NULL) GROUP BY chunk_id),
one AS (SELECT chunk_id, x.a AS doc_id, coalesce(x.b, '') AS section, x.c AS ws, x.d AS we, x.e AS text, CAST(regexp_extract(chunk_id, '(\d+)$', 1) AS INTEGER) AS i FROM o),
w AS (SELECT a.chunk_id, string_agg(b.text, ' ' ORDER BY b.i) AS wide FROM one a JOIN one b ON a.doc_id = b.doc_id AND a.section = b.section AND b.ws IS NOT NULL AND b.text IS NOT NULL AND b.i >= a.ws AND b.i < a.we WHERE a.ws IS NOT NULL GROUP BY a.chunk_id)
SELECT h.chunk_id, coalesce(wide, one.text) AS text FROM (SELECT DISTINCT chunk_id FROM hits WHERE chunk_id IS NOT NULL) h LEFT JOIN one USING (chunk_id) LEFT JOIN w USING (chunk_id)""",
        "fixed_chunks": f"""WITH RECURSIVE {_SENT},
pf AS (SELECT doc_id, s, len(s) AS n, list_transform(range(0, len(s) + 1), lambda i: CAST(coalesce(list_sum(c[1:i]), 0) AS BIGINT)) AS p FROM s2),
st AS (SELECT doc_id, s, n, p, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(greatest(1, len(list_filter(range(1, n + 1), lambda e: p[e + 1] <= 80))) AS BIGINT) AS b FROM pf
 UNION ALL SELECT doc_id, s, n, p, k + 1, na, greatest(na + 1, na + len(list_filter(range(na + 1, n + 1), lambda e: p[e + 1] - p[na + 1] <= 80))) FROM
  (SELECT *, greatest(a + 1, b - len(list_filter(range(a + 1, b), lambda q: p[b + 1] - p[q + 1] <= 25))) AS na FROM st WHERE b < n))
SELECT doc_id, k AS chunk_no, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", array_to_string(s[a + 1:b], ' ') AS text FROM st""",
        "semantic_breaks": f"WITH {_SENT}, {_BREAKS} SELECT doc_id, array_to_string(b, ',') AS breaks FROM br",
        "semantic_pack": f"""WITH RECURSIVE {_SENT}, {_BREAKS},
fo AS (SELECT doc_id, s, c, b, CAST(1 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS st, CAST(c[1] AS BIGINT) AS used FROM br
 UNION ALL SELECT doc_id, s, c, b, i + 1, CASE WHEN list_contains(b, i) OR used + c[i + 1] > 80 THEN list_append(st, i) ELSE st END, CASE WHEN list_contains(b, i) OR used + c[i + 1] > 80 THEN c[i + 1] ELSE used + c[i + 1] END FROM fo WHERE i < len(s)),
en AS (SELECT doc_id, s, st, unnest(range(0, len(st))) AS k FROM fo WHERE i = len(s))
SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(st[k + 1] AS INTEGER) AS start, CAST(coalesce(st[k + 2], len(s)) AS INTEGER) AS "end", array_to_string(s[st[k + 1] + 1:coalesce(st[k + 2], len(s))], ' ') AS text FROM en""",
        "chunk_size_stats": r"SELECT count(*) AS n, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, CAST(max(n) AS INTEGER) AS longest FROM (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM chunks)",
        "normalize_dedupe": f"WITH RECURSIVE {_CORPUS} SELECT seq, reason FROM nz",
        "normalize_drop_reasons": f"WITH RECURSIVE {_CORPUS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM nz GROUP BY 1",
        "near_dup_openings": f"WITH RECURSIVE {_CORPUS} SELECT count(*) AS openings, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra FROM (SELECT count(*) AS n FROM nz JOIN documents ON nz.seq = documents.doc_id WHERE reason IS NULL GROUP BY left({_NORM.format('lower(text)')}, 500) HAVING count(*) > 1)",
        "distractor_sample": """WITH c AS (SELECT DISTINCT chunk_id, source FROM chunks WHERE chunk_id IS NOT NULL AND source IS NOT NULL),
g AS (SELECT DISTINCT unnest(string_split(drafted_from_chunk, '|')) AS chunk_id FROM drafts_multihop WHERE type = 'comparative'),
n AS (SELECT source, 300 * count(*) // (SELECT count(*) FROM c) AS quota FROM c GROUP BY 1),
r AS (SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY md5(chunk_id), chunk_id) AS rn FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM g WHERE chunk_id IS NOT NULL))
SELECT chunk_id, source FROM r JOIN n USING (source) WHERE rn <= quota UNION SELECT c.* FROM c JOIN g USING (chunk_id)""",
        "temporal_pairs": """WITH c AS (SELECT ticker, section, left(date, 4) AS year, chunk_id FROM chunks WHERE length(text) > 300 AND ticker <> '' AND section IS NOT NULL AND date IS NOT NULL AND chunk_id IS NOT NULL),
y AS (SELECT ticker, section, min(year) AS a, max(year) AS b FROM c GROUP BY ALL HAVING min(year) < max(year)),
p AS (SELECT ticker, section, year, min({'h': md5(chunk_id), 'c': chunk_id}).c AS chunk_id FROM c GROUP BY ALL)
SELECT ticker, section, y.a AS early, y.b AS late, p.chunk_id AS chunk_id_a, q.chunk_id AS chunk_id_b FROM y JOIN p USING (ticker, section) JOIN q USING (ticker, section) WHERE p.year = y.a AND q.year = y.b""".replace("JOIN q USING", "JOIN p q USING"),
        "cross_entity_pairs": """WITH p AS (SELECT section, ticker, min({'h': md5(chunk_id), 'c': chunk_id}).c AS chunk_id FROM chunks WHERE length(text) > 300 AND ticker <> '' AND section IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
r AS (SELECT p.*, CAST(round AS INTEGER) AS round, row_number() OVER (PARTITION BY section, round ORDER BY md5(concat_ws('|', ticker, section, CAST(round AS VARCHAR)))) - 1 AS i FROM p, range(3) t(round))
SELECT a.section, a.round, a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM r a JOIN r b ON a.section = b.section AND a.round = b.round AND a.i % 2 = 0 AND b.i = a.i + 1""",
        "quarter_stratified_sample": """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY date_received DESC NULLS LAST, coalesce(company_response, '') DESC) AS rn FROM complaints) WHERE rn = 1 AND product IS NOT NULL AND date_received IS NOT NULL),
q AS (SELECT *, date_trunc('quarter', date_received AT TIME ZONE 'UTC') AS quarter FROM l), nq AS (SELECT datediff('quarter', min(quarter), max(quarter)) + 1 AS n FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY product, quarter ORDER BY date_received DESC, complaint_id) AS k FROM q)
SELECT complaint_id, product, strftime(quarter, '%Y-%m-%d %H:%M:%S') AS quarter FROM r, nq WHERE k <= 120 // nq.n + 1""",
        "last_wins_merge": "SELECT complaint_id, company_response FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY date_received DESC NULLS LAST, coalesce(company_response, '') DESC) AS rn FROM complaints) WHERE rn = 1",
        "stratified_pick": """WITH d AS (SELECT DISTINCT id, type FROM drafts_multihop), m AS (SELECT DISTINCT id FROM answers WHERE abstained),
r AS (SELECT d.id, type, m.id IS NOT NULL AS must, row_number() OVER (PARTITION BY type ORDER BY m.id IS NULL, d.id) AS k FROM d LEFT JOIN m ON d.id = m.id) SELECT id, type FROM r WHERE must OR k <= 40""",
        "round_robin_strata": "SELECT ticker, section, chunk_id, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY ticker, section ORDER BY chunk_id) AS turn FROM (SELECT DISTINCT ticker, section, chunk_id FROM chunks WHERE ticker IS NOT NULL AND section IS NOT NULL)) ORDER BY turn, ticker, section LIMIT 100",
        "narrowest_cells": "SELECT ticker, form, left(date, 4) AS year, count(*) AS n FROM chunks WHERE ticker IS NOT NULL GROUP BY ALL ORDER BY n, ticker NULLS FIRST, form NULLS FIRST, year NULLS FIRST LIMIT 3",
        "zip3": r"SELECT nullif(regexp_extract(zip_code, '^(\d{3})', 1), '') AS zip3, count(*) AS n FROM complaints GROUP BY 1",
    }
