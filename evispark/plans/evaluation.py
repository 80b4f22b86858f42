"""Queries of question analysis, metrics, gates, the screen and events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.functions.stats import ERFC, Z95_EXACT, bootstrap_interval, bootstrap_means, nearest_rank_by
from evispark.operators import evaluation as ev
from evispark.operators import filters, fusion, routing, screen
from evispark.plans.retrieval import _LISTS
from evispark.plans.tables import table
from evispark.session import checkpointed
from evispark.streaming import ingest

#: Names by which the questions of the test tables call some issuers.
ALIASES = {"ARDF": ("ardfield bankshares", "ardfield"), "CALD": ("caldston bancorp", "caldston"), "FENF": ("fenford financial",), "NORL": ("norlow bancorp", "norlow"), "STAN": ("stanston capital",)}
K, SOURCES, ROUNDS = 5, 6, 10_000


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drafts_multihop").where("id is not null").groupBy("id").agg(F.max(F.struct("question", "ground_truth", "type", "expected_source")).alias("x")).select("id", "x.*")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The last logged row of each trace_id."""
    order = F.struct("logged_at", F.coalesce("answer", F.lit("")))
    return table(spark, d, "answers").groupBy("trace_id").agg(F.max_by(F.struct("id", "answer", "abstained", "route", "config", "retrieval_ms", "generation_ms", "logged_at", "asked_at"), order).alias("x")).select("trace_id", "x.*")


def route_heuristic(spark: SparkSession, d: str) -> DataFrame:
    r = routing.routed(_drafts(spark, d))
    return r.select("id", F.array_join("collections", "+").alias("collections"), "method")


def issuer_detect(spark: SparkSession, d: str) -> DataFrame:
    return _drafts(spark, d).select("id", F.array_join(routing.issuers(F.col("question"), ALIASES), ",").alias("issuers"))


def split_gate(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return _drafts(spark, d).select("id", routing.is_comparative(q).alias("comparative"), routing.periods(q).alias("periods"), routing.worth_splitting(q, ALIASES).alias("split"))


def implied_filters(spark: SparkSession, d: str) -> DataFrame:
    f = routing.implied_filters(F.col("question"), ALIASES)
    x = _drafts(spark, d).select("id", f.alias("f"))
    return x.select("id", F.col("f.ticker").alias("ticker"), F.col("f.form").alias("form"), F.array_join("f.years", ",").alias("years"))


def filter_union(spark: SparkSession, d: str) -> DataFrame:
    s = _answers(spark, d).select("id", "config", "route").where("id is not null")
    rows = s.select(F.col("id").alias("query_id"), F.explode(F.array(F.struct(F.lit("config").alias("field"), F.lit("scalar").alias("kind"), F.col("config").alias("value")), F.struct(F.lit("route").alias("field"), F.lit("prefix").alias("kind"), F.col("route").alias("value")))).alias("x")).select("query_id", "x.*")
    return filters.union_filters(rows).select("query_id", "field", F.array_join("values", ",").alias("values"))


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "source", "ticker", "form", "date").distinct()
    return c.where(filters.compile_filter(c, {"source": ["edgar", "fomc"], "ticker": None, "date": {"prefix": ("2022", "2023")}})).select("chunk_id")


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spans = ev.gold_spans(table(spark, d, "drafts_multihop"))
    return spans, ev.span_matches(spans, table(spark, d, "chunks"))


def overlap_fraction(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d)[1]
    return m.groupBy("id", "span_no", "chunk_id").agg(F.round(F.max("overlap"), 6).alias("overlap"), F.max("contradiction").alias("contradiction"), F.max("hit").alias("hit"))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    spans, m = _matches(spark, d)
    one = spans.select("id", "span_no").distinct()
    return ev.span_ranks(fusion.ranked_lists(table(spark, d, "hits")), one, m)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return ev.recall_at_k(_ranks(spark, d), K).withColumn("recall", F.round("recall", 6))


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return ev.reciprocal_rank(_ranks(spark, d)).groupBy("retriever").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("questions"))


def recall_by_span_tier(spark: SparkSession, d: str) -> DataFrame:
    return ev.recall_by_tier(ev.recall_at_k(_ranks(spark, d), K)).withColumn("recall", F.round("recall", 6))


def recall_macro_micro_wilson(spark: SparkSession, d: str) -> DataFrame:
    s = ev.recall_summary(ev.recall_at_k(_ranks(spark, d), K))
    return s.withColumns({c: F.round(c, 6) for c in ("macro", "micro", "low", "high")})


def retrievability_ceiling(spark: SparkSession, d: str) -> DataFrame:
    spans, m = _matches(spark, d)
    found = m.where("hit").select("id", "span_no").distinct().withColumn("ok", F.lit(1))
    per = spans.select("id", "span_no").distinct().join(found, ["id", "span_no"], "left").groupBy("id").agg(F.avg(F.coalesce("ok", F.lit(0))).alias("r"))
    return per.agg(F.count("*").alias("questions"), F.round(F.avg("r"), 6).alias("ceiling"))


def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).where("answer is not null").select("trace_id", ev.answer_audit(F.col("answer"), F.lit(SOURCES)).alias("x"))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return a.select("trace_id", text(F.col("x.used")).alias("used"), text(F.col("x.invalid")).alias("invalid"), F.col("x.uncited").alias("uncited"))


def citation_validity_density(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("answer")
    return _answers(spark, d).where("answer is not null").select("trace_id", F.round(ev.citation_validity(a, F.lit(SOURCES)), 6).alias("validity"), F.round(ev.citation_density(a), 6).alias("density"), ev.uncited_claims(a).alias("uncited_claims"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).join(_drafts(spark, d), "id")


def abstention_pair(spark: SparkSession, d: str) -> DataFrame:
    r = ev.abstention(_records(spark, d), "config", F.col("type").isin("unanswerable", "out_of_scope"))
    return r.withColumns({c: F.round(c, 6) for c in ("abstention_recall", "over_refusal")})


def route_accuracy(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("ok", ev.route_matches(F.split("route", r"\+"), F.col("expected_source")))
    return r.groupBy("config").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), F.count("ok").alias("labelled"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ev.latency(_answers(spark, d), "config", "retrieval_ms").withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def latest_run_per_prefix(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).where("config is not null")
    return a.groupBy(F.substring_index("config", "_", 1).alias("prefix")).agg(F.max_by("trace_id", F.struct("logged_at", "trace_id")).alias("latest"))


def widest_run_wins(spark: SparkSession, d: str) -> DataFrame:
    runs = _answers(spark, d).groupBy("config", F.to_date("asked_at").cast("string").alias("day")).agg(F.count("*").alias("n_questions"))
    return runs.groupBy("config").agg(F.max(F.struct("n_questions", "day")).alias("x")).select("config", "x.*")


def _metrics(spark: SparkSession, d: str, config: str) -> DataFrame:
    r = _records(spark, d).where(F.col("config") == config)
    ok = ev.route_matches(F.split("route", r"\+"), F.col("expected_source")).cast("int")
    s = r.agg(F.avg(ok).alias("route_accuracy"), F.avg(ev.citation_validity(F.col("answer"), F.lit(SOURCES))).alias("citation_validity"), F.avg(ev.refused(F.col("answer")).cast("int")).alias("over_refusal_rate"), F.lit(None).cast("double").alias("mrr"))
    return s.unpivot([], ["route_accuracy", "citation_validity", "over_refusal_rate", "mrr"], "metric", "value")


def gate_enforce(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([(s,) for s in ("route_accuracy=0.2", "citation_validity=0.99", "mrr=0.1", "recall_at_5=0.5", "route_accuracy", "route_accuracy=high", "over_refusal_rate=")], "spec string")
    return ev.enforce(specs, _metrics(spark, d, "semantic_hybrid_rerank"))


def baseline_regression(spark: SparkSession, d: str) -> DataFrame:
    tracked = spark.createDataFrame(sorted(ev.TRACKED.items()), "metric string, better string")
    return ev.regressions(_metrics(spark, d, "semantic_hybrid_rerank"), _metrics(spark, d, "fixed_dense"), tracked, 0.005)


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    spans, m = _matches(spark, d)
    lists = fusion.ranked_lists(table(spark, d, "hits")).where(F.col("retriever") == "rerank").where(F.col("pos") <= K)
    hit = lists.select(F.col("query_id").alias("id"), "chunk_id").join(m.where("hit").select("id", "chunk_id"), ["id", "chunk_id"], "left_semi").select("id").distinct().withColumn("gold", F.lit(True))
    gold = spans.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(T.figures(F.col("snippet"))))).alias("gf"))  # the spans of one question
    r = _records(spark, d).join(hit, "id", "left").join(gold, "id", "left")
    none = F.array().cast("array<string>")
    cause = ev.failure_cause(F.split("route", r"\+"), F.col("expected_source"), F.coalesce("gold", F.lit(False)), ev.refused(F.col("answer")), F.coalesce("gf", none), T.figures(F.coalesce("answer", F.lit(""))))
    return r.groupBy("config", cause.alias("cause")).agg(F.count("*").alias("n"))


def golden_violations(spark: SparkSession, d: str) -> DataFrame:
    drafts, chunks = table(spark, d, "drafts_multihop"), table(spark, d, "chunks")
    m = ev.span_matches(ev.gold_spans(drafts), chunks)
    return ev.golden_violations(drafts, m, chunks)


def question_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = ev.gold_spans(table(spark, d, "drafts_multihop")).join(_drafts(spark, d).select("id", "question"), "id")
    o = s.select("id", "span_no", T.question_overlap(F.col("question"), F.col("snippet")).alias("o"))
    return o.groupBy("id", "span_no").agg(F.round(F.max("o"), 6).alias("overlap"), (F.max("o") >= 0.8).alias("trivial"))


def verbatim_check(spark: SparkSession, d: str) -> DataFrame:
    s = ev.gold_spans(table(spark, d, "drafts_multihop"))
    c = table(spark, d, "chunks").where("text is not null").select("doc_id", "text").distinct()
    return s.join(c, "doc_id").groupBy("id", "span_no").agg(F.max(T.verbatim(F.col("snippet"), F.col("text"))).alias("verbatim"))


def bootstrap_paired(spark: SparkSession, d: str) -> DataFrame:
    r = ev.recall_at_k(_ranks(spark, d), K).where(F.col("retriever").isin("bm25", "dense"))
    pair = r.groupBy("id").agg(F.max(F.when(F.col("retriever") == "bm25", F.col("recall"))).alias("a"), F.max(F.when(F.col("retriever") == "dense", F.col("recall"))).alias("b")).where("a is not null and b is not null")
    size = pair.agg(F.count("*").alias("n"))
    # a number for each question, by rank over the ids: questions are few beside the data they are asked of
    at = pair.withColumn("at", F.row_number().over(ev.Window.orderBy("id")) - 1).crossJoin(F.broadcast(size)).select(F.lit("all").alias("g"), F.col("at").cast("long").alias("at"), "n", (F.col("b") - F.col("a")).alias("delta"))
    at = checkpointed(at)
    ends = bootstrap_interval(bootstrap_means(at, "g", ["delta"], ROUNDS), "g", "delta", ROUNDS)
    out = at.agg(F.avg("delta").alias("delta"), F.count("*").alias("n")).join(F.broadcast(ends), F.lit(True), "left")  # one row each
    low, high = F.round("low", 6), F.round("high", 6)
    return out.select(F.round("delta", 6).alias("delta"), low.alias("low"), high.alias("high"), F.round("p_better", 6).alias("p_better"), "n", ((low > 0) | (high < 0)).alias("resolved"))


def recall_macro_interval(spark: SparkSession, d: str) -> DataFrame:
    """retriever, macro, low, high: the mean recall with its own bootstrap interval, questions being resampled."""
    r = ev.recall_at_k(_ranks(spark, d), K)
    size = r.groupBy("retriever").agg(F.count("*").alias("n"), F.avg("recall").alias("macro"))
    at = r.withColumn("at", F.row_number().over(ev.Window.partitionBy("retriever").orderBy("id")) - 1).join(F.broadcast(size), "retriever")  # a row for each retriever
    at = checkpointed(at.select("retriever", F.col("at").cast("long").alias("at"), "n", "macro", "recall"))
    ends = bootstrap_interval(bootstrap_means(at, "retriever", ["recall"], ROUNDS), "retriever", "recall", ROUNDS)
    return at.select("retriever", F.round("macro", 6).alias("macro")).distinct().join(ends, "retriever").select("retriever", "macro", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "answers").where("route_reason is not null")
    return nearest_rank_by(a, "route_reason", "generation_ms", 0.95).withColumnRenamed("generation_ms", "p95")


def disparity_screen(spark: SparkSession, d: str) -> DataFrame:
    s = screen.screen(screen.resolved(table(spark, d, "complaints")), "relief", 20)
    return s.withColumns({c: F.round(c, 6) for c in ("rate", "ci_low", "ci_high", "baseline_rate", "difference", "z", "p_value")})


def disparity_bh(spark: SparkSession, d: str) -> DataFrame:
    s = screen.adjusted(screen.screen(screen.resolved(table(spark, d, "complaints")), "relief", 20), 0.05)
    return s.select("company", "product", F.round("q_value", 6).alias("q_value"), "flagged")


def disparity_report(spark: SparkSession, d: str) -> DataFrame:
    r = screen.report(screen.adjusted(screen.screen(screen.resolved(table(spark, d, "complaints")), "relief", 20), 0.05))
    return r.withColumns({c: F.round(c, 6) for c in ("share", "median_flagged", "median_quiet")})


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    t = ingest.tumbling(table(spark, d, "events"))
    return t.select("event_type", F.col("start").cast("string").alias("start"), "n", F.round("total", 4).alias("total"))


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.sessions(table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        route_heuristic, issuer_detect, split_gate, implied_filters, filter_union, metadata_filter, overlap_fraction, recall_at_k, mrr, recall_by_span_tier, recall_macro_micro_wilson, retrievability_ceiling, citation_audit, citation_validity_density, abstention_pair, route_accuracy,
        latency_percentiles, nearest_rank_p95, latest_run_per_prefix, widest_run_wins, gate_enforce, baseline_regression, failure_taxonomy, golden_violations, question_overlap, verbatim_check, bootstrap_paired, recall_macro_interval, disparity_screen, disparity_bh, disparity_report, events_tumbling, events_sessions,
    )
    return {f.__name__: f for f in fs}


_DRAFTS = "dr AS (SELECT id, x.a AS question, x.b AS ground_truth, x.c AS type, x.d AS expected_source FROM (SELECT id, max({'a': question, 'b': ground_truth, 'c': type, 'd': expected_source}) AS x FROM drafts_multihop WHERE id IS NOT NULL GROUP BY id))"
_ANSWERS = "an AS (SELECT trace_id, id, answer, abstained, route, config, retrieval_ms, generation_ms, logged_at, asked_at FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY logged_at DESC NULLS LAST, coalesce(answer, '') DESC) AS rn FROM answers) WHERE rn = 1)"
_RECORDS = f"{_DRAFTS}, {_ANSWERS}, rc AS (SELECT an.*, dr.question, dr.ground_truth, dr.type, dr.expected_source FROM an JOIN dr ON an.id = dr.id)"
_NUM = r"list_distinct(list_transform(regexp_extract_all(replace({}, ',', ''), '\d+(?:\.\d+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END))"
_GRAMS = "CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) <= {n} THEN [array_to_string({w}, ' ')] ELSE list_distinct(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n} - 1], ' '))) END"
_SPANS = "sp AS (SELECT DISTINCT id, CAST(i - 1 AS INTEGER) AS span_no, gold_spans[i].doc_id AS doc_id, gold_spans[i].snippet AS snippet FROM (SELECT id, gold_spans, unnest(range(1, len(gold_spans) + 1)) AS i FROM drafts_multihop) WHERE gold_spans[i].snippet IS NOT NULL)"
_MATCH = f"""{_SPANS},
cs AS (SELECT DISTINCT chunk_id, doc_id, coalesce(text, '') AS text FROM chunks WHERE chunk_id IS NOT NULL),
m0 AS (SELECT id, span_no, chunk_id, regexp_extract_all(lower(snippet), '[a-z0-9]+') AS gw, regexp_extract_all(lower(text), '[a-z0-9]+') AS cw, {_NUM.format('snippet')} AS gf, {_NUM.format('text')} AS cf FROM sp JOIN cs USING (doc_id)),
m1 AS (SELECT *, least(10, len(gw)) AS n FROM m0), m2 AS (SELECT *, {_GRAMS.format(w='gw', n='n')} AS gg, {_GRAMS.format(w='cw', n='n')} AS cg FROM m1),
mt AS (SELECT id, span_no, chunk_id, CASE WHEN len(gw) = 0 OR len(cw) = 0 THEN 0 ELSE len(list_intersect(gg, cg)) / len(gg) END AS overlap, len(gf) > 0 AND len(cf) > 0 AND NOT list_has_any(gf, cf) AS contradiction FROM m2)"""
_RANKS = f"""{_MATCH}, {_LISTS},
ht AS (SELECT DISTINCT id, span_no, chunk_id FROM mt WHERE overlap > 0 AND NOT contradiction),
s1 AS (SELECT DISTINCT id, span_no FROM sp), ru AS (SELECT DISTINCT query_id AS id, retriever FROM ls),
bp AS (SELECT query_id AS id, retriever, span_no, min(pos) AS pos FROM ls JOIN ht ON ls.query_id = ht.id AND ls.chunk_id = ht.chunk_id GROUP BY ALL),
rk AS (SELECT ru.id, ru.retriever, s1.span_no, bp.pos FROM ru JOIN s1 USING (id) LEFT JOIN bp USING (id, retriever, span_no)),
re AS (SELECT id, retriever, count(*) AS spans, count(*) FILTER (WHERE pos <= {K}) AS found, count(*) FILTER (WHERE pos <= {K}) / count(*) AS recall FROM rk GROUP BY ALL)"""


def _terms(terms: tuple[str, ...]) -> str:
    body = "|".join(routing._escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return f"len(list_distinct(regexp_extract_all(lower(question), '\\b(?:{body})s?\\b')))"


_COMP = rf"regexp_matches(lower(question), '\b(?:{routing.COMPARATIVE})\b')"
_MARKS = r"list_distinct(list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda x: CAST(x AS BIGINT)))"
_CLAIMS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) > 4 AND NOT regexp_matches(s, '^\s*(?:#{1,6}\s|\*{1,2}[^*]+\*{1,2}\s*:?\s*$|[-*+]\s*$|\d+[.)]\s*$)'))"
_VALID = f"CASE WHEN len({_MARKS}) > 0 THEN len(list_filter({_MARKS}, lambda m: m BETWEEN 1 AND {SOURCES})) / len({_MARKS}) END"
_ROUTE_OK = "CASE WHEN len(coalesce(expected_source, [])) > 0 THEN list_sort(list_distinct(string_split(route, '+'))) = list_sort(list_distinct(expected_source)) END"


def _metric_sql(name: str, config: str) -> str:
    return f"""{name} AS (UNPIVOT (SELECT avg(CAST({_ROUTE_OK} AS INTEGER)) AS route_accuracy, avg({_VALID}) AS citation_validity, avg(CAST(starts_with(regexp_replace(coalesce(answer, ''), '^\\s+', ''), 'INSUFFICIENT_CONTEXT') AS INTEGER)) AS over_refusal_rate FROM rc WHERE config = '{config}') ON route_accuracy, citation_validity, over_refusal_rate INTO NAME metric VALUE value)"""


def _erfc(x: str) -> str:
    t = f"(1 / (1 + {x} / 2))"
    poly = f"CAST({ERFC[-1]} AS DOUBLE)"
    for c in reversed(ERFC[:-1]):
        poly = f"(CAST({c} AS DOUBLE) + {t} * {poly})"
    return f"{t} * exp(-{x} * {x} + {poly})"


_SCREEN = f"""
co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY date_received DESC NULLS LAST, product DESC NULLS LAST, sub_product DESC NULLS LAST, issue DESC NULLS LAST, sub_issue DESC NULLS LAST, company DESC NULLS LAST, state DESC NULLS LAST, zip_code DESC NULLS LAST, company_response DESC NULLS LAST, company_public_response DESC NULLS LAST, timely DESC NULLS LAST, submitted_via DESC NULLS LAST, tags DESC NULLS LAST) AS rn FROM complaints) WHERE rn = 1 AND coalesce(company_response <> 'In progress', true)),
ce AS (SELECT company, product, count(*) AS n, count(*) FILTER (WHERE company_response IN ('Closed with monetary relief', 'Closed with non-monetary relief')) AS h FROM co WHERE company IS NOT NULL AND product IS NOT NULL GROUP BY ALL),
cb AS (SELECT *, CAST(sum(n) OVER (PARTITION BY product) - n AS BIGINT) AS bn, CAST(sum(h) OVER (PARTITION BY product) - h AS BIGINT) AS bh FROM ce),
cc AS (SELECT *, h / n AS rate, bh / bn AS base, (h + bh) / (n + bn) AS pool, CAST({Z95_EXACT} AS DOUBLE) AS zz FROM cb WHERE n >= 20 AND bn >= 20),
cz AS (SELECT *, CASE WHEN pool > 0 AND pool < 1 THEN (rate - base) / sqrt(pool * (1 - pool) * (CAST(1 AS DOUBLE) / n + CAST(1 AS DOUBLE) / bn)) END AS z FROM cc),
sc AS (SELECT company, product, n, rate, greatest(0, ((rate + zz * zz / (2 * n)) - zz * sqrt(rate * (1 - rate) / n + zz * zz / (4 * CAST(n AS DOUBLE) * n))) / (1 + zz * zz / n)) AS ci_low, least(1, ((rate + zz * zz / (2 * n)) + zz * sqrt(rate * (1 - rate) / n + zz * zz / (4 * CAST(n AS DOUBLE) * n))) / (1 + zz * zz / n)) AS ci_high,
  base AS baseline_rate, bn AS baseline_n, rate - base AS difference, z, {_erfc('(abs(z) / sqrt(CAST(2 AS DOUBLE)))')} AS p_value FROM cz),
bq AS (SELECT *, p_value * count(*) OVER () / (rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1) AS q0 FROM sc WHERE p_value IS NOT NULL),
bh AS (SELECT *, least(1, min(q0) OVER (ORDER BY p_value RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM bq)"""


def oracle_sql() -> dict[str, str]:
    fs, cs = _terms(routing.FILINGS_TERMS), _terms(routing.COMPLAINTS_TERMS)
    sure = f"(NOT (({fs} > 0) <> ({cs} > 0) AND {_COMP}) AND ({fs} > 0 OR {cs} > 0))"
    issuers = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(question, '(?:^|[^A-Za-z]){t}(?:[^A-Za-z]|$)') OR regexp_matches(lower(question), '\\b(?:{'|'.join(names)})\\b') THEN '{t}' END" for t, names in sorted(ALIASES.items())) + "], lambda x: x IS NOT NULL)"
    periods = r"len(list_distinct(regexp_extract_all(question, '\b(?:19|20)\d{2}\b'))) + len(list_distinct(list_transform(regexp_extract_all(question, '(?i)\b(?:q[1-4]|(?:first|second|third|fourth) quarter)\b'), lambda x: lower(x))))"
    return {
        "route_heuristic": f"WITH {_DRAFTS} SELECT id, CASE WHEN {sure} AND {fs} > 0 AND {cs} = 0 THEN 'filings' WHEN {sure} AND {fs} = 0 THEN 'complaints' ELSE 'filings+complaints' END AS collections, CASE WHEN {sure} THEN 'heuristic' ELSE 'fan_out' END AS method FROM dr",
        "issuer_detect": f"WITH {_DRAFTS} SELECT id, array_to_string({issuers}, ',') AS issuers FROM dr",
        "split_gate": f"WITH {_DRAFTS} SELECT id, {_COMP} AS comparative, CAST({periods} AS INTEGER) AS periods, len({issuers}) >= 2 OR {_COMP} OR {periods} >= 2 AS split FROM dr",
        "implied_filters": rf"""WITH {_DRAFTS}, e AS (SELECT *, '(?i)(\b(?:19|20)\d{{2}})\s+(10-?K|10-?Q|8-?K)|(10-?K|10-?Q|8-?K)[^.]{{0,40}}?\b((?:19|20)\d{{2}})' AS p FROM dr),
g AS (SELECT id, question, regexp_extract_all(question, p, 1) AS a, regexp_extract_all(question, p, 2) AS b, regexp_extract_all(question, p, 3) AS c, regexp_extract_all(question, p, 4) AS d, {issuers} AS who,
  list_distinct(list_transform(regexp_extract_all(question, '(?i)\b(?:10-?K|10-?Q|8-?K)\b'), lambda x: regexp_replace(replace(upper(x), '-', ''), '^(\d+)', '\1-'))) AS forms FROM e),
n AS (SELECT *, list_distinct(list_transform(range(1, len(a) + 1), lambda i: coalesce(nullif(a[i], ''), d[i]) || ' ' || regexp_replace(replace(upper(coalesce(nullif(b[i], ''), c[i])), '-', ''), '^(\d+)', '\1-'))) AS named FROM g)
SELECT id, CASE WHEN len(who) = 1 THEN who[1] END AS ticker, CASE WHEN len(named) = 1 THEN substring(named[1], 6) WHEN len(forms) = 1 THEN forms[1] END AS form,
CASE WHEN len(named) = 1 THEN left(named[1], 4) || ',' || CAST(CAST(left(named[1], 4) AS INTEGER) + 1 AS VARCHAR) ELSE NULL END AS years FROM n""",
        "filter_union": f"WITH {_ANSWERS} SELECT id AS query_id, 'config' AS field, array_to_string(list_sort(list(DISTINCT config)), ',') AS \"values\" FROM an WHERE id IS NOT NULL GROUP BY id",
        "metadata_filter": "SELECT DISTINCT chunk_id FROM (SELECT DISTINCT chunk_id, source, ticker, form, date FROM chunks) WHERE source IN ('edgar', 'fomc') AND ticker IS NULL AND (starts_with(date, '2022') OR starts_with(date, '2023'))",
        "overlap_fraction": f"WITH {_MATCH} SELECT id, span_no, chunk_id, round(max(overlap), 6) AS overlap, bool_or(contradiction) AS contradiction, bool_or(overlap > 0 AND NOT contradiction) AS hit FROM mt GROUP BY ALL",
        "recall_at_k": f"WITH {_RANKS} SELECT id, retriever, spans, found, round(recall, 6) AS recall FROM re",
        "mrr": f"WITH {_RANKS} SELECT retriever, round(avg(rr), 6) AS mrr, count(*) AS questions FROM (SELECT id, retriever, coalesce(CAST(1 AS DOUBLE) / min(pos), 0) AS rr FROM rk GROUP BY ALL) GROUP BY 1",
        "recall_by_span_tier": f"WITH {_RANKS} SELECT retriever, CAST(least(spans, 2) AS INTEGER) AS tier, count(*) AS questions, round(avg(recall), 6) AS recall FROM re GROUP BY 1, 2",
        "recall_macro_micro_wilson": f"""WITH {_RANKS}, su AS (SELECT retriever, count(*) AS questions, avg(recall) AS macro, CAST(sum(found) AS DOUBLE) AS f, CAST(sum(spans) AS DOUBLE) AS n, CAST(1.96 AS DOUBLE) AS z FROM re GROUP BY 1), sv AS (SELECT *, f / n AS p FROM su)
SELECT retriever, questions, round(macro, 6) AS macro, round(p, 6) AS micro, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM sv""",
        "retrievability_ceiling": f"WITH {_MATCH}, f AS (SELECT DISTINCT id, span_no FROM mt WHERE overlap > 0 AND NOT contradiction) SELECT count(*) AS questions, round(avg(r), 6) AS ceiling FROM (SELECT s.id, avg(CASE WHEN f.id IS NULL THEN 0 ELSE 1 END) AS r FROM (SELECT DISTINCT id, span_no FROM sp) s LEFT JOIN f USING (id, span_no) GROUP BY s.id)",
        "citation_audit": rf"""WITH {_ANSWERS}, c AS (SELECT trace_id, answer, list_filter(list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda x, i: CASE WHEN list_position(regexp_extract_all(answer, '\[S(\d+)\]', 1), x) = i THEN CAST(x AS BIGINT) END), lambda x: x IS NOT NULL) AS m FROM an WHERE answer IS NOT NULL)
SELECT trace_id, array_to_string(list_filter(m, lambda x: x BETWEEN 1 AND {SOURCES}), ',') AS used, array_to_string(list_filter(m, lambda x: NOT x BETWEEN 1 AND {SOURCES}), ',') AS invalid,
CAST(len(list_filter(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 5 AND NOT regexp_matches(s, '\[S(\d+)\]'))) AS INTEGER) AS uncited FROM c""",
        "citation_validity_density": rf"WITH {_ANSWERS} SELECT trace_id, round({_VALID}, 6) AS validity, round(len(regexp_extract_all(answer, '\[S(\d+)\]', 1)) / greatest(len({_CLAIMS}), 1), 6) AS density, CAST(len(list_filter({_CLAIMS}, lambda s: NOT regexp_matches(s, '\[S(\d+)\]'))) AS INTEGER) AS uncited_claims FROM an WHERE answer IS NOT NULL",
        "abstention_pair": rf"WITH {_RECORDS}, x AS (SELECT config, coalesce(type IN ('unanswerable', 'out_of_scope'), false) AS neg, starts_with(regexp_replace(coalesce(answer, ''), '^\s+', ''), 'INSUFFICIENT_CONTEXT') AS no FROM rc) SELECT config, round(count(*) FILTER (WHERE neg AND no) / greatest(count(*) FILTER (WHERE neg), 1), 6) AS abstention_recall, round(count(*) FILTER (WHERE NOT neg AND no) / greatest(count(*) FILTER (WHERE NOT neg), 1), 6) AS over_refusal FROM x GROUP BY config",
        "route_accuracy": f"WITH {_RECORDS}, x AS (SELECT config, {_ROUTE_OK} AS ok FROM rc) SELECT config, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy, count(ok) AS labelled FROM x GROUP BY config",
        "latency_percentiles": f"""WITH {_ANSWERS}, g AS (SELECT config, list_sort(list(retrieval_ms)) AS v, count(*) AS n FROM an WHERE retrieval_ms IS NOT NULL GROUP BY config), j AS (SELECT *, least(greatest(95 * (n + 1) // 100, 1), greatest(n - 1, 1)) AS j FROM g)
SELECT config, n, round(list_aggregate(v, 'median'), 6) AS p50, round(CASE WHEN n = 1 THEN v[1] ELSE (v[j] * (100 - (95 * (n + 1) - 100 * j)) + v[j + 1] * (95 * (n + 1) - 100 * j)) / 100 END, 6) AS p95 FROM j""",
        "nearest_rank_p95": """SELECT route_reason, v[least(len(v), CAST(floor(CAST(0.95 AS DOUBLE) * len(v)) AS BIGINT) + 1)] AS p95 FROM (SELECT route_reason, list_sort(list(generation_ms) FILTER (WHERE generation_ms IS NOT NULL)) AS v FROM answers WHERE route_reason IS NOT NULL GROUP BY 1)""",
        "latest_run_per_prefix": f"WITH {_ANSWERS} SELECT split_part(config, '_', 1) AS prefix, arg_max(trace_id, {{'a': logged_at, 'b': trace_id}}) AS latest FROM an WHERE config IS NOT NULL GROUP BY 1",
        "widest_run_wins": f"WITH {_ANSWERS}, r AS (SELECT config, strftime(asked_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM an GROUP BY ALL) SELECT config, n AS n_questions, day FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY n DESC, day DESC NULLS LAST) AS rn FROM r) WHERE rn = 1",
        "gate_enforce": f"""WITH {_RECORDS}, {_metric_sql('mm', 'semantic_hybrid_rerank')}, v AS (SELECT metric, value FROM mm)
SELECT * FROM (VALUES ('mrr=0.1', 'not measured'), ('recall_at_5=0.5', 'unknown'), ('route_accuracy', 'malformed'), ('route_accuracy=high', 'malformed'), ('over_refusal_rate=', 'malformed')) t(spec, verdict)
UNION ALL SELECT 'route_accuracy=0.2', CASE WHEN value < 0.2 THEN 'below' ELSE 'ok' END FROM v WHERE metric = 'route_accuracy' UNION ALL SELECT 'citation_validity=0.99', CASE WHEN value < 0.99 THEN 'below' ELSE 'ok' END FROM v WHERE metric = 'citation_validity'""",
        "baseline_regression": f"""WITH {_RECORDS}, {_metric_sql('ma', 'semantic_hybrid_rerank')}, {_metric_sql('mb', 'fixed_dense')}
SELECT metric, CASE WHEN (CASE WHEN metric = 'over_refusal_rate' THEN ma.value - mb.value ELSE mb.value - ma.value END) > 0.005 THEN 'regressed' ELSE 'ok' END AS verdict FROM ma JOIN mb USING (metric) UNION ALL SELECT 'mrr', 'not measured'""",
        "failure_taxonomy": rf"""WITH {_RECORDS}, {_MATCH}, {_LISTS},
gd AS (SELECT DISTINCT query_id AS id FROM ls JOIN (SELECT DISTINCT id, chunk_id FROM mt WHERE overlap > 0 AND NOT contradiction) h ON ls.query_id = h.id AND ls.chunk_id = h.chunk_id WHERE retriever = 'rerank' AND pos <= {K}),
gf AS (SELECT id, list_distinct(flatten(list({_NUM.format('snippet')}))) AS gf FROM sp GROUP BY id),
x AS (SELECT rc.config, len(coalesce(expected_source, [])) > 0 AND NOT coalesce(list_has_any(string_split(route, '+'), expected_source), false) AS lost, gd.id IS NOT NULL AS gold, starts_with(regexp_replace(coalesce(answer, ''), '^\s+', ''), 'INSUFFICIENT_CONTEXT') AS no, coalesce(gf.gf, []) AS gf, {_NUM.format("coalesce(answer, '')")} AS af FROM rc LEFT JOIN gd ON gd.id = rc.id LEFT JOIN gf ON gf.id = rc.id)
SELECT config, CASE WHEN lost THEN 'routing error' WHEN NOT gold AND no THEN 'retrieval miss (abstained)' WHEN NOT gold THEN 'retrieval miss (answered anyway)' WHEN no THEN 'over-refusal' WHEN len(gf) > 0 AND NOT list_has_any(gf, af) THEN 'wrong synthesis (>= floor)' ELSE 'correct' END AS cause, count(*) AS n FROM x GROUP BY ALL""",
        "golden_violations": f"""WITH {_MATCH}, d AS (SELECT id, x.a AS question, x.b AS type, x.c AS gold_spans FROM (SELECT id, max({{'a': question, 'b': type, 'c': gold_spans}}) AS x FROM drafts_multihop GROUP BY id)),
k AS (SELECT id, array_to_string(list_sort(regexp_extract_all(lower(question), '[a-z0-9]+')), ' ') AS k FROM d), hh AS (SELECT DISTINCT id, span_no FROM mt WHERE overlap > 0 AND NOT contradiction)
SELECT DISTINCT * FROM (SELECT 'negative with spans' AS problem, id FROM d WHERE type IN ('unanswerable', 'out_of_scope') AND len(coalesce(gold_spans, [])) > 0 UNION ALL SELECT 'positive without spans', id FROM d WHERE NOT type IN ('unanswerable', 'out_of_scope') AND len(coalesce(gold_spans, [])) = 0
UNION ALL SELECT 'duplicate question', id FROM k WHERE k.k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1) UNION ALL SELECT 'document absent', id FROM sp WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = sp.doc_id)
UNION ALL SELECT 'span not found', id FROM sp WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = sp.doc_id) AND (id, span_no) NOT IN (SELECT (id, span_no) FROM hh))""",
        "question_overlap": f"WITH {_SPANS}, {_DRAFTS}, x AS (SELECT sp.id, span_no, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS q, regexp_extract_all(lower(snippet), '[a-z0-9]+') AS s FROM sp JOIN dr USING (id)), y AS (SELECT id, span_no, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, s)) / len(q) END AS o FROM x) SELECT id, span_no, round(max(o), 6) AS overlap, max(o) >= 0.8 AS trivial FROM y GROUP BY ALL",
        "verbatim_check": f"WITH {_SPANS}, c AS (SELECT DISTINCT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS p FROM chunks WHERE text IS NOT NULL), s AS (SELECT id, span_no, doc_id, regexp_extract_all(lower(snippet), '[a-z0-9]+') AS w FROM sp) SELECT id, span_no, bool_or(len(w) >= 10 AND contains(p, ' ' || array_to_string(w, ' ') || ' ')) AS verbatim FROM s JOIN c USING (doc_id) GROUP BY ALL",
        "bootstrap_paired": f"""WITH {_RANKS}, pq AS (SELECT id, max(recall) FILTER (WHERE retriever = 'bm25') AS a, max(recall) FILTER (WHERE retriever = 'dense') AS b FROM re WHERE retriever IN ('bm25', 'dense') GROUP BY id HAVING count(*) = 2),
ob AS (SELECT row_number() OVER (ORDER BY id) - 1 AS place, b - a AS delta, count(*) OVER () AS n FROM pq),
dr AS (SELECT r AS round, CAST(('0x' || left(md5(r || '|' || i), 8)) AS BIGINT) % n AS place FROM range({ROUNDS}) t(r), (SELECT DISTINCT n FROM ob) z, LATERAL (SELECT unnest(range(n)) AS i)),
me AS (SELECT round, avg(delta) AS delta FROM dr JOIN ob USING (place) GROUP BY round), v AS (SELECT list_sort(list(delta)) AS v, avg(CAST(delta > 0 AS INTEGER)) AS p FROM me)
SELECT round((SELECT avg(delta) FROM ob), 6) AS delta, round(v[{int(0.025 * ROUNDS) + 1}], 6) AS low, round(v[{int(0.975 * ROUNDS) + 1}], 6) AS high, round(p, 6) AS p_better, (SELECT count(*) FROM ob) AS n, round(v[{int(0.025 * ROUNDS) + 1}], 6) > 0 OR round(v[{int(0.975 * ROUNDS) + 1}], 6) < 0 AS resolved FROM v""",
        "recall_macro_interval": f"""WITH {_RANKS}, ob AS (SELECT retriever, row_number() OVER (PARTITION BY retriever ORDER BY id) - 1 AS place, recall, count(*) OVER (PARTITION BY retriever) AS n FROM re),
dr AS (SELECT retriever, r AS round, CAST(('0x' || left(md5(r || '|' || i), 8)) AS BIGINT) % n AS place FROM range({ROUNDS}) t(r), (SELECT DISTINCT retriever, n FROM ob) z, LATERAL (SELECT unnest(range(n)) AS i)),
me AS (SELECT retriever, round, avg(recall) AS m FROM dr JOIN ob USING (retriever, place) GROUP BY ALL), v AS (SELECT retriever, list_sort(list(m)) AS v FROM me GROUP BY 1)
SELECT retriever, round(macro, 6) AS macro, round(v[{int(0.025 * ROUNDS) + 1}], 6) AS low, round(v[{int(0.975 * ROUNDS) + 1}], 6) AS high FROM v JOIN (SELECT retriever, avg(recall) AS macro FROM ob GROUP BY 1) USING (retriever)""",
        "disparity_screen": f"WITH {_SCREEN} SELECT company, product, n, round(rate, 6) AS rate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(baseline_rate, 6) AS baseline_rate, baseline_n, round(difference, 6) AS difference, round(z, 6) AS z, round(p_value, 6) AS p_value FROM sc",
        "disparity_bh": f"WITH {_SCREEN} SELECT company, product, round(q_value, 6) AS q_value, q_value <= 0.05 AS flagged FROM bh",
        "disparity_report": f"WITH {_SCREEN} SELECT count(*) AS cells, count(*) FILTER (WHERE p_value < 0.05) AS raw, count(*) FILTER (WHERE q_value <= 0.05) AS flagged, round(count(*) FILTER (WHERE q_value <= 0.05) / count(*), 6) AS share, round(median(abs(difference)) FILTER (WHERE q_value <= 0.05), 6) AS median_flagged, round(median(abs(difference)) FILTER (WHERE q_value > 0.05), 6) AS median_quiet, count(*) FILTER (WHERE q_value <= 0.05) / count(*) > 0.25 AS too_many FROM bh",
        "events_tumbling": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "events_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    }
