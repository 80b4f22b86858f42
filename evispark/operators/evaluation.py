"""Retrieval and answer metrics over tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.functions.stats import exclusive_percentile, wilson
from evispark.operators.once import once_each

SENTINEL = "INSUFFICIENT_CONTEXT"


def gold_spans(drafts: DataFrame) -> DataFrame:
    """id, span_no, doc_id, snippet of each distinct gold span."""
    return drafts.select("id", F.posexplode("gold_spans").alias("span_no", "s")).select("id", "span_no", F.col("s.doc_id").alias("doc_id"), F.col("s.snippet").alias("snippet")).where("snippet is not null").distinct()


def overlap_of(gold_words: Column, chunk_words: Column) -> Column:
    """Share of the gold n-grams (n at most 10, at most the gold's length) that the chunk holds; 0 without words."""
    n = F.least(F.lit(T.NGRAM), F.size(gold_words))
    gold = T.word_ngrams(gold_words, n)
    common = F.size(F.array_intersect(gold, T.word_ngrams(chunk_words, n))) / F.size(gold)
    return F.when((F.size(gold_words) == 0) | (F.size(chunk_words) == 0), F.lit(0.0)).otherwise(common)


def span_matches(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, span_no, chunk_id, overlap, contradiction, hit for spans and chunks of one document.

    Words, n-grams and figures come from built-in array functions; the equality on doc_id comes first, so each span
    meets only its document's chunks.
    """
    c = chunks.where("chunk_id is not null").select("chunk_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    c = once_each(c).select("chunk_id", "doc_id", T.metric_words(F.col("text")).alias("cw"), T.figures(F.col("text")).alias("cf"))
    s = spans.select("id", "span_no", "doc_id", T.metric_words(F.col("snippet")).alias("gw"), T.figures(F.col("snippet")).alias("gf"))
    m = s.join(c, "doc_id").select("id", "span_no", "chunk_id", overlap_of(F.col("gw"), F.col("cw")).alias("overlap"), T.contradicts(F.col("cf"), F.col("gf")).alias("contradiction"))
    return m.withColumn("hit", (F.col("overlap") > 0) & ~F.col("contradiction"))


def span_ranks(lists: DataFrame, spans: DataFrame, matches: DataFrame) -> DataFrame:
    """id, retriever, span_no, pos: the best place of a hit of each span in each list of its question; null where there is none."""
    runs = lists.select(F.col("query_id").alias("id"), "retriever").distinct()
    hits = matches.where("hit").select("id", "span_no", "chunk_id")
    found = lists.select(F.col("query_id").alias("id"), "retriever", "chunk_id", "pos").join(hits, ["id", "chunk_id"]).groupBy("id", "retriever", "span_no").agg(F.min("pos").alias("pos"))
    return runs.join(spans.select("id", "span_no"), "id").join(found, ["id", "retriever", "span_no"], "left")


def recall_at_k(ranks: DataFrame, k: int) -> DataFrame:
    """id, retriever, spans, found, recall."""
    return ranks.groupBy("id", "retriever").agg(F.count("*").alias("spans"), F.count_if(F.col("pos") <= k).alias("found")).withColumn("recall", F.col("found") / F.col("spans"))


def reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """id, retriever, rr: over whole lists; 0 without a hit."""
    return ranks.groupBy("id", "retriever").agg(F.coalesce(F.lit(1.0) / F.min("pos"), F.lit(0.0)).alias("rr"))


def recall_summary(recalls: DataFrame) -> DataFrame:
    """retriever, questions, macro, micro, low, high: the mean of the questions, the share of all spans, and the latter's interval."""
    low, high = wilson(F.col("found"), F.col("spans"))
    s = recalls.groupBy("retriever").agg(F.count("*").alias("questions"), F.avg("recall").alias("macro"), F.sum("found").alias("found"), F.sum("spans").alias("spans"))
    return s.select("retriever", "questions", "macro", (F.col("found") / F.col("spans")).alias("micro"), low.alias("low"), high.alias("high"))


def recall_by_tier(recalls: DataFrame) -> DataFrame:
    """retriever, tier (1, or 2 for more), questions, recall."""
    return recalls.groupBy("retriever", F.least("spans", F.lit(2)).cast("int").alias("tier")).agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"))


def answer_audit(answer: Column, n_sources: Column) -> Column:
    """struct(used, invalid, uncited): cited sources in order, those that don't exist, and sentences of five words or more without a mark."""
    marks = F.array_distinct(F.transform(T.citations(answer), lambda m: F.try_to_number(m, F.lit("9999999999")).cast("long")))
    good = lambda m: (m >= 1) & (m <= n_sources)
    sents = F.filter(F.split(answer, r"(?<=[.!?])\s+"), lambda s: (T.word_count(s) >= 5) & ~s.rlike(T.CITATION))
    return F.struct(F.filter(marks, good).alias("used"), F.filter(marks, lambda m: ~good(m)).alias("invalid"), F.size(sents).alias("uncited"))


def citation_validity(answer: Column, n_sources: Column) -> Column:
    """Share of the different marks that name a source; null without marks."""
    marks = F.array_distinct(F.transform(T.citations(answer), lambda m: F.try_to_number(m, F.lit("9999999999")).cast("long")))
    return F.when(F.size(marks) > 0, F.size(F.filter(marks, lambda m: (m >= 1) & (m <= n_sources))) / F.size(marks))


def citation_density(answer: Column) -> Column:
    return F.size(T.citations(answer)) / F.greatest(F.size(T.claim_sentences(answer)), F.lit(1))


def uncited_claims(answer: Column) -> Column:
    return F.size(F.filter(T.claim_sentences(answer), lambda s: ~s.rlike(T.CITATION)))


def refused(answer: Column) -> Column:
    return F.startswith(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+", ""), F.lit(SENTINEL))


def abstention(records: DataFrame, group: str, negative: Column, answer: str = "answer") -> DataFrame:
    """group, recall (negatives refused), over_refusal (others refused); a missing side counts as 0."""
    no = refused(F.col(answer))
    return records.groupBy(group).agg((F.count_if(negative & no) / F.greatest(F.count_if(negative), F.lit(1))).alias("abstention_recall"), (F.count_if(~negative & no) / F.greatest(F.count_if(~negative), F.lit(1))).alias("over_refusal"))


def route_matches(route: Column, expected: Column) -> Column:
    """Both name the same set of collections; null where nothing is expected."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    return F.when(F.size(F.coalesce(expected, F.array())) > 0, as_set(route) == as_set(expected))


def latency(records: DataFrame, group: str, ms: str) -> DataFrame:
    """group, n, p50, p95: the median and the exclusive 95th percentile. Values are gathered by group as counts of distinct milliseconds."""
    per = records.where(F.col(ms).isNotNull()).groupBy(group, F.col(ms).alias("v")).agg(F.count("*").alias("c"))
    run = Window.partitionBy(group).orderBy("v")
    cum = per.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))

    def at(pos: Column) -> Column:
        return F.min(F.when(F.col("upto") >= pos, F.col("v")))

    n = F.col("n")
    pos95 = F.lit(95) * (n + 1)
    j = F.least(F.greatest(F.floor(pos95 / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    got = cum.groupBy(group, "n").agg(at(F.floor((n + 1) / 2)).alias("lo"), at(F.ceil((n + 1) / 2)).alias("hi"), at(j).alias("a"), at(j + 1).alias("b"))
    d = F.lit(95) * (n + 1) - 100 * F.least(F.greatest(F.floor(F.lit(95) * (n + 1) / 100), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    return got.select(group, "n", ((F.col("lo") + F.col("hi")) / 2).alias("p50"), F.when(n == 1, F.col("lo").cast("double")).otherwise((F.col("a") * (100 - d) + F.col("b") * d) / 100).alias("p95"))


def failure_cause(route: Column, expected: Column, gold_found: Column, said_no: Column, gold_figures: Column, answer_figures: Column) -> Column:
    """The earliest cause that explains a failure."""
    lost = (F.size(F.coalesce(expected, F.array())) > 0) & ~F.coalesce(F.arrays_overlap(route, expected), F.lit(False))
    return (
        F.when(lost, "routing error")
        .when(~gold_found & said_no, "retrieval miss (abstained)")
        .when(~gold_found, "retrieval miss (answered anyway)")
        .when(said_no, "over-refusal")
        .when((F.size(gold_figures) > 0) & ~F.arrays_overlap(gold_figures, answer_figures), "wrong synthesis (>= floor)")
        .otherwise("correct")
    )


def enforce(specs: DataFrame, metrics: DataFrame) -> DataFrame:
    """spec, verdict of each METRIC=VALUE threshold: ok, malformed, unknown, not measured or below. metrics: metric, value."""
    s = specs.select("spec", F.trim(F.regexp_extract("spec", r"^([^=]*)=", 1)).alias("metric"), F.trim(F.regexp_extract("spec", r"^[^=]*=(.*)$", 1)).alias("raw"))
    s = s.withColumn("floor", F.when(F.col("raw").rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.col("raw").cast("double")))
    m = metrics.select(F.col("metric"), F.col("value"), F.lit(True).alias("known"))
    verdict = F.when(F.col("floor").isNull(), "malformed").when(F.col("known").isNull(), "unknown").when(F.col("value").isNull(), "not measured").when(F.col("value") < F.col("floor"), "below").otherwise("ok")
    return s.join(m, "metric", "left").select("spec", verdict.alias("verdict"))


# Tracked metrics and the direction that is better.
TRACKED = {"recall_at_16": "higher", "recall_at_16_micro": "higher", "recall_at_16_single_span": "higher", "recall_at_16_multi_span": "higher", "mrr": "higher", "citation_validity": "higher", "abstention_recall": "higher", "route_accuracy": "higher", "over_refusal_rate": "lower"}


def regressions(run: DataFrame, base: DataFrame, directions: DataFrame, tolerance: float) -> DataFrame:
    """metric, verdict of the tracked metrics that the baseline has: ok, regressed, missing or not measured."""
    b = directions.join(base.select("metric", F.col("value").alias("before")), "metric")
    r = run.select("metric", F.col("value").alias("after"), F.lit(True).alias("there"))
    worse = F.when(F.col("better") == "higher", F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))
    return b.join(r, "metric", "left").select("metric", F.when(F.col("there").isNull(), "missing").when(worse.isNull(), "not measured").when(worse > tolerance, "regressed").otherwise("ok").alias("verdict"))


def golden_violations(drafts: DataFrame, matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """problem, id: duplicate questions, negatives with spans, positives without, documents not in the corpus, spans no chunk holds."""
    d = drafts.groupBy("id").agg(F.max(F.struct("question", "type", "gold_spans")).alias("x")).select("id", "x.*")
    negative = F.col("type").isin("unanswerable", "out_of_scope")
    n = F.size(F.coalesce("gold_spans", F.array()))
    out = [d.where(negative & (n > 0)).select(F.lit("negative with spans").alias("problem"), "id"), d.where(~negative & (n <= 0)).select(F.lit("positive without spans").alias("problem"), "id")]
    same = d.groupBy(T.question_key(F.col("question")).alias("k")).agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).where("n > 1")  # ids of one question
    out.append(same.select(F.lit("duplicate question").alias("problem"), F.explode("ids").alias("id")))
    spans = gold_spans(drafts)
    docs = chunks.select("doc_id").distinct()
    out.append(spans.join(docs, "doc_id", "left_anti").select(F.lit("document absent").alias("problem"), "id"))
    out.append(spans.join(docs, "doc_id", "left_semi").join(matches.where("hit").select("id", "span_no"), ["id", "span_no"], "left_anti").select(F.lit("span not found").alias("problem"), "id"))
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first.distinct()


def latency_of(values: Column) -> Column:
    """Exclusive 95th percentile of a small array."""
    return exclusive_percentile(F.array_sort(values), 95)
