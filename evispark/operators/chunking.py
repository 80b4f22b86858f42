"""Cutting documents into chunks: packed sentences, semantic breaks, sentence windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import metric_words, sentences, word_count
from evispark.operators.once import one_row_each, only_keys


def sentence_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, i (from 0), sentence, cost in words."""
    s = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(sentences(F.col(text))).alias("i", "sentence"))
    return s.withColumn("cost", word_count(F.col("sentence")))


def pack(costs: Sequence[int], budget: int, overlap: int = 0, breaks: Iterable[int] = ()) -> list[tuple[int, int]]:
    """Runs (start, end) of sentences: each costs at most the budget (a lone sentence may cost more) and crosses no break, and shares with the one before it the most whole sentences that cost at most the overlap.

    With c[i] the cost of the first i sentences, the run from a ends at the greatest e with c[e] <= c[a] + budget, and the
    next starts at the least s with c[s] >= c[e] - overlap: two searches in c give both for every a at once.
    """
    n = len(costs)
    c = np.concatenate(([0], np.cumsum(np.asarray(costs, np.int64))))
    after = np.arange(1, n + 1)
    bounds = np.unique([*(b for b in breaks if 0 < b < n), n])
    ends = np.maximum(np.searchsorted(c, c[:-1] + budget, side="right") - 1, after)
    ends = np.minimum(ends, bounds[np.searchsorted(bounds, after)])
    nexts = np.maximum(np.searchsorted(c, c[ends] - overlap), after)
    runs, at = [], 0
    while at < n:
        runs.append((at, int(ends[at])))
        at = n if ends[at] == n else int(nexts[at])
    return runs


def fixed_chunks(docs: DataFrame, budget: int = 800, overlap: int = 120, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_no (from 0), start, end, text, error: whole sentences packed up to the budget; a longer sentence stands alone.

    The next start depends on the last end, so a document is folded in Python, one at a time, within its
    own row: nothing is shuffled. A document that fails gives one row with its error. Null texts give no rows.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), sentences(F.col(text)).alias("s"))
    rows = rows.withColumn("c", F.transform("s", word_count)).withColumn("breaks", F.array().cast("array<int>"))
    return _packed(rows, budget, overlap, dict(docs.dtypes)[doc_id])


def _packed(rows: DataFrame, budget: int, overlap: int, kind: str) -> DataFrame:
    """rows: doc_id, s, c (cost of each sentence), breaks."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, s, c, breaks in zip(pdf["doc_id"], pdf["s"], pdf["c"], pdf["breaks"], strict=True):
                try:
                    out += [(d, k, a, b, " ".join(s[a:b]), None) for k, (a, b) in enumerate(pack(c, budget, overlap, breaks))]
                except Exception as e:  # one document must not end the job
                    out.append((d, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_no", "start", "end", "text", "error"])

    return rows.select("doc_id", "s", "c", "breaks").mapInPandas(fold, f"doc_id {kind}, chunk_no int, start int, end int, text string, error string")


def sentence_distances(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, dist array: for each sentence but the first, 1 - cosine of its word set and that of the sentence before.

    Stands in for a sentence encoder; any array of distances may be packed instead.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), sentences(F.col(text)).alias("s"))
    sets = F.transform("s", lambda x: F.array_distinct(metric_words(x)))
    both = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), _distance)
    return rows.withColumn("w", sets).select("doc_id", "s", F.transform("s", word_count).alias("c"), both.alias("dist"))


def _distance(a: Column, b: Column) -> Column:
    scale = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.lit(1.0) - F.when(scale > 0, F.size(F.array_intersect(a, b)) / scale).otherwise(F.lit(0.0))


def linear_percentile(values: Column, share: float) -> Column:
    """Percentile of an array, linear between neighbours."""
    v = F.array_sort(values)
    pos = F.lit(share) * (F.size(v) - 1)
    low = F.floor(pos).cast("int")
    a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
    return a + (b - a) * (pos - low)


def semantic_breaks(docs: DataFrame, share: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, s, c, breaks array of sentence numbers where the distance exceeds the document's percentile; none below three sentences."""
    d = sentence_distances(docs, doc_id, text)
    cut = linear_percentile(F.col("dist"), share)
    at = F.filter(F.transform("dist", lambda x, i: F.when(x > F.col("cut"), i + 1)), lambda x: x.isNotNull())
    return d.withColumn("cut", F.when(F.size("s") >= 3, cut)).select("doc_id", "s", "c", F.when(F.col("cut").isNotNull(), at).otherwise(F.array().cast("array<int>")).alias("breaks"))


def semantic_chunks(docs: DataFrame, budget: int = 800, share: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chunk_no, start, end, text, error: sentences packed between the semantic breaks, as fixed_chunks without overlap."""
    return _packed(semantic_breaks(docs, share, doc_id, text), budget, 0, dict(docs.dtypes)[doc_id])


def sentence_windows(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, i, text, window_start, window_end: a row for each sentence and the sentences around it."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), sentences(F.col(text)).alias("s"))
    each = rows.select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("i", "text"))
    return each.select("doc_id", "i", "text", F.greatest(F.col("i") - width, F.lit(0)).alias("window_start"), F.least(F.col("i") + width + 1, F.col("n")).alias("window_end"))


def chunk_documents(docs: DataFrame, strategy: str, **options: object) -> DataFrame:
    """doc_id, chunk_no, text, window_start, window_end, error by the named strategy: fixed, semantic or sentence_window.

    A document that fails gives one row with its error (see failed_documents); an unknown strategy raises.
    """
    cut = {"fixed": fixed_chunks, "semantic": semantic_chunks, "sentence_window": sentence_windows}.get(strategy)
    if cut is None:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    out = cut(docs, **options)
    none = F.lit(None).cast("int")
    if strategy == "sentence_window":
        return out.select("doc_id", F.col("i").alias("chunk_no"), "text", "window_start", "window_end", F.lit(None).cast("string").alias("error"))
    return out.select("doc_id", "chunk_no", "text", none.alias("window_start"), none.alias("window_end"), "error")


def failed_documents(chunks: DataFrame) -> DataFrame:
    """error, documents: how many documents each error cost."""
    return chunks.where("error is not null").groupBy("error").agg(F.countDistinct("doc_id").alias("documents"))


def expand_windows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (chunk_id, ...) with text widened to the sentences of the window, keyed by document and section; others as they stand.

    A sentence's number is the trailing number of its chunk_id. Only the hits' windows are joined, by equality
    on document and section with the range as a filter.
    """
    number = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int")
    rest = ["doc_id", "section", "window_start", "window_end", "text"]
    rows = chunks.where("chunk_id is not null").select("chunk_id", *rest)
    # ids and places first, then only the texts of the hits and of their windows
    mine = one_row_each(only_keys(rows, hits.select("chunk_id")), "chunk_id", rest)
    filled = lambda df: df.withColumn("section", F.coalesce("section", F.lit("")))
    windows = filled(mine.where("window_start is not null and doc_id is not null")).select("chunk_id", "doc_id", "section", "window_start", "window_end")
    near = only_keys(filled(rows), windows.select("doc_id", "section"))
    sents = one_row_each(near, "chunk_id", rest).where("window_start is not null and text is not null").select("doc_id", "section", number.alias("i"), F.col("text").alias("sentence"))
    wide = windows.join(sents, ["doc_id", "section"]).where("i >= window_start and i < window_end")
    texts = wide.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("wide"))  # a window of a few sentences
    return hits.join(mine.select("chunk_id", F.col("text").alias("own")), "chunk_id", "left").join(texts, "chunk_id", "left").select(*hits.columns, F.coalesce("wide", "own").alias("text"))


def size_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """n, p50, p95, longest: words of the chunks."""
    size = chunks.select(word_count(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    return size.agg(F.count("*").alias("n"), F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.95)).alias("p95"), F.max("n").alias("longest"))
