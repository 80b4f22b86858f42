"""The retrieval pipeline for a whole table of questions: route, search, back off, fuse, rerank, widen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import metric_words
from evispark.operators import chunking, dense, fusion, lexical, routing
from evispark.operators.once import one_row_each, only_keys
from evispark.session import checkpointed

COLLECTIONS = {"filings": ("edgar", "fomc"), "complaints": ("cfpb",)}


def _one_row(chunks: DataFrame) -> DataFrame:
    """One row for each chunk_id with a text."""
    rest = ["text", "doc_id", "source", "ticker", "form", "date"]
    return one_row_each(chunks.where("chunk_id is not null and text is not null").select("chunk_id", *rest), "chunk_id", rest)


def search(queries: DataFrame, chunks: DataFrame, retriever: str, k: int, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best by bm25, dense (inner product) or hybrid (both lists fused by reciprocal ranks).

    queries: id, question; chunks: chunk_id, text; vectors: vec_id (a number for each chunk), chunk_id, embedding; query_vectors:
    query_id (a number), id, embedding. An unknown retriever raises, as does a missing table of vectors.
    """
    if retriever not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown retriever: {retriever}")
    if retriever != "bm25" and (vectors is None or query_vectors is None):
        raise ValueError(f"{retriever} search needs vectors of chunks and queries")
    lists = []
    if retriever != "dense":
        found = lexical.bm25_topk(queries, chunks, k, "id", "question", "chunk_id", "text")
        lists.append(found.select("query_id", F.lit("bm25").alias("retriever"), F.col("doc_id").alias("chunk_id"), F.col("rank").alias("pos"), "score"))
    if retriever != "bm25":
        names = query_vectors.select(F.col("query_id").alias("_q"), F.col("id").alias("query_id"))
        found = dense.dense_topk(query_vectors.select("query_id", "embedding"), vectors, k).withColumnRenamed("query_id", "_q")
        found = found.join(names, "_q").join(vectors.select("vec_id", "chunk_id"), "vec_id")
        lists.append(found.select("query_id", F.lit("dense").alias("retriever"), "chunk_id", F.col("rank").alias("pos"), "score"))
    both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return fusion.fuse_lists(both, k, rrf_k)


def parts(questions: DataFrame) -> DataFrame:
    """id (struct of the question's id and part), question, collections: part 0 is the question itself, the others its sub-questions.

    A question that isn't worth splitting, or comes without two sub-questions, has part 0 only. Routing is that of the
    whole question. questions: id, question and, if there are any, sub_questions array<string>.
    """
    own = F.col("sub_questions") if "sub_questions" in questions.columns else F.lit(None).cast("array<string>")
    asked = routing.routed(questions.where("question is not null").select("id", "question", own.alias("sub_questions")).distinct())
    each = F.array_distinct(F.concat(F.array("question"), routing.accepted_split(F.col("question"), F.col("sub_questions"))))
    split = asked.select("id", "collections", F.posexplode(each).alias("part", "question"))
    return split.select(F.struct("id", "part").alias("id"), "question", "collections")


def collection_lists(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, retriever (the collection), chunk_id, pos: the k best of each collection a question is routed to.

    Chunks that pass the filters the question implies come first; if they are fewer than k, others follow by score.
    Filters apply to filings only. questions: id, question and the question's collections.
    """
    own = _one_row(chunks).withColumn("year", F.substring("date", 1, 4))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    asked = questions.withColumn("f", routing.implied_filters(F.col("question"))).select("*", one(F.col("f.ticker")).alias("ticker"), one(F.col("f.form")).alias("form"), F.col("f.years").alias("year"))
    out = None
    for name, sources in COLLECTIONS.items():
        part = own.where(F.col("source").isin(*sources))
        q = asked.where(F.array_contains("collections", name))
        wants = ["ticker", "form", "year"] if name == "filings" else []
        scores = lexical.bm25_best(q, part, k, "id", "question", "chunk_id", "text", wants).withColumnRenamed("doc_id", "chunk_id")
        w = Window.partitionBy("query_id").orderBy("tier", F.round("score", 9).desc(), "chunk_id")
        best = scores.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("query_id", F.lit(name).alias("retriever"), "chunk_id", "pos")
        out = best if out is None else out.unionByName(best)
    return out


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 20, context: int = 8, budget: int = 200) -> DataFrame:
    """query_id, chunk_id, rank, score, text: the context of each question.

    A question worth splitting is searched for as it stands and by each of its sub-questions (column sub_questions).
    Each collection's list is cut at k and then fused; each part's pool is scored by that part's words in any window
    of the passage (a scorer that needs no model), the best `context` are taken round robin from the parts' pools, and
    sentence chunks are widened to their windows last. Repeated chunks count once; a question without any match gives
    no rows.
    """
    asked = checkpointed(parts(questions))
    pool = checkpointed(fusion.rrf(collection_lists(asked, chunks, k), k * len(COLLECTIONS)).select("query_id", "chunk_id", F.col("rank").alias("pos")))
    q = asked.select(F.col("id").alias("query_id"), metric_words(F.col("question")).alias("q"))
    # the pools' ids first, then only their texts
    p = _one_row(only_keys(chunks, pool.select("chunk_id"))).select("chunk_id", metric_words(F.col("text")).alias("p"))
    pairs = pool.join(q, "query_id").join(p, "chunk_id")
    # no more than `context` of a pool can come among the first `context` of all
    own = fusion.rerank(pairs, fusion.windowed_max(pairs, F.col("q"), F.col("p"), budget), context)
    own = checkpointed(own.select(F.col("query_id.id").alias("query_id"), F.col("query_id.part").alias("retriever"), "chunk_id", F.col("rank").alias("pos"), F.round("score", 6).alias("score")))
    turns = fusion.interleave(own, context).join(own.drop("pos"), ["query_id", "retriever", "chunk_id"])
    return chunking.expand_windows(turns.select("query_id", "chunk_id", "rank", "score"), chunks)
