"""Exact inner-product search, with filters ahead of the top k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.operators.lexical import top_k

#: Queries multiplied with each batch of vectors at once; more go in further passes.
QUERIES_AT_ONCE = 2000


def dense_scores(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, vec_id, score: each batch's k best vectors of each query, so the k best of all are among them, ties by vec_id included.

    A stated query set against all vectors in blocks: the queries of a pass are read to the driver
    (at most QUERIES_AT_ONCE of them), each batch is one matrix product. Null vectors score nothing.
    """
    rows = queries.where(F.col(embedding).isNotNull()).select(query_id, embedding)
    result = None
    for ids, matrix in _passes(rows):

        def score(batches: Iterator[pd.DataFrame], ids: list = ids, matrix: np.ndarray = matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not ids:
                    continue
                m = np.stack(pdf[embedding].to_numpy()).astype(np.float64) @ matrix.T
                vec = pdf[vec_id].to_numpy()
                part, q = _best(m, vec, k)
                yield pd.DataFrame({"query_id": np.array(ids)[q], "vec_id": vec[part], "score": m[part, q]})

        own = vectors.where(F.col(embedding).isNotNull()).select(vec_id, embedding).mapInPandas(score, "query_id long, vec_id long, score double")
        result = own if result is None else result.unionByName(own)
    return result


def _best(m: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of m that can be among a column's k best by (score to 9 digits, vec): all down to the k-th score, and of equal scores the k least vec."""
    n = min(len(m), k)
    if not n or not m.shape[1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.partition(m, len(m) - n, axis=0)[len(m) - n] - 2e-9  # what rounds as the k-th score lies above
    q, part = np.nonzero(((m >= least) | np.isnan(m)).T)
    score = m[part, q]
    order = np.lexsort((vec[part], -score, q))
    q, part, score = q[order], part[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (score[1:] != score[:-1]))))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return part[place < k], q[place < k]


def _passes(rows: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    ids, vecs = [], []
    for i, v in rows.toLocalIterator():
        if len(ids) == QUERIES_AT_ONCE:
            yield ids, np.array(vecs, np.float64)
            ids, vecs = [], []
        ids.append(i)
        vecs.append(v)
    yield ids, np.array(vecs, np.float64)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, rank; `where` filters the vectors before the search, so no query comes up short."""
    kept = vectors.where(where) if where is not None else vectors
    return top_k(dense_scores(queries, kept, k), k, item="vec_id")


def overfetch_topk(scored: DataFrame, k: int, factor: int, keep: Column) -> DataFrame:
    """Search first, filter after: the k best that pass `keep` among the k * factor best; may come up short."""
    wide = top_k(scored, k * factor, item="vec_id").where(keep).drop("rank")
    return top_k(wide, k, item="vec_id")


def filter_backoff(filtered: DataFrame, unfiltered: DataFrame, k: int, group: str = "query_id", item: str = "vec_id") -> DataFrame:
    """The filtered hits, then unfiltered ones that aren't among them until there are k; both need rank."""
    rest = unfiltered.join(filtered.select(group, item), [group, item], "left_anti")
    both = filtered.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))
    w = Window.partitionBy(group).orderBy("tier", "rank")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ivf_centroids(vectors: DataFrame, cells: int, sample_rows: int = 20_000, rounds: int = 12, embedding: str = "embedding") -> np.ndarray:
    """Unit centroids of an inverted file, by spherical k-means on at most sample_rows vectors, the first by hash; the bound is of the sample only, every vector is indexed."""
    rows = vectors.where(F.col(embedding).isNotNull()).orderBy(F.xxhash64(embedding)).limit(sample_rows).select(embedding).collect()
    x = np.array([r[0] for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(7).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        used = np.linalg.norm(total, axis=1) > 0
        c = np.where(used[:, None], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12), c)
    return c


def ivf_index(vectors: DataFrame, centroids: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """vectors with cell, the nearest centroid's number; no row is left out. Written by cell, a search reads only the cells it probes."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf[embedding].to_numpy()).astype(np.float64)
                yield pdf.assign(cell=(m @ centroids.T).argmax(1).astype(np.int32) if len(centroids) else np.int32(0))

    kept = vectors.where(F.col(embedding).isNotNull())
    kind = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    return kept.mapInPandas(place, f"{kind}, cell int")


def ivf_topk(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int = 20, probes: int = 8, where: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank among the vectors of the `probes` cells nearest to each query that pass `where`; approximate (see dense_topk for the exact way).

    The filter comes before the search, so a query comes up short only if its cells hold too few rows. Queries go in passes as
    in dense_scores; each batch of the index multiplies a cell's vectors with the queries that probe it.
    """
    kept = index.where(where) if where is not None else index
    result = None
    for ids, matrix in _passes(queries.where(F.col(embedding).isNotNull()).select("query_id", embedding)):
        if not ids:
            return top_k(dense_scores(queries, kept, k), k, item=vec_id)
        near = np.argsort(-(matrix @ centroids.T), axis=1)[:, :probes]
        probed = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        own = kept.where(F.col("cell").isin(sorted(probed))).select(vec_id, "cell", embedding)  # prunes the files of other cells

        def score(batches: Iterator[pd.DataFrame], ids: list = ids, matrix: np.ndarray = matrix, probed: dict = probed) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for cell, part in pdf.groupby("cell"):
                    asked = probed[int(cell)]
                    m = np.stack(part[embedding].to_numpy()).astype(np.float64) @ matrix[asked].T
                    vec = part[vec_id].to_numpy()
                    at, q = _best(m, vec, k)
                    yield pd.DataFrame({"query_id": np.array(ids)[asked[q]], "vec_id": vec[at], "score": m[at, q]})

        found = own.mapInPandas(score, "query_id long, vec_id long, score double")
        result = found if result is None else result.unionByName(found)
    return top_k(result, k, item="vec_id")
