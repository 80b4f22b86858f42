"""Search, fusion, filters, routing, chunking, normalisation, metrics, stores, streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.operators import chunking, dense, evaluation, filters, fusion, lexical, normalise, retrieve, routing
from evispark.operators.components import connected_components
from evispark.operators.ranks import running_sum
from evispark.plans import retrieval as plans
from evispark.sources import landed, stores
from evispark.streaming import ingest


def test_bm25_against_plain_python(spark):
    docs = {1: "rate cut rate", 2: "rate hike", 3: "the bank", 4: "", 5: None}
    got = lexical.bm25_topk(spark.createDataFrame([(9, "rate rate bank")], "item_id long, text string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 5).collect()
    tokens = {k: (v or "").split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {t: sum(t in v for v in tokens.values()) for v in tokens.values() for t in v}
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (v if v >= 0 else 0.25 * mean) for t, v in idf.items()}
    want = {k: sum(idf[q] * v.count(q) * 2.5 / (v.count(q) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for q in ("rate", "rate", "bank")) for k, v in tokens.items() if set(v) & {"rate", "bank"}}
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in got} == want


@pytest.mark.parametrize(("words", "passes", "block", "sparse"), [(13, 4, (2, 50), 5), (60, 100, (100, 7), 2), (2, 100, (100, 100), 1e9)])
def test_best_documents_are_those_of_all_scores(spark, monkeypatch, words, passes, block, sparse):
    """Copies tie, a word in just half of the documents weighs nothing, wants make tiers; in several passes and blocks."""
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", passes)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block[0])
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block[1])
    monkeypatch.setattr(lexical, "SPARSE", sparse)
    monkeypatch.setattr(lexical, "SCORING_TASKS", 1)
    rng = random.Random(words)
    text = lambda n: " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))
    some = [text(rng.randint(0, 9)) for _ in range(60)]
    rows = [(f"d{i}", rng.choice(some) + " half" * (i % 2), rng.choice(["10-K", "8-K", None]), rng.choice(["2023", "2024", "2025", ""])) for i in range(398)] + [("none", None, None, None), ("odd", "half", "10-K", "2024")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, form string, year string").repartition(7)
    asked = [((f"q{i}", i % 2), text(6), rng.choice([["10-K"], None]), rng.choice([["2024", "2025"], None])) for i in range(9)] + [(("half", 0), "half half", None, ["2023"]), (("unknown", 0), "elsewhere", None, None)]
    q = spark.createDataFrame(asked, "id struct<id: string, part: int>, text string, form array<string>, year array<string>")
    for wants in (["form", "year"], []):
        got = lexical.bm25_best(q, docs, 5, "id", "text", "doc_id", "text", wants)
        tier = F.lit(0)
        for c in wants:
            tier = F.greatest(tier, F.when(F.col(f"q.{c}").isNull() | F.coalesce(F.array_contains(f"q.{c}", F.col(f"d.{c}")), F.lit(False)), 0).otherwise(1))
        every = lexical.bm25_scores(q, docs, "id", "text", "doc_id", "text").alias("s").join(q.alias("q"), F.col("q.id") == F.col("s.query_id")).join(docs.alias("d"), F.col("d.doc_id") == F.col("s.doc_id"))
        every = every.select("s.query_id", "s.doc_id", "s.score", tier.alias("tier"))
        best = lambda x: {(r["query_id"]["id"], r["tier"], r["rank"]): (r["doc_id"], pytest.approx(r["score"])) for r in lexical.top_k(x.withColumn("_g", F.struct("query_id", "tier")), 5, "_g").collect()}
        want = best(every)
        assert best(got) == want and {k[0] for k in want} == {"half", *(f"q{i}" for i in range(9))}


def test_pairs_of_questions_and_chunks_are_not_shuffled(spark):
    """every question shares a word with every chunk, and only the best leave their task; texts that nobody chose stay as well."""
    rng = random.Random(1)
    cols = "chunk_id string, doc_id string, source string, ticker string, form string, date string, section string, text string, window_start int, window_end int"
    rows = [(f"c_{i:05d}", "d", "edgar", None, "10-K", "2024-01-01", None, f"bank {rng.random()} " + "filler " * 50, None, None) for i in range(3000)]
    chunks = spark.createDataFrame(rows, cols).repartition(4)
    asked = spark.createDataFrame([(f"q{i}", f"bank {i}") for i in range(150)], "id string, question string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    assert len(retrieve.retrieve(asked, chunks, k=3, context=2).collect()) == 300
    assert shuffled() - before < 1_500_000


def test_dense_topk_equals_numpy_and_filter_keeps_k(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in v[i]], i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    q = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    got = dense.dense_topk(q, df, 10).collect()
    for i in range(3):
        own = sorted((r["score"] for r in got if r["query_id"] == i), reverse=True)
        assert own == pytest.approx(sorted(v @ v[i], reverse=True)[:10], abs=1e-5)
    assert dense.dense_topk(q, df, 10, F.col("label") == 2).groupBy("query_id").count().where("count = 10").count() == 3
    assert dense.dense_topk(q, df.limit(0), 10).count() == 0
    assert dense.dense_topk(q.limit(0), df, 10).count() == 0


def test_inverted_file_reaches_its_recall_and_filters_first(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(12, size=2000)] + 0.4 * rng.normal(size=(2000, 16))
    v[:600] = v[0]  # copies
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 5) for i in range(2000)] + [(9999, None, 1)], "vec_id long, embedding array<double>, label int").repartition(4)
    q = df.where("vec_id >= 1900 and vec_id < 1940").select(F.col("vec_id").alias("query_id"), "embedding")
    c = dense.ivf_centroids(df, 16, 1000)
    index = dense.ivf_index(df, c)
    assert index.count() == 2000
    for where in (None, F.col("label") == 2):
        exact = {(r["query_id"], r["vec_id"]) for r in dense.dense_topk(q, df, 10, where).collect()}
        near = {(r["query_id"], r["vec_id"]) for r in dense.ivf_topk(q, index, c, 10, 6, where).collect()}
        assert len(exact & near) >= 0.9 * len(exact)
    all_cells = {(r["query_id"], r["vec_id"]) for r in dense.ivf_topk(q, index, c, 10, 16).collect()}
    assert all_cells == {(r["query_id"], r["vec_id"]) for r in dense.dense_topk(q, df, 10).collect()}
    assert dense.ivf_topk(q.limit(0), index, c, 10).count() == 0


def test_dense_ties_go_by_vec_id_within_a_batch(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 8))
    v[::3] = v[0] / np.linalg.norm(v[0]) * 9  # a third are copies, best for a query that is one too
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), [float(x) for x in v[i]], int(i) % 5) for i in ids], "vec_id long, embedding array<double>, label int").coalesce(1)
    q = df.where("vec_id in (0, 1)").select(F.col("vec_id").alias("query_id"), "embedding")
    got = dense.dense_topk(q, df, 20).collect()
    for i in (0, 1):
        score = v @ v[i]
        want = sorted(range(3000), key=lambda j: (-round(score[j], 9), j))[:20]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want


def test_backoff_appends_what_is_missing(spark):
    a = spark.createDataFrame([(1, 7, 1)], "query_id int, vec_id int, rank int")
    b = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (1, 6, 3)], "query_id int, vec_id int, rank int")
    assert [(r["vec_id"], r["tier"]) for r in dense.filter_backoff(a, b, 3).orderBy("rank").collect()] == [(7, 0), (5, 1), (6, 1)]


def _lists(spark, rows):
    return spark.createDataFrame(rows, "query_id string, retriever string, chunk_id string, pos int")


def test_two_low_ranks_beat_one_first_rank(spark):
    rows = [("q", r, f"{r}{i}", i) for r in "ab" for i in range(1, 20)] + [("q", "a", "both", 20), ("q", "b", "both", 20)]
    top = fusion.rrf(_lists(spark, rows), 1).first()
    assert top["chunk_id"] == "both" and top["score"] == pytest.approx(0.025)
    cut = fusion.rrf(_lists(spark, rows), 40, width=10)
    assert cut.where("chunk_id = 'both'").count() == 0  # cut first, then fused


def test_interleave_and_quota(spark):
    rows = [("q", "a", "x", 1), ("q", "a", "y", 2), ("q", "b", "x", 1), ("q", "b", "z", 2)]
    assert [r["chunk_id"] for r in fusion.interleave(_lists(spark, rows), 3).orderBy("rank").collect()] == ["x", "y", "z"]
    assert {r["retriever"]: r["chunks"] for r in fusion.pool_quota(_lists(spark, rows), 3).collect()} == {"a": 2, "b": 1}


def test_reranker_sees_the_passages_of_all_retrievers(spark, tmp_path):
    spark.createDataFrame([("q", "card fees of the bank")], "id string, question string").write.parquet(str(tmp_path / "drafts_multihop.parquet"))
    spark.createDataFrame([("c1", "the bank"), ("c2", "card fees of the bank")], "chunk_id string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    hits = [("q", "rerank", "c1", 1), ("q", "bm25", "c1", 1), ("q", "bm25", "c2", 2)]
    spark.createDataFrame(hits, "query_id string, retriever string, chunk_id string, rank int").write.parquet(str(tmp_path / "hits.parquet"))
    assert plans.windowed_max_score(spark, str(tmp_path)).count() == 2
    assert [r["chunk_id"] for r in plans.rerank_topk(spark, str(tmp_path)).orderBy("rank").collect()] == ["c2", "c1"]


def test_logged_ranks_become_places(spark):
    hits = spark.createDataFrame([("q", "a", "x", 0), ("q", "a", "y", 1), ("q", "a", "y", 1), ("q", "a", "w", None), (None, "a", "v", 1)], "query_id string, retriever string, chunk_id string, rank int")
    assert [(r["chunk_id"], r["pos"]) for r in fusion.ranked_lists(hits).orderBy("pos").collect()] == [("x", 1), ("y", 2), ("w", 3)]


def test_passage_windows_cover_the_tail(spark):
    n = lambda k: spark.range(1).select(fusion.passage_windows(F.sequence(F.lit(1), F.lit(k)), 200).alias("w")).first()["w"]
    long = n(2000)
    assert len(long) > 1 and long[-1][-1] == 2000 and max(map(len, long)) == 200
    assert n(50) == [list(range(1, 51))]


def test_filter_shapes(spark):
    df = spark.createDataFrame([("edgar", None, "2025-02-07"), ("cfpb", "A", None)], "source string, ticker string, date string")
    count = lambda f: df.where(filters.compile_filter(df, f)).count()
    assert count({"source": "edgar"}) == 1
    assert count({"source": ["edgar", "cfpb"]}) == 2
    assert count({"ticker": None}) == 1
    assert count({"date": {"prefix": ("2024", "2025")}}) == 1
    assert count({"date": {"prefix": "2023"}}) == 0
    assert count({"nothing": "x"}) == 0
    assert count({}) == 2


def test_filter_union(spark):
    f = spark.createDataFrame([("q", "ticker", "scalar", "B"), ("q", "ticker", "scalar", "A"), ("q", "date", "prefix", "2024")], "query_id string, field string, kind string, value string")
    assert [(r["field"], r["values"]) for r in filters.union_filters(f).collect()] == [("ticker", ["A", "B"])]


def _ask(spark, q, f):
    return spark.createDataFrame([(q,)], "q string").select(f(F.col("q")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("q", "collections", "method"),
    [
        ("What is the CET1 ratio?", ["filings"], "heuristic"),
        ("A debt collector called about late fees", ["complaints"], "heuristic"),
        ("Do late fees differ from what banks say?", ["filings", "complaints"], "fan_out"),
        ("How do deposits and overdrafts relate?", ["filings", "complaints"], "heuristic"),
        ("credit card", ["filings", "complaints"], "fan_out"),
    ],
)
def test_routes(spark, q, collections, method):
    r = _ask(spark, q, routing.route)
    assert (r["collections"], r["method"]) == (collections, method)


def test_issuers_periods_and_gate(spark):
    assert _ask(spark, "JPM versus Citigroup", routing.issuers) == ["C", "JPM"]
    assert _ask(spark, "what are the capital requirements of a card", routing.issuers) == []
    assert _ask(spark, "C&I loans", routing.issuers) == ["C"]  # a letter alone reads as the symbol
    assert _ask(spark, "2023 and 2024", routing.periods) == 2
    assert _ask(spark, "2024 and 2024", routing.periods) == 1
    assert _ask(spark, "Q1 and Q3 of 2024", routing.periods) == 3
    assert _ask(spark, "Comparing the two", routing.worth_splitting)
    assert not _ask(spark, "What was revenue in 2024?", routing.worth_splitting)


def test_each_sub_question_keeps_its_evidence(spark):
    """K11: asked as a whole, the passages vaguely about both facts win; the one that answers the second part must stay."""
    vague = [(f"v_{i}", f"compare dividend policy and branch network of the bank {w}") for i, w in enumerate("north south east west".split())]
    cols = "chunk_id string, doc_id string, source string, ticker string, form string, date string, section string, text string, window_start int, window_end int"
    rows = [(c, c, "edgar", None, "10-K", "2024-01-01", None, t, None, None) for c, t in [*vague, ("gold_8", "closures hit rural offices"), ("other_9", "tellers and vaults")]]
    chunks = spark.createDataFrame(rows, cols)
    text = "Compare the dividend policy of the bank and its branch network"
    subs = ["dividend policy of the bank", "which rural offices saw closures"]
    asked = spark.createDataFrame([("whole", text, None), ("split", text, subs), ("plain", "dividend policy", subs)], "id string, question string, sub_questions array<string>")
    got = retrieve.retrieve(asked, chunks, k=10, context=3).collect()
    ids = {q: [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in ("whole", "split", "plain")}
    assert "gold_8" in ids["split"] and len(ids["split"]) == 3
    assert "gold_8" not in ids["whole"] and "gold_8" not in ids["plain"]
    assert len(set(ids["split"])) == 3 and {r["rank"] for r in got if r["query_id"] == "split"} == {1, 2, 3}


def test_implied_filters(spark):
    f = _ask(spark, "What did Citigroup say in its 2024 10-K?", routing.implied_filters)
    assert (f["ticker"], f["form"], f["years"]) == ("C", "10-K", ["2024", "2025"])
    f = _ask(spark, "JPM and C in the 10-Q filed in 2023 and the 2024 10-K", routing.implied_filters)
    assert (f["ticker"], f["form"], f["years"]) == (None, None, None)
    assert _ask(spark, "the 10-Q filed in 2025", routing.named_filings) == ["2025 10-Q"]
    assert _ask(spark, "Compare the 10-K from 2023 10-Q", routing.named_filings) == ["2023 10-K"]  # from left to right
    assert _ask(spark, "its 2024 10k and the 8-K of 2022", routing.named_filings) == ["2022 8-K", "2024 10-K"]


def test_a_single_list_keeps_its_scores_and_pools_widen(spark):
    rows = [("one", "a", "x", 1, 7.5), ("one", "a", "y", 2, 3.0), ("two", "a", "x", 1, 7.5), ("two", "b", "y", 1, 0.1)]
    lists = spark.createDataFrame(rows, "query_id string, retriever string, chunk_id string, pos int, score double")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in fusion.fuse_lists(lists, 5).collect()}
    assert got[("one", "x")] == 7.5 and got[("two", "x")] == pytest.approx(1 / 61)
    assert {r["query_id"]: r["count"] for r in fusion.fuse_pools(lists, 1).groupBy("query_id").count().collect()} == {"one": 1, "two": 2}
    assert fusion.fuse_pools(lists, 1, "interleave").where("query_id = 'two'").count() == 2
    with pytest.raises(ValueError, match="unknown fusion"):
        fusion.fuse_pools(lists, 1, "none")


def test_search_by_named_retriever(spark):
    chunks = spark.createDataFrame([("c1", "card fees rose"), ("c2", "deposits fell"), ("c3", "the weather")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "card fees")], "id string, question string")
    v = spark.createDataFrame([(1, "c1", [1.0, 0.0]), (2, "c2", [0.9, 0.1]), (3, "c3", [0.0, 1.0])], "vec_id long, chunk_id string, embedding array<double>")
    qv = spark.createDataFrame([(5, "q", [0.0, 1.0])], "query_id long, id string, embedding array<double>")
    best = lambda how: [r["chunk_id"] for r in retrieve.search(q, chunks, how, 2, v, qv).orderBy("rank").collect()]
    assert best("bm25") == ["c1"] and best("dense") == ["c3", "c2"] and set(best("hybrid")) == {"c1", "c3"}
    with pytest.raises(ValueError, match="unknown retriever"):
        retrieve.search(q, chunks, "none", 2)
    with pytest.raises(ValueError, match="vectors"):
        retrieve.search(q, chunks, "hybrid", 2)


def test_samples_for_drafting(spark):
    c = spark.createDataFrame([(f"c{i}", "a" if i % 4 else "b") for i in range(40)], "chunk_id string, source string")
    got = normalise.proportional_sample(c, "source", "chunk_id", 10, c.where("chunk_id = 'c3'").select("chunk_id")).collect()
    assert sum(r["source"] == "a" for r in got) == 8 and sum(r["source"] == "b" for r in got) == 2 and "c3" in {r["chunk_id"] for r in got}
    rows = [("x1", "A", "s", "2020-01-01"), ("x2", "A", "s", "2023-01-01"), ("y1", "B", "s", "2020-01-01"), ("z", "", "s", "2020-01-01"), ("n", "C", None, None)]
    t = spark.createDataFrame([(*r, "w" * 50) for r in rows], "chunk_id string, ticker string, section string, date string, text string")
    assert [(r["chunk_id_a"], r["chunk_id_b"]) for r in normalise.temporal_pairs(t, 20).collect()] == [("x1", "x2")]
    assert normalise.cross_entity_pairs(t, 20, 2).count() == 2 and normalise.cross_entity_pairs(t.limit(0), 20).count() == 0


def test_sub_questions_fail_open(spark):
    ok = lambda q, r: spark.createDataFrame([(q, r)], "q string, r string").select(routing.sub_questions(F.col("q"), F.col("r")).alias("x")).first()["x"]
    assert ok("JPM versus C", '{"sub_questions": ["a", " a ", "b"]}') == ["a", "b"]
    assert ok("JPM versus C", "no") == ["JPM versus C"]
    assert ok("revenue", '{"sub_questions": ["a", "b"]}') == ["revenue"]


def test_packing_steps_back_for_the_overlap():
    assert chunking.pack([10, 10, 10, 10], 20, 10) == [(0, 2), (1, 3), (2, 4)]
    assert chunking.pack([50, 10], 20, 5) == [(0, 1), (1, 2)]
    assert chunking.pack([], 20, 5) == []
    assert chunking.pack([10, 10, 10], 15, 0, {1}) == [(0, 1), (1, 2), (2, 3)]
    assert chunking.pack([5, 5, 5, 5], 100, 0, {3, 9}) == [(0, 3), (3, 4)]


def test_strategies_are_named_and_failures_counted(spark, monkeypatch):
    d = spark.createDataFrame([(1, "One two. Three four."), (2, "Five six.")], "doc_id long, text string")
    assert chunking.chunk_documents(d, "fixed", budget=2, overlap=0).count() == 3
    assert chunking.chunk_documents(d, "semantic", budget=2).count() == 3
    assert chunking.chunk_documents(d, "sentence_window", width=1).where("window_end - window_start = 2").count() == 2
    with pytest.raises(ValueError, match="unknown chunking"):
        chunking.chunk_documents(d, "none")
    assert chunking.failed_documents(chunking.chunk_documents(d, "fixed", budget=None, overlap=0)).first()["documents"] == 2


def test_chunkers_on_null_and_empty(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "One two. Three four. Five six.")], "doc_id long, text string")
    assert {r["doc_id"] for r in chunking.fixed_chunks(d, 4, 2).collect()} == {3}
    assert chunking.semantic_chunks(d, 100).where("doc_id = 3").first()["text"].startswith("One two.")
    w = chunking.sentence_windows(d, 1).orderBy("i").collect()
    assert [(r["window_start"], r["window_end"]) for r in w] == [(0, 2), (0, 3), (1, 3)]


def test_windows_expand_by_document_and_section(spark):
    rows = [("D_a_000", "D", "a", 0, 2, "s0"), ("D_a_001", "D", "a", 0, 2, "s1"), ("D_b_000", "D", "b", 0, 1, "t0"), ("E_a_000", "E", "a", None, None, "whole")]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, section string, window_start int, window_end int, text string")
    hits = spark.createDataFrame([("D_a_000",), ("D_b_000",), ("E_a_000",), ("none",)], "chunk_id string")
    assert {r["chunk_id"]: r["text"] for r in chunking.expand_windows(hits, chunks).collect()} == {"D_a_000": "s0 s1", "D_b_000": "t0", "E_a_000": "whole", "none": None}


def _sequential(rows):
    keys, texts, out = set(), set(), {}
    for seq, k, f in rows:
        if k in keys:
            out[seq] = "duplicate_key"
        elif f in texts:
            out[seq] = "duplicate_text"
        else:
            out[seq] = None
            keys.add(k)
            texts.add(f)
    return out


def test_ordered_dedupe_is_sequential(spark):
    triple = [(1, "K1", "F1"), (2, "K2", "F1"), (3, "K2", "F2")]
    rng = random.Random(1)
    for rows in (triple, [(i, rng.choice("abcdef"), rng.choice("uvwxyz")) for i in range(30)]):
        df = spark.createDataFrame(rows, "seq long, key string, fp string")
        assert {r["seq"]: r["reason"] for r in normalise.ordered_dedupe(df, "seq").collect()} == _sequential(rows)
    assert normalise.ordered_dedupe(df.limit(0), "seq").count() == 0


def test_ordered_dedupe_goes_on_until_nothing_is_left(spark, monkeypatch):
    monkeypatch.setattr(normalise, "checkpointed", lambda df: spark.createDataFrame(df.collect(), df.schema))  # short lineage for many rounds
    rows = [(i, f"k{i // 2}", f"f{(i + 1) // 2}") for i in range(206)]  # each row shares its key or its text with the next
    got = {r["seq"]: r["reason"] for r in normalise.ordered_dedupe(spark.createDataFrame(rows, "seq long, key string, fp string").coalesce(1), "seq").collect()}
    assert got == {i: None if i % 2 == 0 else "duplicate_key" for i in range(206)}


def test_quality_gates(spark):
    df = spark.createDataFrame([("x" * 200, "2024-01-01"), ("x", "bad"), ("x" * 200, "2024-1-1"), (None, None), ("x" * 200, None)], "t string, d string")
    assert [r[0] for r in df.select(normalise.drop_reason(F.col("t"), F.col("d"))).collect()] == [None, "too_short", "bad_date", "too_short", "bad_date"]


def test_span_matches(spark):
    gold = "net card fees increased 21 percent primarily driven by growth in our premium card portfolios"
    chunks = [("c1", "D", "before " + gold + " after"), ("c2", "D", gold.replace("21", "18")), ("c3", "E", gold), ("c4", "D", "unrelated text"), ("c5", "D", "primarily driven by growth in our premium card portfolios this year and next"), ("c6", "D", None)]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string")
    s = spark.createDataFrame([("q", 0, "D", gold)], "id string, span_no int, doc_id string, snippet string")
    got = {r["chunk_id"]: (r["overlap"], r["hit"]) for r in evaluation.span_matches(s, c).collect()}
    assert got["c1"] == (1.0, True)
    assert got["c2"][1] is False
    assert "c3" not in got
    assert got["c4"] == (0.0, False) and got["c6"] == (0.0, False)


def test_recall_and_reciprocal_rank(spark):
    lists = _lists(spark, [("q", "r", "a", 1), ("q", "r", "b", 2), ("q", "r", "c", 5)])
    spans = spark.createDataFrame([("q", 0), ("q", 1)], "id string, span_no int")
    m = spark.createDataFrame([("q", 0, "c", True), ("q", 1, "zz", True)], "id string, span_no int, chunk_id string, hit boolean")
    ranks = evaluation.span_ranks(lists, spans, m)
    assert evaluation.recall_at_k(ranks, 3).first()["recall"] == 0
    r = evaluation.recall_at_k(ranks, 5)
    assert r.first()["recall"] == 0.5
    assert evaluation.reciprocal_rank(ranks).first()["rr"] == pytest.approx(0.2)
    assert evaluation.recall_by_tier(r).first()["tier"] == 2


def test_citations(spark):
    v = lambda a, n: _ask(spark, a, lambda c: evaluation.citation_validity(c, F.lit(n)))
    assert v("x [S1][S2]", 3) == 1.0
    assert v("x [S1][S9]", 3) == 0.5
    assert v("x", 3) is None
    audit = _ask(spark, "First claim of five words [S2][S2]. Second claim of five words.", lambda c: evaluation.answer_audit(c, F.lit(1)))
    assert (audit["used"], audit["invalid"], audit["uncited"]) == ([], [2], 1)


def test_abstention_both_ways(spark):
    rows = [("c", "unanswerable", "INSUFFICIENT_CONTEXT: x"), ("c", "unanswerable", "yes"), ("c", "single", " INSUFFICIENT_CONTEXT"), ("c", "single", "fine")]
    df = spark.createDataFrame(rows, "config string, type string, answer string")
    r = evaluation.abstention(df, "config", F.col("type") == "unanswerable").first()
    assert (r["abstention_recall"], r["over_refusal"]) == (0.5, 0.5)


def test_gates(spark):
    m = spark.createDataFrame([("a", 0.5), ("b", None)], "metric string, value double")
    s = spark.createDataFrame([(x,) for x in ("a=0.4", "a=0.6", "b=0.1", "c=0.1", "a", "a=", "a=x")], "spec string")
    got = {r["spec"]: r["verdict"] for r in evaluation.enforce(s, m).collect()}
    assert got == {"a=0.4": "ok", "a=0.6": "below", "b=0.1": "not measured", "c=0.1": "unknown", "a": "malformed", "a=": "malformed", "a=x": "malformed"}
    d = spark.createDataFrame([("a", "higher"), ("r", "lower"), ("x", "higher")], "metric string, better string")
    base = spark.createDataFrame([("a", 0.8), ("r", 0.1), ("x", 0.5)], "metric string, value double")
    run = spark.createDataFrame([("a", 0.7), ("r", 0.05)], "metric string, value double")
    assert {r["metric"]: r["verdict"] for r in evaluation.regressions(run, base, d, 0.03).collect()} == {"a": "regressed", "r": "ok", "x": "missing"}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 1)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_sums_cross_ranges(spark):
    rows = [("a", i, 2) for i in range(50)] + [("b", 1, 5), (None, 1, 1), (None, 2, 1)]
    df = spark.createDataFrame(rows, "k string, v int, w int").repartition(7)
    got = {(r["k"], r["v"]): r["before"] for r in running_sum(df, ["k"], [F.col("v")], F.col("w"), "before").collect()}
    assert all(got["a", i] == 2 * i for i in range(50))
    assert (got["b", 1], got[None, 1], got[None, 2]) == (0, 0, 1)


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int")
    assert {(r[0], r[1]) for r in stores.upsert(old, new, "chunk_id").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    with pytest.raises(ValueError, match="unknown chunks"):
        stores.import_vectors(new, old, "chunk_id")
    stores.write_table(old, stores.chunks_path(str(tmp_path), "filings", "fixed"))
    assert stores.resolve_strategy(spark, str(tmp_path), "filings", "semantic") == ("fixed", True)
    assert stores.mirror(spark, stores.chunks_path(str(tmp_path), "filings", "fixed"), f"{tmp_path}/copy")
    assert not stores.mirror(spark, stores.chunks_path(str(tmp_path), "filings", "fixed"), f"{tmp_path}/copy")
    stores.append_history(old, f"{tmp_path}/h")
    stores.append_history(new, f"{tmp_path}/h")
    assert landed.read_records(spark, f"{tmp_path}/h", "chunk_id string, v int").count() == 4
    assert stores.pending(new.withColumnRenamed("chunk_id", "id"), old.withColumnRenamed("chunk_id", "id")).first()["id"] == "c"
    with pytest.raises(NotImplementedError):
        stores.ManagedStore("x")


def test_landed_files(spark):
    f = [("A", "10-K", f"20{y}-01-01", f"1-{y}-7", "x.htm") for y in range(18, 25)] + [("A", "8-K", "2024-06-01", "1-24-9", "y.htm"), ("A", "8-K", "2020-01-01", "1-20-9", "y.htm"), ("A", "10-K", "2025-01-01", "1-25-1", None)]
    df = spark.createDataFrame(f, "ticker string, form string, date string, accession string, primary_doc string")
    got = landed.select_filings(df, F.lit("2024-12-31").cast("date"))
    assert got.where("form = '10-K'").agg(F.min("date")).first()[0] == "2022-01-01"
    assert got.where("form = '8-K'").count() == 1
    page = "<table><tr><td>1</td><td>d</td><td><a href='/ix?doc=/a/b.htm'>b</a></td><td>EX-13.1</td></tr><tr><td>2</td></tr></table>"
    links = landed.exhibit_links(spark.createDataFrame([("acc", page)], "accession string, html string"))
    assert links.first()["href"] == "/a/b.htm"
    ex = spark.createDataFrame([("acc", 2, "two"), ("acc", 1, "one"), ("acc", 3, None)], "accession string, seq int, text string")
    assert landed.with_exhibits(spark.createDataFrame([("acc", "body")], "accession string, text string"), ex).first()["text"] == "body one two"
    assert [tuple(r) for r in landed.quarter_bounds(spark, "2024-02-10", "2024-05-01").collect()] == [("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30")]
    d = landed.discover_documents(spark.createDataFrame([("<a href='/m/minutes20240131.htm'>", )], "html string"), {"minutes": r"/m/minutes\d{8}\.htm"}, "2022-01-01").first()
    assert (d["kind"], d["date"]) == ("minutes", "2024-01-31")


def test_streaming_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp_ntz'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,cast(id as int)) as ts, id % 3 as user_id, 'view' as event_type, 1.0d as value from range(60)").write.parquet(src)
    schema = "ts timestamp_ntz, user_id long, event_type string, value double"
    ingest.run_to_end(ingest.tumbling(ingest.read_stream(spark, src, schema), "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = ingest.tumbling(spark.read.parquet(src), "10 minutes")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= {tuple(r) for r in batch.collect()}
    assert ingest.sessions(spark.read.parquet(src)).count() >= 3
