"""Intervals, tests and percentiles."""

import hashlib
import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.functions import stats as S
from evispark.operators import evaluation as ev
from evispark.operators import screen
from evispark.plans import evaluation as plans


def test_wilson(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (0, 0), (5, 10), (50, 100)], "k int, n int")
    low, high = S.wilson(F.col("k"), F.col("n"))
    r = df.select(low.alias("a"), high.alias("b")).collect()
    assert r[0]["a"] == 0 and 0 < r[0]["b"] < 1
    assert r[1]["b"] == 1
    assert (r[2]["a"], r[2]["b"]) == (0, 0)
    assert r[4]["b"] - r[4]["a"] < r[3]["b"] - r[3]["a"]


def test_p_values_against_erfc(spark):
    zs = [0.0, 0.5, 1.0, 1.96, 3.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(S.two_sided_p(F.col("z"))).collect()]
    for z, p in zip(zs, got, strict=True):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-7)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40))
def test_exclusive_percentile_is_the_library_s(spark, xs):
    got = spark.createDataFrame([(sorted(xs),)], "v array<int>").select(S.exclusive_percentile(F.col("v"), 95)).first()[0]
    assert got == pytest.approx(statistics.quantiles(xs, n=100)[94])
    table = spark.createDataFrame([("g", x) for x in xs], "g string, ms int")
    row = ev.latency(table, "g", "ms").first()
    assert row["p50"] == statistics.median(xs)
    assert row["p95"] == pytest.approx(statistics.quantiles(xs, n=100)[94])


def test_nearest_rank_and_lone_values(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([7],)], "v array<int>")
    assert [r[0] for r in df.select(S.nearest_rank(F.col("v"), 0.95)).collect()] == [4, 7]
    assert [r[0] for r in df.select(S.exclusive_percentile(F.col("v"), 95)).collect()][1] == 7


def test_nearest_rank_counts_repeated_values(spark, tmp_path):
    xs = [1] * 90 + [2] * 6 + list(range(3, 7))
    rows = [("a", x) for x in xs] + [("a", None), ("b", 7), (None, 1)]
    spark.createDataFrame(rows, "route_reason string, generation_ms long").write.parquet(str(tmp_path / "answers.parquet"))
    got = {r["route_reason"]: r["p95"] for r in plans.nearest_rank_p95(spark, str(tmp_path)).collect()}
    assert got == {"a": sorted(xs)[min(99, int(0.95 * 100))], "b": 7}


def test_bootstrap_takes_the_reference_s_ends(spark):
    deltas = [0.5, 0.0, -0.5, 1.0, 0.5, 0.0, 0.0, 0.5, -1.0, 1.0]
    df = spark.createDataFrame([("all", i, 10, x) for i, x in enumerate(deltas)], "g string, at long, n long, delta double")
    draw = lambda r, i: int(hashlib.md5(f"{r}|{i}".encode()).hexdigest()[:8], 16) % 10
    want = sorted(sum(deltas[draw(r, i)] for i in range(10)) / 10 for r in range(10_000))
    got = S.bootstrap_interval(S.bootstrap_means(df, "g", ["delta"]), "g", "delta").collect()
    assert [(r["low"], r["high"], r["p_better"]) for r in got] == [(pytest.approx(want[250]), pytest.approx(want[9750]), sum(x > 0 for x in want) / 10_000)]


def _bh(ps, alpha=0.05):
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    q, best = [0.0] * m, 1.0
    for place in range(m, 0, -1):
        i = order[place - 1]
        best = min(best, ps[i] * m / place)
        q[i] = best
    return q


@pytest.mark.parametrize("ps", [[0.001, 0.04] + [0.5] * 18, [0.04] * 20, [0.01, 0.02, 0.02, 0.9, 1.0]])
def test_benjamini_hochberg(spark, ps):
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")
    got = {r["i"]: (r["q_value"], r["flagged"]) for r in S.benjamini_hochberg(df).collect()}
    for i, q in enumerate(_bh(ps)):
        assert got[i][0] == pytest.approx(q)
        assert got[i][1] == (q <= 0.05)


def _complaints(spark, cells):
    rows, k = [], 0
    for company, n, hits in cells:
        for i in range(n):
            k += 1
            rows.append((str(k), "Card", company, "Closed with monetary relief" if i < hits else "Closed with explanation", "Yes", None))
    return spark.createDataFrame(rows, "complaint_id string, product string, company string, company_response string, timely string, date_received timestamp")


def test_screen_takes_the_others_as_baseline(spark):
    r = {x["company"]: x for x in screen.screen(screen.resolved(_complaints(spark, [("BIG", 400, 40), ("SMALL", 100, 50), ("TINY", 10, 1)]))).collect()}
    assert set(r) == {"BIG", "SMALL"}
    assert r["BIG"]["rate"] == pytest.approx(0.1)
    assert r["BIG"]["baseline_n"] == 110
    assert r["BIG"]["baseline_rate"] == pytest.approx(51 / 110)


def test_screen_without_a_baseline_is_empty_and_flags_only_the_outlier(spark):
    assert screen.screen(screen.resolved(_complaints(spark, [("BIG", 100, 10), ("X", 10, 1)]))).count() == 0
    cells = [("OUT", 60, 54)] + [(f"C{i}", 200, 40) for i in range(10)]
    a = screen.adjusted(screen.screen(screen.resolved(_complaints(spark, cells))))
    assert [r["company"] for r in a.where("flagged").collect()] == ["OUT"]
    assert screen.report(a).first()["flagged"] == 1


def test_open_complaints_leave_and_null_responses_stay(spark):
    rows = [("1", "Card", "A", "In progress", "Yes", None), ("2", "Card", "A", None, None, None), ("3", "Card", "A", "Closed with monetary relief", "No", None), ("3", "Card", "A", "Closed with monetary relief", "No", None)]
    df = spark.createDataFrame(rows, "complaint_id string, product string, company string, company_response string, timely string, date_received timestamp")
    got = {r["complaint_id"]: (r["relief"], r["on_time"]) for r in screen.resolved(df).collect()}
    assert got == {"2": (False, False), "3": (True, False)}


def test_z_is_null_without_spread(spark):
    df = spark.createDataFrame([(0, 10, 0, 10)], "a int, n int, b int, m int")
    assert df.select(S.pooled_z(F.col("a"), F.col("n"), F.col("b"), F.col("m"))).first()[0] is None
