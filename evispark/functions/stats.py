"""Intervals, tests and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96
Z95_EXACT = 1.959963984540054

#: Most values that are broadcast to a bootstrap's draws; more are joined by a shuffle.
BROADCAST_VALUES = 1_000_000

# Coefficients of the complementary error function in Horner form, from Numerical Recipes.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _lit(x: float) -> Column:
    return F.lit(float(x))


def wilson(hits: Column, n: Column, z: float = Z95, clamp: bool = True, empty: float | None = 0.0) -> tuple[Column, Column]:
    """Lower and upper bound of a rate; `empty` where n is 0."""
    n_, p = n.cast("double"), hits / n
    z2 = z * z
    scale = 1 + _lit(z2) / n_
    centre = (p + _lit(z2) / (2 * n_)) / scale
    half = _lit(z) * F.sqrt(p * (1 - p) / n_ + _lit(z2) / (4 * n_ * n_)) / scale
    low, high = centre - half, centre + half
    if clamp:
        low, high = F.greatest(low, _lit(0)), F.least(high, _lit(1))
    none = F.lit(empty).cast("double")
    return F.when(n > 0, low).otherwise(none), F.when(n > 0, high).otherwise(none)


def erfc(x: Column) -> Column:
    """For x at or above 0; relative error below 1.2e-7."""
    t = _lit(1) / (1 + x / 2)
    poly = _lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = _lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(_lit(2)))


def pooled_z(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """Two-proportion z with a pooled rate; null where that rate is 0 or 1."""
    pool = (hits_a + hits_b) / (n_a + n_b)
    spread = F.sqrt(pool * (1 - pool) * (_lit(1) / n_a + _lit(1) / n_b))
    return F.when((pool > 0) & (pool < 1), (hits_a / n_a - hits_b / n_b) / spread)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """df with q_value and flagged over the whole family of rows whose p isn't null.

    The family is what one screen tests, so its size is that of a report; one window orders it.
    """
    tested = df.where(F.col(p).isNotNull())
    same = tested.groupBy(p).agg(F.count("*").alias("_same"))
    place = F.rank().over(Window.orderBy(F.col(p))) + F.col("_same") - 1  # the last place of equal values
    raw = tested.join(same, p).withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy()) / place)
    rest = Window.orderBy(F.col(p)).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    out = raw.withColumn("q_value", F.least(F.min("_q").over(rest), _lit(1))).drop("_q", "_same")
    return out.withColumn("flagged", F.col("q_value") <= alpha)


def exclusive_percentile(values: Column, pct: int) -> Column:
    """Percentile of a sorted array by the exclusive method with linear interpolation; a lone value is itself."""
    n = F.size(values)
    pos = F.lit(pct) * (n + 1)
    j = F.least(F.greatest(F.floor(pos / 100).cast("int"), F.lit(1)), n - 1)
    d = (pos - 100 * j).cast("double")
    at = lambda i: F.try_element_at(values, i).cast("double")
    return F.when(n == 0, F.lit(None)).when(n == 1, at(F.lit(1))).otherwise((at(j) * (100 - d) + at(j + 1) * d) / 100)


def nearest_rank(values: Column, share: float) -> Column:
    """Element min(n - 1, int(share * n)), from 0, of a sorted array."""
    n = F.size(values)
    return F.try_element_at(values, F.least(n, F.floor(F.lit(share) * n).cast("int") + 1))


def nearest_rank_by(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """group, value: nearest_rank over all samples of each group, repeated ones too; null only where all are. Values are gathered as counts."""
    per = df.groupBy(group, value).agg(F.count(value).alias("_c"))
    run = Window.partitionBy(group).orderBy(F.col(value).asc_nulls_first())
    cum = per.withColumn("_upto", F.sum("_c").over(run)).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    at = F.least(F.col("_n"), F.floor(F.lit(share) * F.col("_n")) + 1)
    return cum.groupBy(group).agg(F.min(F.when(F.col("_upto") >= at, F.col(value))).alias(value))


def bootstrap_means(df: DataFrame, group: str, values: list[str], rounds: int = 10_000) -> DataFrame:
    """group, round, n, and the mean of each value column over n rows drawn with replacement by hash.

    df needs `group`, `at` (0 .. n-1 within the group) and n; draw i of round r is row md5(r|i) mod n,
    so any engine draws alike. Rounds are spread over tasks; a group is a set of questions, not raw data.
    Values are broadcast up to BROADCAST_VALUES rows and joined by a shuffle beyond.
    """
    spark = df.sparkSession
    r = spark.range(rounds).select(F.col("id").cast("int").alias("round"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("round").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    size = df.select(group, "n").distinct()
    draws = r.crossJoin(F.broadcast(size)).select(group, "round", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))  # a row for each group
    draws = draws.select(group, "round", (pick % F.col("n")).alias("at"))
    own = df.select(group, "at", *values)
    own = F.broadcast(own) if own.count() <= BROADCAST_VALUES else own
    return draws.join(own, [group, "at"]).groupBy(group, "round").agg(*[F.avg(v).alias(v) for v in values])


def bootstrap_interval(means: DataFrame, group: str, value: str, rounds: int = 10_000) -> DataFrame:
    """group, low, high, p_better of the rounds' means: elements int(.025 R) and int(.975 R) from 0, and the share of rounds above 0."""
    v = F.array_sort(F.collect_list(value))  # one value for each round
    at = lambda share: F.element_at("_v", int(share * rounds) + 1)
    return means.groupBy(group).agg(v.alias("_v"), F.avg((F.col(value) > 0).cast("int")).alias("p_better")).select(group, at(0.025).alias("low"), at(0.975).alias("high"), "p_better")
