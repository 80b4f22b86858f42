"""Outcome disparity screen: each cell against the rest of its product, corrected over the family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.stats import Z95_EXACT, benjamini_hochberg, pooled_z, two_sided_p, wilson

# Responses that give relief, and one that settles nothing yet.
RELIEF = ("Closed with monetary relief", "Closed with non-monetary relief")
UNRESOLVED = "In progress"


def resolved(complaints: DataFrame) -> DataFrame:
    """complaints without open ones, with relief and on_time; a null response or flag counts as false. Repeated ids count once, their last row."""
    rest = [c for c in complaints.columns if c != "complaint_id"]
    one = complaints.groupBy("complaint_id").agg(F.max(F.struct("date_received", *[c for c in rest if c != "date_received"])).alias("x")).select("complaint_id", "x.*")
    return one.where(F.coalesce(F.col("company_response") != UNRESOLVED, F.lit(True))).withColumn("relief", F.coalesce(F.col("company_response").isin(*RELIEF), F.lit(False))).withColumn("on_time", F.coalesce(F.col("timely") == "Yes", F.lit(False)))


def screen(rows: DataFrame, outcome: str = "relief", min_cell: int = 50) -> DataFrame:
    """company, product, n, rate, ci_low, ci_high, baseline_rate, baseline_n, difference, z, p_value of each cell that, like its baseline, has min_cell rows.

    The baseline is the product's total less the cell, from one window over the pre-aggregated cells. z and p are null where the pooled rate is 0 or 1.
    """
    cells = rows.where("company is not null and product is not null").groupBy("company", "product").agg(F.count("*").alias("n"), F.count_if(F.col(outcome)).alias("hits"))
    whole = Window.partitionBy("product")
    cells = cells.withColumn("bn", F.sum("n").over(whole) - F.col("n")).withColumn("bh", F.sum("hits").over(whole) - F.col("hits")).where((F.col("n") >= min_cell) & (F.col("bn") >= min_cell))
    low, high = wilson(F.col("hits"), F.col("n"), Z95_EXACT, clamp=True, empty=float("nan"))
    z = pooled_z(F.col("hits"), F.col("n"), F.col("bh"), F.col("bn"))
    rate, base = F.col("hits") / F.col("n"), F.col("bh") / F.col("bn")
    out = cells.select("company", "product", "n", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"), base.alias("baseline_rate"), F.col("bn").alias("baseline_n"), (rate - base).alias("difference"), z.alias("z"))
    return out.withColumn("p_value", two_sided_p(F.col("z")))


def adjusted(screened: DataFrame, alpha: float = 0.05) -> DataFrame:
    return benjamini_hochberg(screened, "p_value", alpha)


def report(adjusted_rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """cells, raw, flagged, share, median_flagged, median_quiet, too_many: one row."""
    size = F.abs("difference")
    r = adjusted_rows.agg(F.count("*").alias("cells"), F.count_if(F.col("p_value") < alpha).alias("raw"), F.count_if(F.col("flagged")).alias("flagged"), F.median(F.when(F.col("flagged"), size)).alias("median_flagged"), F.median(F.when(~F.col("flagged"), size)).alias("median_quiet"))
    share = F.when(F.col("cells") > 0, F.col("flagged") / F.col("cells"))
    return r.select("cells", "raw", "flagged", share.alias("share"), "median_flagged", "median_quiet", (share > 0.25).alias("too_many"))
