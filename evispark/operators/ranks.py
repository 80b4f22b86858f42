"""Running sums and ranks within groups that may be larger than a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import checkpointed


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """df with `name`: the sum of weight over the rows before this one in its group, in the given order.

    Rows are range-partitioned by keys and order, so a hot group spreads over many tasks;
    each range's sum is added to the ranges behind it. Equal rows come in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_w", weight.cast("double")).repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    own = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range", *keys).agg(F.sum("_w").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0.0))).drop("_s")
    on = F.col("a._range") == F.col("b._range")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    local = ranged.withColumn("_own", F.coalesce(F.sum("_w").over(own), F.lit(0.0)))
    joined = local.alias("a").join(sums.alias("b"), on)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._own") + F.col("b._before")).alias(name))
