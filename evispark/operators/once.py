"""Repeated rows once, without a shuffle of whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.session import checkpointed

#: Most keys of repeated rows that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000

#: Most keys of wanted rows that are broadcast, as 64-bit hashes; for more, rows are joined by a shuffle.
BROADCAST_HASHES = 2_000_000


def once_each(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows, repeated ones once. Texts are told apart by a 64-bit hash and their length, nulls equal nulls.

    Only the other columns, the hash and the length are grouped; a text itself moves only where its row is
    repeated. An empty table gives no rows.
    """
    others = [c for c in rows.columns if c != text]
    keys = [*others, "_hash", "_chars"]
    keyed = rows.withColumn("_hash", F.xxhash64(text)).withColumn("_chars", F.coalesce(F.length(text), F.lit(-1)))
    repeated = checkpointed(keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_of_{k}") for k in keys]))
    n = repeated.count()
    if not n:
        return rows
    side = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    # an equality on the hash for the join, the rest null-safe
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    single = keyed.join(side, on, "left_anti")
    again = keyed.join(side, on, "left_semi").dropDuplicates(keys)
    return single.unionByName(again).select(*rows.columns)


def one_row_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key and order, a row for each key: the least by the columns of order. Only rows of repeated keys are grouped. The key isn't null."""
    repeated = checkpointed(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    n = repeated.count()
    rows = rows.select(key, *order)
    if not n:
        return rows
    side = F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated
    least = rows.join(side, key, "left_semi").groupBy(key).agg(F.min(F.struct(*order)).alias("_x")).select(key, "_x.*")
    return rows.join(side, key, "left_anti").unionByName(least)


def only_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose columns of keys stand in keys, so that no other leaves its task. Told by a 64-bit hash: the few others it lets through must fall out of a later join by the keys."""
    hashed = F.xxhash64(*keys.columns)
    side = checkpointed(keys.select(hashed.alias("_key")).distinct())
    side = F.broadcast(side) if side.count() <= BROADCAST_HASHES else side
    return rows.withColumn("_key", hashed).join(side, "_key", "left_semi").select(*rows.columns)
