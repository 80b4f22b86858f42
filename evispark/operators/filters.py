"""Metadata filters: one compiler from a filter dict to a Column, with the store's semantics."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_filter(df: DataFrame, filters: dict[str, Any] | None) -> Column:
    """AND over the fields. A scalar is null-safe equality, a list membership, {"prefix": s or several} any prefix.

    A field that df doesn't have equals only None; an empty filter passes all rows.
    """
    out = F.lit(True)
    for field, want in (filters or {}).items():
        c = F.col(field) if field in df.columns else F.lit(None).cast("string")
        if isinstance(want, dict):
            prefixes = want["prefix"]
            prefixes = [prefixes] if isinstance(prefixes, str) else list(prefixes)
            is_text = field in df.columns and dict(df.dtypes)[field] == "string"
            one = F.coalesce(reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False)), F.lit(False)) if is_text else F.lit(False)
        elif isinstance(want, list | tuple | set):
            one = reduce(lambda a, b: a | b, [c.eqNullSafe(F.lit(v)) for v in want], F.lit(False))
        else:
            one = c.eqNullSafe(F.lit(want))
        out = out & one
    return out


def union_filters(filters: DataFrame, group: str = "query_id") -> DataFrame:
    """group, field, values: what the sub-questions of a group want, sorted; prefix filters (kind = prefix) are dropped."""
    return filters.where("kind <> 'prefix'").groupBy(group, "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
