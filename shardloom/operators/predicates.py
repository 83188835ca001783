"""Filters and row checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The comparison operators that `where` takes, by their names in SQL.
OPERATORS = ("=", "!=", "<>", "<", ">", "<=", ">=", "LIKE", "IN", "BETWEEN", "IS NULL", "IS NOT NULL")


def where(field: str, operator: str, value=None) -> Column:
    """A condition built as an expression, so that values can never be read as SQL."""
    c, op = F.col(f"`{field}`"), operator.strip().upper()
    simple = {"=": c.__eq__, "!=": c.__ne__, "<>": c.__ne__, "<": c.__lt__, ">": c.__gt__, "<=": c.__le__, ">=": c.__ge__, "LIKE": c.like}
    if op in simple:
        return simple[op](value)
    if op == "IN":
        return c.isin(list(value))
    if op == "BETWEEN":
        return c.between(*value)
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    raise ValueError(f"operator {operator!r} is not one of {OPERATORS}")


def matching(df: DataFrame, values: Mapping) -> DataFrame:
    """Rows equal to all given values; None matches null, a list any of its members."""
    for name, v in values.items():
        c = F.col(f"`{name}`")
        df = df.where(c.isin(v) if isinstance(v, (list, tuple)) else c.eqNullSafe(F.lit(v)))
    return df


def without_nulls(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null in the fields, or in any column."""
    return df.na.drop("any", subset=list(fields) if fields else None)


def without_duplicates(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Each different row, or one row for each different value of the fields (the least of its rows)."""
    if not fields:
        return df.distinct()
    rest = [c for c in df.columns if c not in fields]
    if not rest:
        return df.distinct()
    least = df.groupBy(*fields).agg(F.min(F.struct(*rest)).alias("_r"))
    return least.select(*[F.col(c) if c in fields else F.col(f"_r.{c}").alias(c) for c in df.columns])


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(removed): how many rows a filter took out."""
    signed = before.select(F.lit(1).alias("n")).union(after.select(F.lit(-1).alias("n")))
    return signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed"))
