"""Joins of intervals by overlap alone, as equi-joins of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialize


def _number(df: DataFrame, name: str) -> Column:
    """A bound as a whole number of the same order: microseconds, days, or the number rounded down."""
    kind = df.schema[name].dataType
    c = df[f"`{name}`"]
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        since = (c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(24,6)")
        return (since * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.floor(c).cast("long")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise TypeError(f"{name} has the type {kind.simpleString()}, which is no number, date or time")


def _placed(df: DataFrame, side: str, low: str, high: str) -> DataFrame:
    """The rows with their bounds as numbers, and their level: the least one whose bins are longer than the interval."""
    out = df.select("*", _number(df, low).alias(f"{side}_lo"), _number(df, high).alias(f"{side}_hi"))
    fine = out.where((F.col(f"`{low}`") <= F.col(f"`{high}`")) & F.col(f"{side}_lo").isNotNull() & F.col(f"{side}_hi").isNotNull())
    length = F.col(f"{side}_hi") - F.col(f"{side}_lo")
    return fine.withColumn(f"{side}_level", F.when(length == 0, 0).otherwise(F.length(F.bin(length))).cast("int"))


def _bins(df: DataFrame, side: str, level: Column) -> DataFrame:
    """The rows with each bin of that level that they touch, two at most."""
    ends = [F.expr(f"shiftright({side}_{end}, level)") for end in ("lo", "hi")]
    return df.withColumn("level", level).withColumn("bin", F.explode(F.array_distinct(F.array(*ends))))


def interval_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """All pairs of rows whose closed intervals [low, high] have a point in common; columns of both, the left's first. Ranges
    name the columns of low and high. Numbers, dates and timestamps of one kind are compared; rows with a null
    bound, or low beyond high, have no partner. Columns of one name on both sides are an error.

    An interval lies at the level l where bins of 2^l are just longer than it, so it touches two bins there at most. The shorter one of a
    pair is brought up to the longer one's level, once for each level the other side has, again in two bins at most. So each pair meets in an
    equi-join by (level, bin), which Spark shuffles and splits like any other: there is no nested loop, and copies of a
    row are bounded by twice the other side's levels, 126 at worst. Two intervals may meet in two bins: the pair counts in that
    where their common part begins.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    a, b = _placed(left, "_a", *left_range), _placed(right, "_b", *right_range)
    parts = []
    for long, short, longer in ((a, b, "_a"), (b, a, "_b")):
        shorter = "_b" if longer == "_a" else "_a"
        # 64 levels at most reach the driver. Of equal levels the left side is the longer one.
        levels = [r[0] for r in long.select(f"{longer}_level").distinct().collect()]
        up = F.explode(F.filter(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>"), lambda x: x >= F.col(f"{shorter}_level") if longer == "_a" else x > F.col(f"{shorter}_level")))
        joined = _bins(long, longer, F.col(f"{longer}_level")).join(_bins(short, shorter, up), ["level", "bin"])
        begins = F.expr("shiftright(greatest(_a_lo, _b_lo), level)") == F.col("bin")
        meet = (F.col(f"`{left_range[0]}`") <= F.col(f"`{right_range[1]}`")) & (F.col(f"`{right_range[0]}`") <= F.col(f"`{left_range[1]}`"))
        parts.append(joined.where(begins & meet).select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)]))
    return parts[0].unionAll(parts[1])


def overlap_totals(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], count: str = "count", **sums: str) -> DataFrame:
    """Each right row that overlaps a left one (see `interval_join`), with the number of left rows that it overlaps in the column `count` and
    their sums: name=left column.

    Rows of equal intervals are added up first, on the left, and stand for each other, on the right: only different intervals are joined.
    So the pairs grow with the different intervals of both sides, not with the rows; the rest is one pass over each side. Where all
    intervals differ that saves nothing.
    """
    held = {"_rows": F.count("*"), **{f"_sum_{i}": F.sum(f"`{c}`") for i, c in enumerate(sums.values())}}
    rows = materialize(left.groupBy(*[F.col(f"`{c}`").alias(f"_left_{i}") for i, c in enumerate(left_range)]).agg(*[c.alias(n) for n, c in held.items()]))
    bounds = [f"_right_{i}" for i in range(2)]
    marked = right.withColumns({n: F.col(f"`{c}`") for n, c in zip(bounds, right_range)})
    met = interval_join(rows, materialize(marked.select(*bounds).distinct()), ("_left_0", "_left_1"), tuple(bounds))
    totals = met.groupBy(*bounds).agg(*[F.sum(n).alias(n) for n in held])
    return marked.join(totals, bounds).select(*[F.col(f"`{c}`") for c in right.columns], *[F.col(n).alias(shown) for n, shown in zip(held, (count, *sums))])
