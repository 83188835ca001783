"""Sketches of shards that are kept and merged later, so that a figure over all shards needs none of their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shard_sketches(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = (), top: Sequence[str] = (), precision: int = 14, k: int = 800, most: int = 1000) -> DataFrame:
    """For each group of `by`, such as a shard and a day, its rows and the state of a sketch of each named column.

    distinct_<c> is a HyperLogLog of 2^precision counters (relative deviation 1.04 / sqrt(2^precision): 0.8 % at 14), quantiles_<c> a KLL sketch (rank error
    about 1.65 % at 200, 0.5 % at 800) of the column as a double, top_<c> the frequent values of a table of at most `most` (a count is too low by at most the share 3.5 / most of the rows). Nulls are in
    no sketch. States are binary and of bounded size; they are made by partial aggregation.
    """
    made = [F.count("*").alias("rows")]
    made += [F.hll_sketch_agg(c, precision).alias(f"distinct_{c}") for c in distinct]
    made += [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"quantiles_{c}") for c in quantiles]
    made += [F.expr(f"approx_top_k_accumulate(`{c}`, {most})").alias(f"top_{c}") for c in top]
    return df.groupBy(*by).agg(*made)


def merge_sketches(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of coarser groups out of those of finer ones, or of all."""
    made = [F.sum("rows").alias("rows")]
    for c in states.columns:
        if c.startswith("distinct_"):
            made.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("quantiles_"):
            made.append(F.kll_merge_agg_double(c).alias(c))
        elif c.startswith("top_"):
            made.append(F.expr(f"approx_top_k_combine(`{c}`)").alias(c))
    return states.groupBy(*by).agg(*made) if by else states.agg(*made)


def distinct_count(state: str):
    """The estimated number of different values."""
    return F.hll_sketch_estimate(state)


def quantile(state: str, rank: float):
    """The value at a rank from 0 to 1."""
    return F.kll_sketch_get_quantile_double(state, F.lit(rank))


def most_frequent(state: str, k: int):
    """The k most frequent values as structs of item and count, by falling count."""
    return F.expr(f"approx_top_k_estimate(`{state}`, {k})")
