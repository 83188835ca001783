"""Shards by a Feistel permutation of row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import number_rows

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(rows: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """Where each row number of 0..n-1 goes under the seed's permutation of these numbers.

    A balanced Feistel network permutes the least 2k-bit domain that holds n, at most 4n numbers; a
    result outside 0..n-1 is sent through again until it falls inside (cycle walking), which keeps
    the map a permutation. It needs no table, so any task computes any row's place.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64) for r in range(ROUNDS)]
    out = np.asarray(rows, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for key in keys if not inverse else keys[::-1]:
            if inverse:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The permuted row number as a column."""

    @F.pandas_udf("long")
    def go(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return go(row)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of each document, law `rows`.

    Rows are numbered by doc_id, then by size and checksum, and the permuted number p gives shard
    p mod shards and slot p div shards: shard counts differ by one at most, slots have no gap, and both
    follow from row number, row count and seed. Size is the text's UTF-8 bytes plus 1; a null text has
    none. Repeated rows are alike in all that is numbered; null ids come first; an empty table gives an
    empty one; other columns are left out. Texts themselves are not moved.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered = number_rows(slim, "doc_id", "size", "text_crc32")
    n = numbered.count()
    p = numbered.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return p.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
    )
