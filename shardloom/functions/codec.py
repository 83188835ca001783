"""Compression and toy encryption of texts, for data written by older tools.

These two need byte loops that no built-in expresses, so they are Arrow functions, which hold a few texts at a time besides their batch. Those on
columns bound the batches of the active session by bytes; columns don't know their own, so who applies them in another one calls `bound_batches` with it.
Those on DataFrames do so. New data is better compressed by the file format and encrypted with aes_encrypt.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import bound_batches

_RUN = re.compile(rb"(.)\1{3,254}", re.DOTALL)
_MARK = re.compile(rb"\xff(.)(.)", re.DOTALL)


def rle_pack(data: bytes) -> bytes:
    """Runs of 4 to 255 equal bytes as FF, byte, count. Text in UTF-8 has no FF byte of its own."""
    return _RUN.sub(lambda m: b"\xff" + m.group(1) + bytes([len(m.group(0))]), data)


def rle_unpack(data: bytes) -> bytes:
    return _MARK.sub(lambda m: m.group(1) * m.group(2)[0], data)


def _each(texts: pa.Array, fn: Callable[[str], str], most: int = 64) -> pa.Array:
    """fn of every text but null, `most` texts at a time."""
    return pa.concat_arrays([pa.array([None if t is None else fn(t) for t in texts[k : k + most].tolist()], pa.string()) for k in range(0, max(1, len(texts)), most)])


@F.arrow_udf(T.StringType())
def _compress(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: base64.b64encode(rle_pack(t.encode())).decode())


@F.arrow_udf(T.StringType())
def _decompress(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: rle_unpack(base64.b64decode(t)).decode())


def compress(text: Column, threshold: int = 1024) -> Column:
    """The packed text in base64 if it is longer than the threshold in bytes, else the text."""
    bound_batches(SparkSession.active())
    large = F.octet_length(text) > threshold
    return F.when(large, _compress(F.when(large, text))).otherwise(text)  # the function runs on all rows, so it gets null for the others


def decompress(text: Column, packed: Column) -> Column:
    """The text that was packed where `packed` is true."""
    bound_batches(SparkSession.active())
    return F.when(packed, _decompress(F.when(packed, text))).otherwise(text)


def shift_encrypt(text: Column, key: str) -> Column:
    """Bytes plus the repeated key's bytes modulo 256, in base64: a demonstration cipher, not a safe one."""
    return _shifted(key, 1)(text)


def shift_decrypt(text: Column, key: str) -> Column:
    return _shifted(key, -1)(text)


def _shifted(key: str, sign: int):
    if not key:
        raise ValueError("the key is empty")
    bound_batches(SparkSession.active())
    k = np.frombuffer(key.encode(), np.uint8)

    def moved(data: bytes) -> bytes:
        raw = np.frombuffer(data, np.uint8)
        by = np.resize(k, len(raw))  # bytes too, and for this text alone
        return (raw + by if sign > 0 else raw - by).tobytes()

    @F.arrow_udf(T.StringType())
    def go(texts: pa.Array) -> pa.Array:
        return _each(texts, lambda t: base64.b64encode(moved(t.encode())).decode() if sign > 0 else moved(base64.b64decode(t)).decode())

    return go


def packed_columns(df: DataFrame, columns: Sequence[str], threshold: int = 1024) -> DataFrame:
    """Texts longer than the threshold in bytes move from their column to `_c_<column>`, packed; null else."""
    bound_batches(df.sparkSession)
    out = {}
    for c in columns:
        large = F.octet_length(c) > threshold
        out[f"_c_{c}"] = F.when(large, compress(F.col(c), threshold))
        out[c] = F.when(large, F.lit(None).cast("string")).otherwise(F.col(c))
    return df.select("*", *[v.alias(f"_new_{n}") for n, v in out.items()]).select(
        *[F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns], *[F.col(f"_new__c_{c}").alias(f"_c_{c}") for c in columns]
    )


def unpacked_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As before `packed_columns`."""
    bound_batches(df.sparkSession)
    back = {c: F.coalesce(decompress(F.col(f"_c_{c}"), F.col(f"_c_{c}").isNotNull()), F.col(c)) for c in columns}
    return df.select(*[back[c].alias(c) if c in columns else F.col(c) for c in df.columns if not (c.startswith("_c_") and c[3:] in columns)])
