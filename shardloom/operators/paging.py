"""Pages of a large ordered table: its rows are laid out in order once, and a page then reads only the files it lies in."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from .fusion import _order

TIE = "_tie"


@dataclass(frozen=True)
class Token:
    """Where a page ended: the part, the order's values and the tie of its last row."""

    part: int
    values: tuple
    tie: int


@dataclass(frozen=True)
class PageIndex:
    """Parts of a table in the order of `keys`, (column, ascending) pairs; nulls last where ascending, first where descending.

    Below `path`, `data/part=<n>` holds the n-th part in order, one file each, and `index.json` the rows of each. Rows alike in all keys
    are told apart by a hash of the whole row, so pages neither repeat nor lose any.
    """

    spark: SparkSession
    path: str
    keys: tuple[tuple[str, bool], ...]
    schema: T.StructType
    counts: tuple[int, ...]

    @classmethod
    def write(cls, df: DataFrame, path: str, keys: Sequence[tuple[str, bool]], rows: int = 1_000_000) -> PageIndex:
        """Lay out `df` in parts of about so many rows: one range shuffle and one write. The driver gets one count a part."""
        spark = df.sparkSession
        parts = max(1, math.ceil(df.count() / rows))
        tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        order = [*_order(keys), F.col(TIE)]
        dealt = df.withColumn(TIE, tie).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
        dealt.write.partitionBy("part").parquet(f"{path}/data")
        schema = T.StructType([*df.schema.fields, T.StructField(TIE, T.LongType())])
        counted = {}
        if any(n.startswith("part=") for n in files.names(spark, f"{path}/data")):
            held = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{path}/data")
            counted = {r["part"]: r["count"] for r in held.groupBy("part").count().collect()}
        counts = [counted.get(k, 0) for k in range(max(counted, default=-1) + 1)]
        files.create(spark, f"{path}/index.json", json.dumps({"keys": [list(k) for k in keys], "schema": df.schema.jsonValue(), "counts": counts}))
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PageIndex:
        d = json.loads(files.read(spark, f"{path}/index.json"))
        return cls(spark, path, tuple((c, bool(a)) for c, a in d["keys"]), T.StructType.fromJson(d["schema"]), tuple(d["counts"]))

    @property
    def total(self) -> int:
        return sum(self.counts)

    def _parts(self, parts: Sequence[int]) -> DataFrame:
        """The rows of some parts with their part, in order."""
        schema = T.StructType([*self.schema.fields, T.StructField(TIE, T.LongType()), T.StructField("part", T.IntegerType())])
        paths = [f"{self.path}/data/part={p}" for p in parts if self.counts[p]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).orderBy(*_order(self.keys), TIE)

    def page(self, offset: int, limit: int, marked: bool = False) -> DataFrame:
        """Rows offset to offset + limit - 1. Only the parts are read that hold some of them: two at most, if a part has `limit` rows or more.
        With `marked` the columns that `token` needs stay."""
        before, first, chosen = 0, None, []
        for p, n in enumerate(self.counts):
            if before < offset + limit and before + n > offset and n:
                first = before if first is None else first
                chosen.append(p)
            before += n
        out = self._parts(chosen).offset(offset - (first or 0)).limit(limit) if chosen else self._parts([])
        return out if marked else out.select(*self.schema.names)

    def after(self, token: Token, limit: int, marked: bool = False) -> DataFrame:
        """The `limit` rows after those of the page that gave the token. What it reads does not grow with how far in that page was."""
        chosen, rest = [token.part], 0
        while rest < limit and chosen[-1] + 1 < len(self.counts):
            chosen.append(chosen[-1] + 1)
            rest += self.counts[chosen[-1]]
        out = self._parts(chosen).where(_beyond(self.keys, token)).limit(limit)
        return out if marked else out.select(*self.schema.names)

    def token(self, marked: DataFrame) -> Token | None:
        """The token of a marked page, for `after`; None of an empty one. One row reaches the driver."""
        last = marked.orderBy(*[_reversed(c, a) for c, a in self.keys], F.desc(TIE)).first()
        return None if last is None else Token(last["part"], tuple(last[c] for c, _ in self.keys), last[TIE])

    def has_more(self, offset: int, limit: int) -> bool:
        return self.total > offset + limit


def _reversed(name: str, ascending: bool) -> Column:
    return F.col(name).desc_nulls_first() if ascending else F.col(name).asc_nulls_last()


def _beyond(keys: Sequence[tuple[str, bool]], token: Token) -> Column:
    """Whether a row comes after the token's in the order."""
    out = F.col(TIE) > F.lit(token.tie)
    for (name, ascending), value in list(zip(keys, token.values))[::-1]:
        c, v = F.col(name), F.lit(value)
        if value is None:
            later = F.lit(False) if ascending else c.isNotNull()
        else:
            later = (c > v) | c.isNull() if ascending else c < v
        out = F.coalesce(later, F.lit(False)) | (c.eqNullSafe(v) & out)
    return out
