"""Carrying out a rebalance: rows move between shards, and only the shards of the plan are written."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from .ordering import number_in_groups
from .sharding import Move, rebalance


@dataclass(frozen=True)
class ShardStore:
    """A table in named shards. Below `path`, `data/<folder>/shard=<name>` holds files that never change, and `layouts/<number>.json` says which
    folders each shard consists of and how many rows it has. A layout counts once its file is written; the last one is read."""

    spark: SparkSession
    path: str

    def layout(self, number: int | None = None) -> tuple[int, dict, T.StructType]:
        """Number, {shard: [rows, folders]} and columns of a layout, the last one without a number."""
        known = [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/layouts") if n.endswith(".json")]
        if not known:
            raise FileNotFoundError(f"no layout of {self.path}")
        number = known[-1] if number is None else number
        d = json.loads(files.read(self.spark, f"{self.path}/layouts/{number:010d}.json"))
        return number, d["shards"], T.StructType.fromJson(d["schema"])

    def create(self, df: DataFrame, shard: str) -> None:
        """Write the first layout; `shard` is the column with a row's shard, which no row may lack."""
        schema = T.StructType([f for f in df.schema if f.name != shard])
        named = df.select(*schema.names, F.coalesce(F.col(shard).cast("string"), F.raise_error(F.lit("a row has no shard")).cast("string")).alias("shard"))
        folder, rows = self._write(named, schema)
        self._commit(0, {s: [n, [folder]] for s, n in rows.items()}, schema)

    def read(self, number: int | None = None, shards: Sequence[str] | None = None) -> DataFrame:
        """The rows with their shard; with `shards` only those of them."""
        _, held, schema = self.layout(number)
        full = T.StructType([*schema.fields, T.StructField("shard", T.StringType())])
        made = None
        folders = sorted({f for s, (_, of) in held.items() for f in of if shards is None or s in shards})
        for f in folders:
            paths = [f"{self.path}/data/{f}/shard={s}" for s, (_, of) in sorted(held.items()) if f in of and (shards is None or s in shards)]
            part = self.spark.read.schema(full).option("basePath", f"{self.path}/data/{f}").parquet(*paths)
            made = part if made is None else made.unionByName(part)
        return self.spark.createDataFrame([], full) if made is None else made

    def rebalance(self, order: Sequence[str]) -> list[Move]:
        """Make all shards' sizes equal to within one row; the moves that did it.

        Of a shard that gives rows away the last ones in the given order go, in slices by rank, to the shards that take some. What is
        left of it and what others take is written anew; a taking shard's old files stay, and shards that are in no move are neither read nor
        written. Ranks are made without a task that sees a whole shard.
        """
        number, held, schema = self.layout()
        moves = rebalance({s: n for s, (n, _) in held.items()})
        if not moves:
            return moves
        slices, kept = [], {}
        for s in sorted({m.source for m in moves}):
            at = kept[s] = held[s][0] - sum(m.rows for m in moves if m.source == s)
            for m in (m for m in moves if m.source == s):
                slices.append((s, at, at + m.rows, m.target))
                at += m.rows
        ranked = number_in_groups(self.read(number, list(kept)), ["shard"], list(order), "_rank")
        goes = self.spark.createDataFrame(slices, "shard string, _from long, _to long, _target string")
        moved = ranked.join(F.broadcast(goes), (ranked["shard"] == goes["shard"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")), "left")
        folder, rows = self._write(moved.select(*schema.names, F.coalesce(goes["_target"], ranked["shard"]).alias("shard")), schema)
        shards = dict(held)
        for s in {*kept, *(m.target for m in moves)}:
            before = [0, []] if s in kept else held[s]
            shards[s] = [before[0] + rows.get(s, 0), [*before[1], *([folder] if s in rows else [])]]
        self._commit(number, shards, schema)
        return moves

    def _write(self, df: DataFrame, schema: T.StructType) -> tuple[str, dict[str, int]]:
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        df.write.partitionBy("shard").parquet(at)
        if not any(n.startswith("shard=") for n in files.names(self.spark, at)):
            return folder, {}
        held = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("shard", T.StringType())])).parquet(at)
        return folder, {r["shard"]: r["count"] for r in held.groupBy("shard").count().collect()}

    def _commit(self, base: int, shards: dict, schema: T.StructType) -> None:
        files.create(self.spark, f"{self.path}/layouts/{base + 1:010d}.json", json.dumps({"shards": shards, "schema": schema.jsonValue()}))
