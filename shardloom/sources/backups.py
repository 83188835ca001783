"""Chains of backups: a full one, then the changes since the last backup or since the full one, deletions included."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from .snapshots import digest, row_hash

FULL, INCREMENTAL, DIFFERENTIAL = "full", "incremental", "differential"


@dataclass(frozen=True)
class Backup:
    """One backup: its name, mode, what it stands on (the last backup, or the full one), and of each table key, columns, rows and checksum
    of the table as it was."""

    name: str
    mode: str
    base: str | None
    tables: dict


@dataclass(frozen=True)
class BackupChain:
    """Backups below a folder. `<name>/rows/<table>` has the rows that are new or changed, `<name>/gone/<table>` the keys that are deleted, and
    `<name>/state/<table>` a key and a hash of each row as it was, so that the next backup is found without the values of this one.
    `<name>/backup.json` is written last: a backup that died is none."""

    spark: SparkSession
    path: str

    def backups(self) -> list[Backup]:
        """All whole backups in the order of their names."""
        return [self.backup(n) for n in files.names(self.spark, self.path) if "backup.json" in files.names(self.spark, f"{self.path}/{n}")]

    def backup(self, name: str) -> Backup:
        d = json.loads(files.read(self.spark, f"{self.path}/{name}/backup.json"))
        return Backup(name, d["mode"], d["base"], d["tables"])

    def full(self, name: str, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> Backup:
        """Write all rows; `keys` names the columns that tell a table's rows apart."""
        return self._write(name, FULL, None, tables, keys)

    def incremental(self, name: str, tables: Mapping[str, DataFrame], base: str) -> Backup:
        """Write what has changed since the backup `base`, of any mode."""
        return self._write(name, INCREMENTAL, self.backup(base), tables, None)

    def differential(self, name: str, tables: Mapping[str, DataFrame], base: str) -> Backup:
        """Write what has changed since the full backup that `base` goes back to."""
        return self._write(name, DIFFERENTIAL, self.chain(base)[0], tables, None)

    def chain(self, name: str) -> list[Backup]:
        """The backups that a restore of `name` needs, the full one first."""
        out = [self.backup(name)]
        while out[0].base is not None:
            out.insert(0, self.backup(out[0].base))
        return out

    def restore(self, name: str, table: str) -> DataFrame:
        """The table as it was at that backup: of each key the row of the last backup in the chain that has it, unless a later one
        lists it as gone. One shuffle of the chain's rows; a key's rows are as many as the chain is long at most."""
        chain = self.chain(name)
        held = chain[-1].tables[table]
        schema, key = T.StructType.fromJson(held["schema"]), held["key"]
        parts = []
        for n, b in enumerate(chain):
            row = F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("_row")
            at = F.lit(n).alias("_at")
            keys = [F.col(f"`{k}`") for k in key]
            parts.append(self.spark.read.schema(schema).parquet(f"{self.path}/{b.name}/rows/{table}").select(*keys, at, row))
            if b.mode != FULL:
                gone = T.StructType([schema[k] for k in key])
                parts.append(self.spark.read.schema(gone).parquet(f"{self.path}/{b.name}/gone/{table}").select(*keys, at, F.lit(None).cast(T.StructType(schema.fields)).alias("_row")))
        if len(parts) == 1:
            return parts[0].select("_row.*")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        last = every.groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.max_by("_row", "_at").alias("_row"))
        return last.where(F.col("_row").isNotNull()).select("_row.*")

    def verify(self, name: str) -> dict[str, bool]:
        """Whether each table of a backup is restored with the rows that it had."""
        return {t: tuple(digest(self.restore(name, t)).first()) == (d["rows"], d["checksum"]) for t, d in self.backup(name).tables.items()}

    def _write(self, name: str, mode: str, base: Backup | None, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None) -> Backup:
        if not name or "/" in name or name in files.names(self.spark, self.path):
            raise ValueError(f"not a new backup's name: {name!r}")
        done = {}
        for table, df in tables.items():
            key = list(keys[table] if base is None else base.tables[table]["key"])
            at = f"{self.path}/{name}"
            if base is None:
                df.write.parquet(f"{at}/rows/{table}")
                df = self.spark.read.schema(df.schema).parquet(f"{at}/rows/{table}")
                _state(df, key).write.parquet(f"{at}/state/{table}")
            else:
                if df.schema != T.StructType.fromJson(base.tables[table]["schema"]):
                    raise ValueError(f"the columns of {table} are not those of its last backup; write a full one")
                _state(df, key).write.parquet(f"{at}/state/{table}")
                new, old = (self.spark.read.parquet(f"{self.path}/{b}/state/{table}") for b in (name, base.name))
                # Both states, put together and grouped by key once: whose hash is new, and which keys are gone.
                both = new.withColumn("_new", F.lit(True)).unionAll(old.withColumn("_new", F.lit(False)))
                names = [f"_k{n}" for n in range(len(key))]
                side = both.groupBy(*names).agg(F.max(F.when(F.col("_new"), F.col("_hash"))).alias("_is"), F.max(F.when(~F.col("_new"), F.col("_hash"))).alias("_was"))
                changed = side.where(F.col("_is").isNotNull() & ~F.col("_is").eqNullSafe(F.col("_was")))
                gone = side.where(F.col("_is").isNull())
                same = F.lit(True)
                for k, n in zip(key, names):
                    same = same & F.col(f"`{k}`").eqNullSafe(F.col(n))
                df.join(changed.select(*names), same, "left_semi").write.parquet(f"{at}/rows/{table}")
                gone.select(*[F.col(n).alias(k) for n, k in zip(names, key)]).write.parquet(f"{at}/gone/{table}")
            n, check = digest(df).first()
            done[table] = {"key": key, "schema": df.schema.jsonValue(), "rows": n, "checksum": check}
        files.create(self.spark, f"{self.path}/{name}/backup.json", json.dumps({"mode": mode, "base": base and base.name, "tables": done}))
        return self.backup(name)


def _state(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(_k0, ..., _hash): each row's key and a hash of its values and nulls."""
    return df.select(*[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(key)], row_hash(df.schema).alias("_hash"))
