"""Snapshots of tables as Parquet with a manifest, and their verification."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("full", "incremental", "differential", "schema", "data")


def row_hash(schema: T.StructType) -> Column:
    """A 64-bit hash of a row's values and nulls. A hash passes over nulls, so each column goes in with a mark of whether it is null; maps and
    variants go in as text."""
    marked = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        marked += [c.isNull(), c.cast("string") if isinstance(f.dataType, (T.MapType, T.VariantType)) else c]
    return F.xxhash64(*marked)


def digest(df: DataFrame) -> DataFrame:
    """(rows, checksum): a checksum of the multiset of rows, whatever their order."""
    h = row_hash(df.schema).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def backup(tables: dict[str, DataFrame], path: str, mode: str = "full", track: str | None = None, since=None) -> DataFrame:
    """Write each table below `path` and return the manifest, which is written beside them.

    incremental and differential take the rows with `track` past `since`: the last backup's mark, or the
    last full one's. schema writes no rows, data no schemas.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is not one of {MODES}")
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        if mode in ("incremental", "differential") and since is not None:
            df = df.where(F.col(track) > F.lit(since))
        n, check = 0, "0"
        if mode != "schema":
            df.write.parquet(f"{path}/{name}")
            n, check = digest(spark.read.parquet(f"{path}/{name}")).first()
        rows.append((name, mode, n, check, "" if mode == "data" else df.schema.json()))
    manifest = spark.createDataFrame(rows, "table_name string, mode string, rows long, checksum string, schema string")
    manifest.coalesce(1).write.json(f"{path}/_manifest")
    return manifest


def restore(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table out of a snapshot."""
    return spark.read.parquet(f"{path}/{table}")


def verify(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether each table has the rows that its manifest names."""
    manifest = spark.read.schema("table_name string, mode string, rows long, checksum string, schema string").json(f"{path}/_manifest")
    out = {}
    for m in manifest.where("mode <> 'schema'").collect():
        n, check = digest(spark.read.parquet(f"{path}/{m['table_name']}")).first()
        out[m["table_name"]] = (n, check) == (m["rows"], m["checksum"])
    return out


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def list_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """(snapshot, table_name, mode, rows) of each snapshot below a folder, by its manifest."""
    fs, at = _folder(spark, base)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = [n for n in sorted(names) if fs.exists(_folder(spark, f"{base}/{n}/_manifest/_SUCCESS")[1])]
    schema = "table_name string, mode string, rows long, checksum string, schema string"
    empty = spark.createDataFrame([], f"snapshot string, {schema}")
    each = [spark.read.schema(schema).json(f"{base}/{n}/_manifest").select(F.lit(n).alias("snapshot"), "*") for n in whole]
    return reduce(DataFrame.unionByName, each, empty).select("snapshot", "table_name", "mode", "rows")


def delete_snapshot(spark: SparkSession, base: str, name: str) -> bool:
    """Delete a snapshot; whether there was one. A name is one folder, not a path."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"not a snapshot's name: {name!r}")
    fs, at = _folder(spark, f"{base}/{name}")
    return bool(fs.exists(at) and fs.delete(at, True))


def run_transfer(spark: SparkSession, select: str, table: str) -> int:
    """Append the rows of a query to a table, by position, and count them on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.sql(select).observe(seen, F.count("*").alias("rows")).write.insertInto(table)
    return seen.get["rows"]


def transfer(source: DataFrame, mapping: dict[str, str], path: str) -> dict[str, int]:
    """Copy the mapped columns of the rows that have them all; returns rows read, written and skipped,
    counted on the way by the write itself."""
    from pyspark.sql import Observation

    seen = Observation()
    whole = F.lit(True)
    for s in mapping:
        whole = whole & F.col(s).isNotNull()
    watched = source.observe(seen, F.count("*").alias("read"), F.count_if(whole).alias("written"))
    watched.where(whole).select(*[F.col(s).alias(t) for s, t in mapping.items()]).write.parquet(path)
    got = seen.get
    return {"read": got["read"], "written": got["written"], "skipped": got["read"] - got["written"]}


def load_mapping(text: str) -> dict[str, str]:
    """A column mapping from JSON."""
    return {str(k): str(v) for k, v in json.loads(text).items()}


def save_mapping(mapping: dict[str, str]) -> str:
    return json.dumps(mapping, indent=2, ensure_ascii=False)
