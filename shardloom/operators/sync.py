"""Bringing a target table up to its source: the new rows as a DataFrame, written elsewhere by the caller.

A path that is read is never overwritten; `publish` writes the new version beside it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts in which a key's rows are sorted.
_PARTS = 16


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _greatest(df: DataFrame, columns: Sequence[str], latest: str | None) -> Column:
    """The struct of those columns of the row that counts in a group: with the greatest `latest`, then of the others. Columns that have
    no order, such as maps, are compared as text."""
    order = [*([latest] if latest else []), *[c for c in columns if c != latest]]
    kinds = {f.name: f.dataType for f in df.schema}
    value = F.struct(*[F.col(f"`{c}`").alias(c) for c in order])
    if all(_sortable(kinds[c]) for c in order):
        return F.max(value)
    return F.max_by(value, F.struct(*[F.col(f"`{c}`") if _sortable(kinds[c]) else F.col(f"`{c}`").cast("string") for c in order]))


def one_per_key(df: DataFrame, key: Sequence[str], latest: str | None = None, tasks: int | None = None) -> DataFrame:
    """One row per key: that with the greatest `latest`, or without it the greatest of all. Null keys are one key.

    Rows are sorted by key to be grouped, where they are read and again where they are sent. With `tasks` they are dealt out to so many before
    either sort, so that a task's memory does not depend on files: first by key and a hash of the row, so that a key of very many rows is sorted
    in parts, and what is left by key.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = lambda rows, by: rows.groupBy(*by).agg(_greatest(df, rest, latest).alias("_row")).select(*by, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    if tasks is not None:
        first = [*key, "_part_of_key"]
        part = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if not _sortable(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]), F.lit(_PARTS))
        df = best(df.withColumn("_part_of_key", part).repartition(tasks, *first), first).drop("_part_of_key").repartition(tasks, *key)
    return best(df, list(key)).select(*[F.col(f"`{c}`") for c in df.columns])


def paired(source: DataFrame, target: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """(key..., _s, _t): for each key of either table the row of each that counts (see `one_per_key`), as structs in the order of
    their columns; null where a table has none. Null keys are one key.

    Both tables are put together and grouped once, so rows are sent once, after each task has kept one row a key: there is no join,
    and a key of very many rows is no large group.
    """
    names = [f"_key_{i}" for i in range(len(key))]
    sides, best, shown = [], [], []
    for df, name in ((source, "_s"), (target, "_t")):
        kinds = {f.name: f.dataType for f in df.schema}
        first = [latest] if latest else []
        order = [*first, *[c for c in df.columns if c not in first and c not in key], *key]
        sides.append(df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names)], F.struct(*[F.col(f"`{c}`") for c in order]).alias(name)))
        if all(_sortable(kinds[c]) for c in order):
            one = F.max(name)
        else:
            by = [F.col(f"{name}.`{c}`") if _sortable(kinds[c]) else F.col(f"{name}.`{c}`").cast("string") for c in order]
            one = F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*by)))
        best.append(one.alias(name))
        shown.append(F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.`{c}`").alias(c) for c in df.columns])).alias(name))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    return both.groupBy(*names).agg(*best).select(*[F.col(n).alias(k) for n, k in zip(names, key)], *shown)


def keyed_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Rows of `left` by the keys of `right`, left_semi or left_anti; a null key is a key like any other."""
    keys = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(key)])
    same = [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(key)]
    return left.join(keys, reduce(lambda a, b: a & b, same), how)


def full(source: DataFrame) -> DataFrame:
    """The target becomes the source."""
    return source


def insert_new(source: DataFrame, target: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """The target with the source's rows that it lacks, one a key."""
    return target.unionByName(one_per_key(keyed_join(source, target, key, "left_anti"), key, latest))


def update_existing(source: DataFrame, target: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """The target with its rows that the source has replaced by the source's, one a key."""
    new = one_per_key(keyed_join(source, target, key, "left_semi"), key, latest)
    return new.unionByName(keyed_join(target, source, key, "left_anti"))


def upsert(source: DataFrame, target: DataFrame, key: Sequence[str], conflict: str = "update", latest: str | None = None) -> DataFrame:
    """Source and target together. On a key that both have: update or replace takes the source's row, skip
    keeps the target's, merge takes the source's value of each column unless it is null, error fails.

    Of source rows that share a key one counts (see `one_per_key`); null keys are keys like any other."""
    key = list(key)
    if conflict in ("update", "replace", "source"):
        return one_per_key(source, key, latest).unionByName(keyed_join(target, source, key, "left_anti"))
    if conflict in ("skip", "target"):
        return insert_new(source, target, key, latest)
    if conflict == "merge":
        both = paired(source, target, key, latest)
        return both.select(*[F.coalesce(f"_s.{c}", f"_t.{c}").alias(c) if c in source.columns else F.col(f"_t.{c}").alias(c) for c in target.columns])
    if conflict == "error":
        # The check stands on the target's rows, as a join that finds nothing when all is well.
        keys = source.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(key)], F.lit(True).alias("_clash")).distinct()
        found = target.join(keys, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(key)]), "left")
        fine = F.when(F.col("_clash").isNull(), True).otherwise(F.raise_error(F.lit("a key is in both tables")).cast("boolean"))
        return one_per_key(source, key, latest).unionByName(found.where(fine).select(*target.columns))
    raise ValueError(f"unknown conflict strategy {conflict}")


def deleted(source: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target rows whose key is gone from the source."""
    return keyed_join(target, source, key, "left_anti")


def changed_since(source: DataFrame, track: str, mark) -> DataFrame:
    """The source rows whose tracking column is past the mark; all where there is no mark."""
    return source if mark is None else source.where(F.col(track) > F.lit(mark))


def incremental(source: DataFrame, target: DataFrame, key: Sequence[str], track: str, mark=None, delete: bool = False, conflict: str = "update") -> DataFrame:
    """Apply the rows changed since the mark, and drop deleted ones if asked."""
    out = upsert(changed_since(source, track, mark), target, key, conflict)
    return keyed_join(out, source, key, "left_semi") if delete else out


def high_water_mark(source: DataFrame, track: str):
    """The greatest value of the tracking column: the next run's mark."""
    return source.agg(F.max(track)).first()[0]


def save_mark(spark: SparkSession, path: str, mark) -> None:
    """Keep a mark of any type for the next run: what `high_water_mark` gives. It is written as a new version beside the last one, which goes
    only then, so a run that dies leaves one of the two."""
    if isinstance(mark, dt.datetime):
        kind = "timestamp" if mark.tzinfo else "timestamp_ntz"
    else:
        kind = "date" if isinstance(mark, dt.date) else "string" if mark is None else None
    df = spark.createDataFrame([(mark,)], f"mark {kind}" if kind else None).toDF("mark")
    held = _marks(spark, path)
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/mark-{max(held, default=0) + 1:010d}")
    for n in held:
        fs, at = _hadoop(spark, f"{path}/mark-{n:010d}")
        fs.delete(at, True)


def load_mark(spark: SparkSession, path: str):
    """The mark kept at a path; None where there is none."""
    held = _marks(spark, path)
    return spark.read.parquet(f"{path}/mark-{max(held):010d}").first()[0] if held else None


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _marks(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that were written whole."""
    fs, at = _hadoop(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[5:]) for n in names if n.startswith("mark-") and fs.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[1]))


def change_log(source: DataFrame, target: DataFrame, key: Sequence[str], latest: str | None = None) -> DataFrame:
    """(operation, key..., before, after): what turns the target into the source, insert, update or delete, with the rows
    before and after as JSON. One row a key; rows that are alike in all columns of both are not listed."""
    both = [c for c in source.columns if c in target.columns]
    joined = paired(source, target, key, latest)
    kinds = {f.name: f.dataType for f in source.schema}
    value = lambda side, c: F.col(f"{side}.{c}") if _sortable(kinds[c]) else F.col(f"{side}.{c}").cast("string")
    same = reduce(lambda a, b: a & b, [value("_s", c).eqNullSafe(value("_t", c)) for c in both])
    operation = F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "delete").when(~same, "update")
    shown = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    out = joined.select(operation.alias("operation"), *[F.coalesce(f"_s.{k}", f"_t.{k}").alias(k) for k in key], shown("_t").alias("before"), shown("_s").alias("after"))
    return out.where("operation is not null")


def synchronise(source: DataFrame, target: DataFrame | None, key: Sequence[str], mode: str = "smart", conflict: str = "update") -> DataFrame:
    """The new target by mode: full, incremental (insert only), update (existing only) or smart (upsert).
    Without a target every mode is a full copy."""
    if target is None or mode == "full":
        return full(source)
    if mode == "incremental":
        return insert_new(source, target, key)
    if mode == "update":
        return update_existing(source, target, key)
    if mode == "smart":
        return upsert(source, target, key, conflict)
    raise ValueError(f"unknown mode {mode}")


def project(source: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns under their target names."""
    return source.select(*[F.col(s).alias(t) for s, t in mapping.items()])


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a new version as Parquet; the writer commits it whole or not at all."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path
