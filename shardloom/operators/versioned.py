"""Tables in versions: rows lie in buckets by a hash of their key, a change rewrites only the buckets it touches, and two tables are
compared by the digests of their buckets.

Below a table's path, `data/<folder>/bucket=<n>` holds files that are never changed, and `versions/<number>.json` says of one version in
which folder each bucket lies, how many rows it has and their digest. A version is there once its file is, and readers of an
older one go on undisturbed. The driver handles one line a bucket; the number of buckets is a parameter.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files
from ..shared import materialize
from ..sources.snapshots import row_hash
from .compare import Rules, field_differences, missing_rows
from .sync import keyed_join, one_per_key, upsert

_END = "end"
#: Rows that one task sorts at a time to find the newest of each key.
ROWS = 250_000


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


@dataclass(frozen=True)
class Bucket:
    """Where a bucket lies, its number of rows, and the sum of the hashes of its rows."""

    folder: str
    rows: int
    digest: int


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int
    held: dict[int, Bucket]
    batch: int | None = None


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        """The numbers of all versions, ascending."""
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version:
        """What a version consists of; without a number the last one that is written to its end."""
        for n in reversed(self.versions()) if number is None else [number] if number in self.versions() else []:
            text = files.read(self.spark, f"{self.path}/versions/{n:010d}.json").rstrip()
            if text.endswith(_END):
                d = json.loads(text.removesuffix(_END))
                held = {int(b): Bucket(*x) for b, x in d["held"].items()}
                return Version(n, T.StructType.fromJson(d["schema"]), tuple(d["key"]), d["buckets"], held, d["batch"])
        raise FileNotFoundError(f"no whole version {'' if number is None else number} of {self.path}")

    def repair(self) -> list[int]:
        """Remove versions that a writer began and did not finish; their numbers. Call it when no writer is at work."""
        broken = [n for n in self.versions() if not files.read(self.spark, f"{self.path}/versions/{n:010d}.json").rstrip().endswith(_END)]
        for n in broken:
            files.delete(self.spark, f"{self.path}/versions/{n:010d}.json")
        return broken

    def read(self, number: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a version; with `buckets` only those of them, of which alone the files are listed and read."""
        v = self.version(number)
        wanted = {b: x.folder for b, x in sorted(v.held.items()) if buckets is None or b in set(buckets)}
        if not wanted:
            return self.spark.createDataFrame([], v.schema)
        folders = set(wanted.values())
        at = f"{self.path}/data/{min(folders)}"
        if len(folders) == 1 and len(wanted) == sum(n.startswith("bucket=") for n in files.names(self.spark, at)):
            # A whole folder is listed at once.
            whole = T.StructType([*v.schema.fields, T.StructField("bucket", T.IntegerType())])
            return self.spark.read.schema(whole).parquet(at).select(*[F.col(f"`{c}`") for c in v.schema.names])
        return self.spark.read.schema(v.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in wanted.items()])

    def lookup(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The rows with one of the keys; only the keys' buckets are read."""
        v = self.version(number)
        return keyed_join(self.read(v.number, touched_buckets(keys, v)), keys, v.key, "left_semi")

    def create(self, df: DataFrame, key: Sequence[str], buckets: int = 64) -> int:
        """Write the first version; all rows as they are."""
        return self._commit(0, df.schema, tuple(key), buckets, {}, self._write(df, tuple(key), buckets), None)

    def upsert(self, changes: DataFrame, conflict: str = "update", latest: str | None = None, deletes: DataFrame | None = None, batch: int | None = None) -> int:
        """Write the next version: with the changes by key (see `sync.upsert`) and without the keys of `deletes`. Returns its number.

        With conflict "newest" the row of each key with the greatest `latest` counts, be it a change or the table's. Only buckets with a changed or deleted key are read and written. A `batch` number that the last version has, or
        that is before it, was applied already and is passed over. Raises Conflict if another version came in between.
        """
        v = self.version()
        if batch is not None and v.batch is not None and batch <= v.batch:
            return v.number
        names = v.schema.names
        changes = materialize(changes.select(*names))
        touched = set(touched_buckets(changes, v))
        gone = None
        if deletes is not None:
            gone = materialize(deletes.select(*v.key))
            touched |= set(touched_buckets(gone, v))
        held = self.read(v.number, sorted(touched))
        if conflict == "newest":
            tasks = max(1, math.ceil((changes.count() + sum(v.held[b].rows for b in touched if b in v.held)) / ROWS))
            new = one_per_key(changes.unionByName(held), v.key, latest, tasks)
        else:
            new = upsert(changes, held, v.key, conflict, latest)
        if gone is not None:
            new = keyed_join(new, gone, v.key, "left_anti")
        made = self._write(new.select(*names), v.key, v.buckets) if touched else {}
        kept = {b: x for b, x in v.held.items() if b not in touched}
        return self._commit(v.number, v.schema, v.key, v.buckets, kept, made, v.batch if batch is None else batch)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all versions but the last `keep`, and the folders that none of these holds. No writer or reader of them may be at work."""
        known = self.versions()
        last = [self.version(n) for n in known[-max(keep, 1):]]
        used = {x.folder for v in last for x in v.held.values()}
        for n in known[: -max(keep, 1)]:
            files.delete(self.spark, f"{self.path}/versions/{n:010d}.json")
        for name in files.names(self.spark, f"{self.path}/data"):
            if name not in used:
                files.delete(self.spark, f"{self.path}/data/{name}")

    def _write(self, df: DataFrame, key: tuple[str, ...], buckets: int) -> dict[int, Bucket]:
        """Write rows to a folder of their own, bucket by bucket. Spark splits a bucket with very many rows into several files."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
        if not any(n.startswith("bucket=") for n in files.names(self.spark, at)):
            return {}
        written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(at)
        sums = written.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(row_hash(df.schema).cast("decimal(38,0)")).alias("digest"))
        return {r["bucket"]: Bucket(folder, r["rows"], int(r["digest"])) for r in sums.collect()}

    def _commit(self, base: int, schema: T.StructType, key: tuple[str, ...], buckets: int, kept: dict[int, Bucket], made: dict[int, Bucket], batch: int | None) -> int:
        held = {str(b): [x.folder, x.rows, x.digest] for b, x in sorted((kept | made).items())}
        text = json.dumps({"schema": schema.jsonValue(), "key": list(key), "buckets": buckets, "held": held, "batch": batch})
        try:
            files.create(self.spark, f"{self.path}/versions/{base + 1:010d}.json", f"{text}\n{_END}\n")
        except Exception as e:
            if base + 1 in self.versions():
                raise Conflict(f"version {base + 1} of {self.path} is another writer's") from e
            raise
        return base + 1


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    """The bucket of a row by its key; null keys have one too."""
    return F.pmod(F.xxhash64(*[x for k in key for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))]), F.lit(buckets)).cast("int")


def touched_buckets(keys: DataFrame, v: Version) -> list[int]:
    """The buckets that hold the keys, at most v.buckets of them. Keys are read as the table's types, so that they hash alike."""
    typed = keys.select(*[F.col(f"`{k}`").cast(v.schema[k].dataType).alias(k) for k in v.key])
    return sorted(r[0] for r in typed.select(bucket_of(v.key, v.buckets)).distinct().collect())


# --- comparison by digests ---


def differing_buckets(source: Version, target: Version, fan: int = 8) -> tuple[list[int], int]:
    """The buckets in which two versions differ, and how many pairs of digests were compared to find them.

    The digests of `fan` neighbouring buckets add up to one of the level above, and so on to the root; from there only nodes that
    differ are followed. Versions with different numbers of buckets are compared by the smaller one, if it divides the
    other. Buckets are those of the smaller number.
    """
    n = min(source.buckets, target.buckets)
    if source.key != target.key or source.buckets % n or target.buckets % n:
        raise ValueError("the tables have different keys, or numbers of buckets of which none divides the other")
    levels = []
    for v in (source, target):
        leaves = [(0, 0)] * n
        for b, x in v.held.items():
            rows, digest = leaves[b % n]
            leaves[b % n] = (rows + x.rows, digest + x.digest)
        tree = [leaves]
        while len(tree[-1]) > 1:
            last = tree[-1]
            tree.append([tuple(map(sum, zip(*last[k : k + fan]))) for k in range(0, len(last), fan)])
        levels.append(tree)
    a, b = levels
    open_, compared = [0], 0
    for level in range(len(a) - 1, -1, -1):
        compared += len(open_)
        differ = [k for k in open_ if a[level][k] != b[level][k]]
        if not level:
            return differ, compared
        open_ = [c for k in differ for c in range(k * fan, min((k + 1) * fan, len(a[level - 1])))]
    return [], compared


def _of(version: Version, buckets: Sequence[int], n: int) -> list[int]:
    wanted = set(buckets)
    return [b for b in version.held if b % n in wanted]


def _differing_rows(source: VersionedTable, target: VersionedTable) -> tuple[DataFrame, DataFrame, Version]:
    s, t = source.version(), target.version()
    found = differing_buckets(s, t)[0]
    n = min(s.buckets, t.buckets)
    return source.read(s.number, _of(s, found, n)), target.read(t.number, _of(t, found, n)), s


def tree_differences(source: VersionedTable, target: VersionedTable, rules: Rules) -> DataFrame:
    """What `compare.field_differences` gives for the last versions of two tables, whose key is that of the rules. Buckets of equal digests
    have equal rows: of these nothing is read but the digests."""
    a, b, s = _differing_rows(source, target)
    if s.key != tuple(rules.key):
        raise ValueError(f"the tables' key is {s.key}, the rules' {tuple(rules.key)}")
    return field_differences(a, b, rules)


def tree_missing(source: VersionedTable, target: VersionedTable, rules: Rules) -> DataFrame:
    """The source rows whose key the target lacks, found in differing buckets alone."""
    a, b, _ = _differing_rows(source, target)
    return missing_rows(a, b, rules)
