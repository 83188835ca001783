"""Routing rows to shards, pruning shards, rolling over and rebalancing."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv64, poly31, unsigned_mod
from .ordering import number_in_groups


def by_modulus(key: Column, n: int) -> Column:
    """The remainder's magnitude, so that negative keys have a shard too."""
    return F.abs(key % n).cast("long")


def by_bounded_modulus(key: Column, modulus: int) -> Column:
    """As `by_modulus`, with all negative keys in shard 0."""
    return F.when(key < 0, 0).otherwise(key % modulus).cast("long")


def by_range(value: Column, start: float, end: float, n: int, low_to_last: bool = False) -> Column:
    """One of n ranges of equal whole width; what is below the first goes to it (or to the last), what
    is above the last to that."""
    width = -((start - end) // n) if (end - start) > 0 else 1
    shard = F.least(F.floor((value.cast("double") - start) / width), F.lit(n - 1))
    return F.when(value < start, n - 1 if low_to_last else 0).otherwise(shard).cast("long")


def by_list(value: Column, values: Sequence) -> Column:
    """The value's place in the list; 0 for any other."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), value), F.lit(0)) - 1, F.lit(0)).cast("long")


def by_hour(ts: Column, n: int) -> Column:
    """The hour since the epoch, modulo n."""
    return F.pmod(F.floor(F.unix_timestamp(ts.cast("timestamp")) / 3600), F.lit(n)).cast("long")


def by_text_hash(key: Column, n: int) -> Column:
    """The stable 64-bit hash of the key's text, modulo n."""
    return unsigned_mod(fnv64(key.cast("string")), n)


def by_poly_hash(key: Column, n: int) -> Column:
    """The base-31 hash of the key's text, modulo n."""
    return unsigned_mod(poly31(key.cast("string")), n)


def shard_table(table: str, shard: Column) -> Column:
    """The physical table's name."""
    return F.concat_ws("_", F.lit(table), shard.cast("string"))


@dataclass(frozen=True)
class Node:
    """A shard's server; only active nodes get rows."""

    id: str
    table: str
    active: bool = True


@dataclass(frozen=True)
class Topology:
    """The nodes of a logical table and the way to them."""

    table: str
    key: str
    nodes: tuple[Node, ...]
    strategy: str = "hash"

    def active(self) -> list[Node]:
        nodes = [n for n in self.nodes if n.active]
        if not nodes:
            raise ValueError(f"topology {self.table} has no active node")
        return nodes

    def shard(self, key: Column) -> Column:
        """The place of a key's node among the active ones."""
        n = len(self.active())
        if self.strategy == "hash":
            return by_text_hash(key, n)
        if self.strategy == "consistent_hash":
            ids = [node.id for node in self.active()]
            return (F.array_position(F.array(*map(F.lit, ids)), ring_node(key, ids)) - 1).cast("long")
        value = F.coalesce(key.cast("string").try_cast("bigint"), F.lit(0))  # what is no number goes to the first
        return F.when(value < 0, 0).otherwise(value % n).cast("long")

    def node_id(self, key: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n.id) for n in self.active()]), (self.shard(key) + 1).cast("int"))

    def route(self, df: DataFrame) -> DataFrame:
        """The rows with their `_shard` and `_node`; a row without a key goes to the first."""
        return df.withColumn("_shard", self.shard(F.col(self.key))).withColumn("_node", self.node_id(F.col(self.key)))

    def prune(self, df: DataFrame, keys: Sequence) -> DataFrame:
        """The rows of `keys` out of a routed table: only their shards are read where it is
        partitioned by `_shard`."""
        spark = df.sparkSession
        wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("k"))
        shards = [r[0] for r in wanted.select(self.shard(F.col("k"))).distinct().collect()]
        return df.where(F.col("_shard").isin(shards) & F.col(self.key).isin(list(keys)))

    def without(self, *ids: str) -> Topology:
        """The same topology with these nodes inactive."""
        return replace(self, nodes=tuple(replace(n, active=n.active and n.id not in ids) for n in self.nodes))


def ring_node(key: Column, nodes: Sequence[str], virtual_nodes: int = 64, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Consistent hashing proper: each node has so many points on a ring of hashes, and a key goes to the
    first point at or after its own. Adding a node moves only the keys that it takes.

    The ring is sorted once, here; its points are constants of the expression. They fall into slots by the leading bits of their
    hash, about one in each, so a key looks at the points of its own slot alone, however many nodes there are. `hashed` gives the
    signed 64-bit hash of a text: Spark's own, or `hashing.fnv64` where other systems must agree.
    """
    points = [F.struct(hashed(F.lit(f"{n}#{v}")).alias("h"), F.lit(n).alias("n")) for n in nodes for v in range(virtual_nodes)]
    ring = [(p["h"], p["n"]) for p in SparkSession.active().range(1).select(F.sort_array(F.array(*points)).alias("ring")).first()["ring"]]
    bits = max(1, (len(ring) - 1).bit_length())
    slot_of = lambda h: (h + (1 << 63)) >> (64 - bits)
    slots = [slot_of(h) for h, _ in ring]
    first = [bisect_left(slots, s) for s in range((1 << bits) + 1)]
    h = hashed(key.cast("string"))
    # The leading bits of a signed number, from the least one up.
    slot = (F.shiftright(h, 64 - bits) + (1 << (bits - 1)) + 1).cast("int")
    starts, hashes, names = F.lit(first), F.lit([p[0] for p in ring]), F.lit([p[1] for p in ring])
    low, high = F.element_at(starts, slot), F.element_at(starts, slot + 1)
    place = low
    # As often as the fullest slot has points; no lambda, as these take no Arrow functions.
    for j in range(max(b - a for a, b in zip(first, first[1:]))):
        place = place + F.when((low + j < high) & (F.element_at(hashes, F.least(low + j + 1, F.lit(len(ring)))) < h), 1).otherwise(0)
    return F.coalesce(F.element_at(names, F.pmod(place, F.lit(len(ring))) + 1), F.lit(ring[0][1]))


def shard_sizes(df: DataFrame, shard: Column) -> DataFrame:
    """(shard, rows) of each shard."""
    return df.groupBy(shard.alias("shard")).agg(F.count("*").alias("rows"))


def skew(sizes: DataFrame) -> DataFrame:
    """(shards, rows, largest, skew): skew is the largest shard over the mean, less 1."""
    return sizes.agg(
        F.count("*").alias("shards"), F.sum("rows").alias("rows"), F.max("rows").alias("largest"),
        F.round(F.max("rows") / F.avg("rows") - 1, 6).alias("skew"),
    )


def shard_summary(registry: DataFrame) -> DataFrame:
    """(shards, rows, size_mb, active) over a shard registry with row_count, size_mb, is_active."""
    return registry.agg(
        F.count("*").alias("shards"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("size_mb"), F.count_if("is_active").alias("active"),
    )


def roll_over(df: DataFrame, group: str, order: Sequence[str], max_rows: int) -> DataFrame:
    """Number each group's rows into shards of `max_rows`, in the given order: shard 1 fills first. No task
    sees a whole group (see `number_in_groups`)."""
    numbered = number_in_groups(df, [group], order, "_n")
    return numbered.withColumn("_shard", (F.floor(F.col("_n") / max_rows) + 1).cast("long")).drop("_n")


def by_table_route(table: str, kind: str, key: Column, n: int) -> Column:
    """The physical table of a key's text by a table's rule: hash; range, a thousand values a step; list, by the
    text's length; time, by its first seven characters."""
    text = key.cast("string")
    if kind == "hash":
        return shard_table(table, by_poly_hash(key, n))
    if kind == "range":
        value = F.coalesce(text.try_cast("bigint"), F.lit(0))
        return shard_table(table, F.pmod(F.floor(F.greatest(value, F.lit(0)) / 1000), F.lit(n)).cast("long"))
    if kind == "list":
        return shard_table(table, F.pmod(F.octet_length(text), F.lit(n)))
    if kind == "time":
        return shard_table(table, F.substring(text, 1, 7))
    raise ValueError(f"unknown route {kind}")


def required_key(key: Column, name: str) -> Column:
    """The key, or an error where it is null."""
    return F.coalesce(key, F.raise_error(F.lit(f"a row has no {name}")).cast("string"))


def with_shards(df: DataFrame, topologies: Sequence[Topology]) -> DataFrame:
    """One column `_shard_<table>` for each topology: a row routed by several managers at once."""
    return df.withColumns({f"_shard_{t.table}": t.shard(F.col(t.key)) for t in topologies})


def write_sharded(df: DataFrame, path: str, topology: Topology, files: int = 16) -> None:
    """Write a table partitioned by its shard, so that a query of some keys reads their shards only (see
    `Topology.prune`). A shard is dealt to so many tasks by a hash of whole rows, each of which writes one file, so a key
    with very many rows is not one task."""
    routed = topology.route(df)
    routed.repartition("_shard", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.partitionBy("_shard").parquet(path)


@dataclass
class Topologies:
    """Topologies by their logical table."""

    by_table: dict[str, Topology] = field(default_factory=dict)

    def register(self, topology: Topology) -> None:
        self.by_table[topology.table] = topology

    def get(self, table: str) -> Topology:
        if table not in self.by_table:
            raise KeyError(f"no topology of {table}; there are {sorted(self.by_table)}")
        return self.by_table[table]


def write_report(operations: DataFrame, topology: Topology, operation: str) -> DataFrame:
    """(operation, shard, rows) of a batch of writes: what each shard is to do."""
    return operations.groupBy(F.col(operation).alias("operation"), topology.shard(F.col(topology.key)).alias("shard")).agg(F.count("*").alias("rows"))


def active_shard(registry: DataFrame) -> DataFrame:
    """The active shard of each table in a registry of (table_name, shard, is_active): the last one."""
    return registry.where("is_active").groupBy("table_name").agg(F.max("shard").alias("shard"))


def update_registry(registry: DataFrame, sizes: DataFrame) -> DataFrame:
    """The registry with row_count and size_mb of the shards in (table_name, shard, row_count, size_mb)."""
    new = sizes.select("table_name", "shard", F.col("row_count").alias("_rows"), F.col("size_mb").alias("_size"))
    out = registry.join(new, ["table_name", "shard"], "left")
    return out.select(*[F.coalesce({"row_count": "_rows", "size_mb": "_size"}[c], c).alias(c) if c in ("row_count", "size_mb") else F.col(c) for c in registry.columns])


def merge_extra(shard: Column, target: int) -> Column:
    """Where a shard (from 1) goes when only `target` stay: those beyond are merged into the first ones."""
    return F.when(shard <= target, shard).otherwise(F.pmod(shard - 1, F.lit(target)) + 1).cast("long")


@dataclass(frozen=True)
class Move:
    """So many rows from one shard to another."""

    source: str
    target: str
    rows: int


def rebalance(sizes: dict[str, int]) -> list[Move]:
    """The moves that make shard sizes equal to within one row, each row moved once at most.

    Takes sizes, one number per shard, and matches shards over the mean with those under it in order.
    """
    names = sorted(sizes)
    if not names:
        return []
    base, extra = divmod(sum(sizes.values()), len(names))
    goal = {n: base + (k < extra) for k, n in enumerate(sorted(names, key=lambda n: (-sizes[n], n)))}
    over = [[n, sizes[n] - goal[n]] for n in names if sizes[n] > goal[n]]
    under = [[n, goal[n] - sizes[n]] for n in names if sizes[n] < goal[n]]
    out = []
    while over and under:
        rows = min(over[0][1], under[0][1])
        out.append(Move(over[0][0], under[0][0], rows))
        for side in (over, under):
            side[0][1] -= rows
            if not side[0][1]:
                side.pop(0)
    return out


def migration_report(moves: Sequence[Move]) -> str:
    """A plan of moves as text."""
    lines = [f"Migration of {sum(m.rows for m in moves)} rows"]
    return "\n".join(lines + [f"  {m.source} -> {m.target}: {m.rows}" for m in moves])


@dataclass
class TextRoute:
    """Statements with a text in them go to a node."""

    pattern: str
    node: str
    priority: int = 0


def route_statements(sql: Column, routes: Sequence[TextRoute], fallback: str) -> Column:
    """The node of each statement: of the first route, by falling priority, whose text it has, whatever the case."""
    out = F.lit(fallback)
    for r in sorted(routes, key=lambda r: -r.priority)[::-1]:
        out = F.when(F.contains(F.lower(sql), F.lit(r.pattern.lower())), r.node).otherwise(out)
    return out


@dataclass
class PrefixRoute:
    """Tables whose name starts with the pattern's part before * or % belong to a database."""

    pattern: str
    database: str
    priority: int = 0


@dataclass
class DatabaseRouter:
    """Routes tables to databases by prefix, greatest priority first."""

    default: str
    routes: list[PrefixRoute] = field(default_factory=list)

    def route(self, table: Column) -> Column:
        out = F.lit(self.default)
        for r in sorted(self.routes, key=lambda r: r.priority):
            prefix = r.pattern.rstrip("*%")
            hit = table.startswith(prefix) if prefix != r.pattern else table == r.pattern
            out = F.when(hit, r.database).otherwise(out)
        return out
