"""Sharding: hash, range, list and time routes, pruning, roll-over, rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import fnv64
from ..operators import sharding
from ..shared import shared_folder
from . import query

# The text hashes as folds in SQL: bytes from the hex form, arithmetic modulo 2^64 in 128 bits.
_BYTES = "list_transform(range(0, strlen({s})), lambda i: CAST(CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS UTINYINT) AS UHUGEINT))"


def fnv_sql(s: str) -> str:
    b = _BYTES.format(s=s)
    step = "lambda h, b: (((h // 256) * 256 + xor(h % 256, b)) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)"
    return f"list_reduce({b}, {step}, CAST(1469598103934665603 AS UHUGEINT))"


def poly_sql(s: str) -> str:
    b = _BYTES.format(s=s)
    return f"list_reduce({b}, lambda h, b: (h * 31 + b) % CAST(18446744073709551616 AS UHUGEINT), CAST(0 AS UHUGEINT))"


@query("SELECT o_orderkey, CAST(abs(o_custkey % 4) AS BIGINT) AS shard FROM orders")
def shard_modulus(t):
    return t.orders.select("o_orderkey", sharding.by_modulus(F.col("o_custkey"), 4).alias("shard"))


@query("SELECT c_custkey, CAST(CASE WHEN k < 0 THEN 0 ELSE k % 7 END AS BIGINT) AS shard FROM (SELECT c_custkey, c_custkey - 100 AS k FROM customer)")
def shard_bounded_modulus(t):
    return t.customer.select("c_custkey", sharding.by_bounded_modulus(F.col("c_custkey") - 100, 7).alias("shard"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size < 5 THEN 0 ELSE least(floor((p_size - 5) / 12), 3) END AS BIGINT) AS shard FROM part")
def shard_range(t):
    return t.part.select("p_partkey", sharding.by_range(F.col("p_size"), 5, 50, 4).alias("shard"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size < 5 THEN 3 ELSE least(floor((p_size - 5) / 12), 3) END AS BIGINT) AS shard FROM part")
def shard_range_low_to_last(t):
    return t.part.select("p_partkey", sharding.by_range(F.col("p_size"), 5, 50, 4, low_to_last=True).alias("shard"))


@query("SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS BIGINT) AS shard FROM customer")
def shard_list(t):
    return t.customer.select("c_custkey", sharding.by_list(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "MACHINERY"]).alias("shard"))


@query("SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24 AS shard FROM events")
def shard_hour(t):
    return t.events.select("event_id", sharding.by_hour(F.col("ts"), 24).alias("shard"))


@query(f"SELECT c_custkey, CAST({fnv_sql('c_name')} % 4 AS BIGINT) AS shard FROM customer")
def shard_text_hash(t):
    return t.customer.select("c_custkey", sharding.by_text_hash(F.col("c_name"), 4).alias("shard"))


@query(f"SELECT 'customer_' || CAST({poly_sql('c_name')} % 4 AS VARCHAR) AS shard_table, CAST(count(*) AS BIGINT) AS rows FROM customer GROUP BY 1")
def shard_poly_table(t):
    table = sharding.shard_table("customer", sharding.by_poly_hash(F.col("c_name"), 4))
    return t.customer.groupBy(table.alias("shard_table")).agg(F.count("*").alias("rows"))


@query("SELECT event_id, 'events_' || strftime(ts, '%Y-%m') AS shard_table FROM events")
def shard_time_table(t):
    return t.events.select("event_id", sharding.shard_table("events", F.substring(F.col("ts").cast("string"), 1, 7)).alias("shard_table"))


def _topology(strategy="hash"):
    nodes = tuple(sharding.Node(f"s{k}", f"orders_{k}") for k in range(4))
    return sharding.Topology("orders", "o_custkey", nodes, strategy)


@query(f"SELECT o_orderkey, CAST({fnv_sql('CAST(o_custkey AS VARCHAR)')} % 3 AS BIGINT) AS _shard, ['s0', 's1', 's3'][CAST({fnv_sql('CAST(o_custkey AS VARCHAR)')} % 3 AS INT) + 1] AS _node FROM orders")
def route_active_nodes(t):
    return _topology().without("s2").route(t.orders.select("o_orderkey", "o_custkey")).drop("o_custkey")


@query("SELECT o_orderkey, CAST(o_custkey % 4 AS BIGINT) AS _shard, 's' || (o_custkey % 4) AS _node FROM orders")
def route_numeric(t):
    return _topology("range").route(t.orders.select("o_orderkey", "o_custkey")).drop("o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 7, 42, 100)")
def route_pruned(t):
    topology = _topology()
    return topology.prune(topology.route(t.orders.select("o_orderkey", "o_custkey")), [1, 7, 42, 100]).select("o_orderkey", "o_custkey")


@query()
def route_ring(t):
    return t.customer.select("c_custkey", sharding.ring_node(F.col("c_custkey"), ["a", "b", "c"], 16).alias("node"))


@query("SELECT CAST(l_suppkey % 8 AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1")
def shard_sizes(t):
    return sharding.shard_sizes(t.lineitem, sharding.by_modulus(F.col("l_suppkey"), 8))


@query("""SELECT CAST(count(*) AS BIGINT) AS shards, CAST(sum(n) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS largest, round(max(n) / avg(n) - 1, 6) AS skew
    FROM (SELECT l_suppkey % 8, count(*) AS n FROM lineitem GROUP BY 1)""")
def shard_skew(t):
    return sharding.skew(shard_sizes(t))


@query("""SELECT CAST(count(*) AS BIGINT) AS shards, CAST(sum(n) AS BIGINT) AS rows, round(sum(n * 0.001), 6) AS size_mb, CAST(sum(CASE WHEN n >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS active
    FROM (SELECT l_suppkey % 8, count(*) AS n FROM lineitem GROUP BY 1)""")
def shard_summary(t):
    registry = shard_sizes(t).select(F.col("rows").alias("row_count"), (F.col("rows") * F.lit(0.001)).cast("double").alias("size_mb"), (F.col("rows") >= 1).alias("is_active"))
    return sharding.shard_summary(registry).withColumn("size_mb", F.round("size_mb", 6))


@query("""SELECT o_orderkey, o_orderstatus, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 64 ORDER BY o_orderkey) - 1) / 10) + 1 AS BIGINT) AS _shard FROM orders""")
def rollover_by_rows(t):
    spread = t.orders.select("o_orderkey", "o_orderstatus", F.concat_ws("_", "o_orderstatus", F.col("o_custkey") % 64).alias("g"))
    return sharding.roll_over(spread, "g", ["o_orderkey"], 10).drop("g")


@query("""SELECT shard, CAST(CASE WHEN shard <= 3 THEN shard ELSE (shard - 1) % 3 + 1 END AS BIGINT) AS target, CAST(count(*) AS BIGINT) AS rows
    FROM (SELECT l_suppkey % 8 + 1 AS shard FROM lineitem) GROUP BY 1, 2""")
def merge_extra_shards(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 8 + 1).alias("shard"))
    return rows.groupBy("shard", sharding.merge_extra(F.col("shard"), 3).alias("target")).agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT 's' || CAST(l_suppkey % 8 AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY 1),
  g AS (SELECT name, n, sum(n) OVER () // 8 + CASE WHEN row_number() OVER (ORDER BY n DESC, name) <= sum(n) OVER () % 8 THEN 1 ELSE 0 END AS goal FROM s),
  o AS (SELECT name, n - goal AS x, sum(n - goal) OVER (ORDER BY name) AS hi FROM g WHERE n > goal),
  u AS (SELECT name, goal - n AS x, sum(goal - n) OVER (ORDER BY name) AS hi FROM g WHERE n < goal)
  SELECT o.name AS source, u.name AS target, CAST(least(o.hi, u.hi) - greatest(o.hi - o.x, u.hi - u.x) AS BIGINT) AS rows
  FROM o JOIN u ON o.hi - o.x < u.hi AND u.hi - u.x < o.hi""")
def rebalance_moves(t):
    sizes = {f"s{r['shard']}": r["rows"] for r in shard_sizes(t).collect()}
    return t.spark.createDataFrame([(m.source, m.target, m.rows) for m in sharding.rebalance(sizes)], "source string, target string, rows long")


@query("SELECT n_nationkey, CASE WHEN n_name = 'NATION_1' THEN 'one' WHEN n_name LIKE 'NATION_1%' THEN 'ones' ELSE 'rest' END AS database FROM nation")
def route_databases(t):
    router = sharding.DatabaseRouter("rest", [sharding.PrefixRoute("NATION_1*", "ones", 1), sharding.PrefixRoute("NATION_1", "one", 2)])
    return t.nation.select("n_nationkey", router.route(F.col("n_name")).alias("database"))


@query("SELECT o_orderkey, o_orderstatus, CAST(floor((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) / 1000) + 1 AS BIGINT) AS _shard FROM orders")
def rollover_by_status(t):
    return sharding.roll_over(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 1000)


@query(f"""SELECT c_custkey, 'c_' || CAST({poly_sql('c_name')} % 5 AS VARCHAR) AS by_hash, 'c_' || CAST((c_custkey // 1000) % 3 AS VARCHAR) AS by_range, 'c_' || CAST(strlen(c_mktsegment) % 4 AS VARCHAR) AS by_list,
    'c_' || substr(c_name, 1, 7) AS by_time FROM customer""")
def table_routes(t):
    kinds = {"hash": "c_name", "range": "c_custkey", "list": "c_mktsegment", "time": "c_name"}
    n = {"hash": 5, "range": 3, "list": 4, "time": 1}
    return t.customer.select("c_custkey", *[sharding.by_table_route("c", k, F.col(c), n[k]).alias(f"by_{k}") for k, c in kinds.items()])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (3, 11, 42)")
def sharded_write_read(t):
    """Orders written by shard and read back by key: the plan has the shards of these keys as partition filters."""
    path, topology = shared_folder(t.spark), _topology()
    sharding.write_sharded(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), path, topology)
    return topology.prune(t.spark.read.parquet(path), [3, 11, 42]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"SELECT o_orderkey, CAST({fnv_sql('CAST(o_custkey AS VARCHAR)')} % 4 AS BIGINT) AS _shard_orders, CAST(o_orderkey % 3 AS BIGINT) AS _shard_archive FROM orders")
def several_topologies(t):
    archive = sharding.Topology("archive", "o_orderkey", tuple(sharding.Node(f"a{k}", f"archive_{k}") for k in range(3)), "range")
    return sharding.with_shards(t.orders.select("o_orderkey", "o_custkey"), [_topology(), archive]).drop("o_custkey")


@query(f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'update' ELSE 'insert' END AS operation, CAST({fnv_sql('CAST(o_custkey AS VARCHAR)')} % 4 AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1, 2""")
def write_batch_report(t):
    changes = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "update").otherwise("insert").alias("op"))
    return sharding.write_report(changes, _topology(), "op")


@query("""SELECT event_id, CASE WHEN contains(s, 'join') THEN 'olap' WHEN contains(s, 'insert') THEN 'primary' WHEN contains(s, 'clicks') THEN 'clicks' ELSE 'replica' END AS node
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'select * from a join b' WHEN 'purchase' THEN 'insert into clicks select 1' WHEN 'click' THEN 'select 1 from clicks' ELSE 'select 1' END AS s FROM events)""")
def route_statements(t):
    sql = F.when(F.col("event_type") == "view", "SELECT * FROM a JOIN b").when(F.col("event_type") == "purchase", "INSERT INTO clicks SELECT 1").when(F.col("event_type") == "click", "select 1 from CLICKS").otherwise("SELECT 1")
    routes = [sharding.TextRoute("clicks", "clicks", 1), sharding.TextRoute("insert", "primary", 5), sharding.TextRoute("JOIN", "olap", 9)]
    return t.events.select("event_id", sharding.route_statements(sql, routes, "replica").alias("node"))


@query("SELECT 't' || (l_suppkey % 3) AS table_name, CAST(max(l_suppkey % 8) AS BIGINT) AS shard FROM lineitem WHERE l_suppkey % 8 <= 6 GROUP BY 1")
def active_shards(t):
    rows = t.lineitem.select(F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("table_name"), (F.col("l_suppkey") % 8).alias("shard"))
    registry = rows.distinct().withColumn("is_active", F.col("shard") <= 6)
    return sharding.active_shard(registry)


def _signed(h: str) -> str:
    return f"(CAST({h} AS HUGEINT) - CASE WHEN {h} >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)"


_POINT = "n || '#' || CAST(v AS VARCHAR)"


@query(f"""WITH p AS (SELECT n, {_signed(fnv_sql(_POINT))} AS h FROM (VALUES ('a'), ('b'), ('c')) AS x(n), range(8) AS r(v)),
    k AS (SELECT c_custkey, {_signed(fnv_sql('CAST(c_custkey AS VARCHAR)'))} AS h FROM customer)
    SELECT c_custkey, coalesce(min_by(p.n, p.h), (SELECT min_by(n, h) FROM p)) AS node FROM k LEFT JOIN p ON p.h >= k.h GROUP BY c_custkey""")
def route_ring_text(t):
    return t.customer.select("c_custkey", sharding.ring_node(F.col("c_custkey"), ["a", "b", "c"], 8, fnv64).alias("node"))
