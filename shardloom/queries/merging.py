"""Unions, joins, aggregates, top-N and pages over shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, predicates, sharding
from ..plans.builder import Change, Query
from . import Tables, query


def _shards(t: Tables, n: int = 4):
    """Orders split by customer into n shards; rows without a customer are in the first."""
    o = t.orders.withColumn("_s", F.coalesce(sharding.by_modulus(F.col("o_custkey"), n), F.lit(0)))
    return [o.where(F.col("_s") == k).drop("_s") for k in range(n)]


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS count, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1")
def agg_merge_count_sum(t):
    out = fusion.aggregate(fusion.union_all(_shards(t)), ["o_orderstatus"], count=("count", "*"), s=("sum", "o_totalprice"))
    return out.select("o_orderstatus", "count", F.round("s", 2).alias("sum_o_totalprice"))


@query("SELECT * FROM orders")
def union_all_shards(t):
    return fusion.union_all(_shards(t))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def union_distinct_shards(t):
    return fusion.union_distinct(_shards(t), ["o_custkey", "o_orderstatus"])


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def union_all_fields(t):
    return fusion.union_all([t.orders, t.orders.where("o_orderkey % 3 = 0")], ["o_orderkey", "o_totalprice"])


@query("""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def concat_distinct_key(t):
    return fusion.distinct_by(_shards(t), ["o_custkey"], "o_orderkey")


@query("SELECT 'east' AS _source, r_regionkey, r_name FROM region UNION ALL SELECT 'west', r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def execute_on_all_sources(t):
    return fusion.tag_sources({"east": t.region, "west": t.region.where("r_regionkey > 1")}).select("_source", "r_regionkey", "r_name")


_JOINED = "o_orderkey, o_totalprice, o_custkey, c_name, c_mktsegment"


def _join(t, how):
    left = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"))
    right = t.customer.where("c_custkey % 7 <> 0").select("c_custkey", "c_name", "c_mktsegment")
    return fusion.hash_join(left, right, "o_custkey", "c_custkey", how).select(*_JOINED.split(", "))


def _keyed(t, how, one_name):
    """The same sides; their keys have one name, or two."""
    left = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.col("o_custkey")).alias("key"))
    right = t.customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("key" if one_name else "customer"), "c_name")
    return fusion.hash_join(left, right, "key", "key" if one_name else "customer", how)


def _keyed_sql(how, columns):
    return f"""SELECT o_orderkey, {columns}, c_name FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders) o
    {how} JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON o_custkey = c_custkey"""


def _join_sql(how):
    return f"""SELECT {_JOINED} FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders) o
    {how} JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON o_custkey = c_custkey"""


@query(_join_sql("INNER"))
def hash_join_inner(t):
    return _join(t, "inner")


@query(_join_sql("LEFT"))
def hash_join_left(t):
    return _join(t, "left")


@query(_join_sql("RIGHT"))
def hash_join_right(t):
    return _join(t, "right")


@query(_join_sql("FULL"))
def hash_join_full(t):
    return _join(t, "full")


@query(_keyed_sql("LEFT", "o_custkey AS key"))
def hash_join_left_key(t):
    return _keyed(t, "left", True)


@query(_keyed_sql("RIGHT", "c_custkey AS key"))
def hash_join_right_key(t):
    return _keyed(t, "right", True)


@query(_keyed_sql("FULL", "coalesce(o_custkey, c_custkey) AS key"))
def hash_join_full_key(t):
    return _keyed(t, "full", True)


@query(_keyed_sql("FULL", "o_custkey AS key, c_custkey AS customer"))
def hash_join_full_keys(t):
    return _keyed(t, "full", False)


@query("""SELECT o_orderkey, k, s_suppkey FROM (SELECT o_orderkey, nullif(o_custkey % 50, 0) AS k FROM orders) o
    JOIN (SELECT s_suppkey, nullif(s_suppkey % 50, 0) AS k2 FROM supplier) s ON o.k IS NOT DISTINCT FROM s.k2""")
def hash_join_null_safe(t):
    left = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("k"))
    right = t.supplier.select("s_suppkey", F.nullif(F.col("s_suppkey") % 50, F.lit(0)).alias("k2"))
    return fusion.many_join(left, right, "k", "k2", null_safe=True).drop("k2")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_join_nation(t):
    build = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return fusion.lookup_join(t.customer, build, "c_nationkey").select("c_custkey", "c_name", "n_name")


@query("""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1) ON c_custkey = o_custkey""")
def broadcast_join_last_wins(t):
    build = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return fusion.lookup_join(t.customer, build, "c_custkey", latest="o_orderkey").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("""SELECT l_returnflag, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def sort_merge_join(t):
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_extendedprice")
    joined = fusion.merge_join(lines, t.orders.select("o_orderkey", "o_orderpriority"), "l_orderkey", "o_orderkey")
    return joined.groupBy("l_returnflag", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT a.o_custkey, a.o_orderkey AS even_order, b.o_orderkey AS odd_order FROM
    (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0) a JOIN
    (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1) b USING (o_custkey, n)""")
def sort_merge_pairing(t):
    even = t.orders.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("even_order"))
    odd = t.orders.where("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("odd_order"))
    return fusion.pairing_join(even, odd, "o_custkey", "even_order", "odd_order")


@query("SELECT p_partkey, p_size, s_suppkey FROM part JOIN supplier ON p_size = s_nationkey AND p_retailprice > s_acctbal")
def theta_join(t):
    p, s = t.part.select("p_partkey", "p_size", "p_retailprice"), t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    return fusion.many_join(p, s, "p_size", "s_nationkey", "p_retailprice > s_acctbal").select("p_partkey", "p_size", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_existing(t):
    return fusion.existing(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_missing(t):
    return fusion.missing(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS sum_quantity, round(avg(l_extendedprice), 4) AS avg_price,
    min(l_discount) AS min_discount, max(l_tax) AS max_tax, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1, 2""")
def agg_functions(t):
    out = fusion.aggregate(
        t.lineitem, ["l_returnflag", "l_linestatus"], n=("count", "*"), sum_quantity=("sum", "l_quantity"), avg_price=("avg", "l_extendedprice"),
        min_discount=("min", "l_discount"), max_tax=("max", "l_tax"), suppliers=("count_distinct", "l_suppkey"),
    )
    return out.withColumns({"sum_quantity": F.round("sum_quantity", 2), "avg_price": F.round("avg_price", 4)})


@query("""SELECT CAST(count(*) AS BIGINT) AS count, coalesce(sum(l_quantity), 0.0) AS sum_l_quantity, coalesce(avg(l_quantity), 0.0) AS avg_l_quantity,
    min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem WHERE l_quantity < 0""")
def agg_over_nothing(t):
    q = "l_quantity"
    return fusion.aggregate(t.lineitem.where("l_quantity < 0"), [], count=("count", "*"), sum_l_quantity=("sum", q), avg_l_quantity=("avg", q), min_l_quantity=("min", q), max_l_quantity=("max", q))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 5")
def builder_having(t):
    q = Query().where("o_orderstatus <> 'P'").group_by("o_custkey", n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2)).having("n > 5")
    return q.on(t.orders)


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def builder_join_page(t):
    q = Query().join(t.customer, "o_custkey = c_custkey").where(predicates.where("c_mktsegment", "=", "BUILDING"))
    return q.order_by("o_totalprice", False).order_by("o_orderkey").offset(10).limit(50).select("o_orderkey", "c_name", "o_totalprice").on(t.orders)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n_numeric(t):
    return fusion.top_n(fusion.union_all(_shards(t), ["o_orderkey", "o_totalprice"]), [("o_totalprice", False), ("o_orderkey", True)], 25)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 25")
def top_n_as_text(t):
    return fusion.top_n(fusion.union_all(_shards(t), ["o_orderkey", "o_orderstatus"]), [("o_orderkey", True)], 25, text=True)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 500")
def sorted_merge_nulls(t):
    shards = [s.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("k")) for s in _shards(t)]
    return fusion.sorted_merge(shards, [("k", False), ("o_orderkey", True)]).limit(500)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey")
def sorted_merge_all(t):
    shards = [s.select("o_orderkey", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("k")) for s in _shards(t)]
    return fusion.sorted_merge(shards, [("k", False), ("o_orderkey", True)])


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 200")
def paged_query(t):
    return fusion.page(t.events.select("event_id", "ts", "event_type"), [("ts", True), ("event_id", True)], 200, 100)


@query("SELECT CAST(count(*) AS BIGINT) AS total, count(*) > 300 AS has_more FROM events")
def page_has_more(t):
    return fusion.has_more(t.events, 200, 100)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 50000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderstatus = 'F' AND o_totalprice > 50000 THEN o_orderstatus || '*' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def builder_update(t):
    change = Change().where("o_orderstatus = 'F'").where(F.col("o_totalprice") > 50000)
    return change.update(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), o_totalprice="o_totalprice * 2", o_orderstatus="o_orderstatus || '*'")


@query("""SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(o_totalprice + c_acctbal, 2) ELSE o_totalprice END AS o_totalprice
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def builder_update_from(t):
    """Values of another table, by key."""
    side = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    change = Change().using(side, ["o_custkey"], {"c_mktsegment": "segment", "c_acctbal": "balance"}).where("segment = 'BUILDING'")
    return change.update(t.orders, o_totalprice="round(o_totalprice + balance, 2)").select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders WHERE NOT (o_totalprice < 100000 AND coalesce(nullif(o_orderstatus, 'P') = 'O', false))")
def builder_delete(t):
    """A condition that is null on some rows deletes none of these."""
    return Change().where("o_totalprice < 100000").where("nullif(o_orderstatus, 'P') = 'O'").delete(t.orders)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT c_custkey + 90000000, c_custkey, 'N', NULL FROM customer""")
def builder_insert(t):
    rows = t.customer.select((F.col("c_custkey") + 90_000_000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"))
    return Change().insert(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), rows, {"o_orderstatus": "N"})
