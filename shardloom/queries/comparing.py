"""Diff, sync and incremental loads: orders against a changed copy."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import compare, sync
from ..plans import schema_map
from ..shared import shared_folder
from ..sources import registry, snapshots
from . import query

_RULES = compare.Rules(key=("o_orderkey",))
_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
#: The copy: every tenth order is gone, every seventh price is 1 more, every eleventh status is padded, five orders are new.
_TARGET = f"""(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus || ' ' ELSE o_orderstatus END AS o_orderstatus,
   CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
   FROM orders WHERE o_orderkey % 10 <> 0
   UNION ALL SELECT o_orderkey + 10000000, {_COLUMNS.split(', ', 1)[1]} FROM orders WHERE o_orderkey < 5)"""


def _target(t):
    o = t.orders
    changed = o.where("o_orderkey % 10 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 11 == 0, F.concat("o_orderstatus", F.lit(" "))).otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    })
    new = o.where("o_orderkey < 5").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return changed.unionByName(new)


@query(f"""SELECT s.o_orderkey, 'o_totalprice' AS field, round(s.o_totalprice, 2) AS source_value, round(t.o_totalprice, 2) AS target_value
    FROM orders s JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey WHERE abs(s.o_totalprice - t.o_totalprice) >= 0.0001""")
def data_diff_fields(t):
    out = compare.field_differences(t.orders, _target(t), _RULES)
    return out.withColumns({c: F.round(F.col(c).cast("double"), 2) for c in ("source_value", "target_value")})


@query(f"""SELECT CAST(count(s.o_orderkey) AS BIGINT) AS source_rows, CAST(count(t.o_orderkey) AS BIGINT) AS target_rows,
    CAST(count(CASE WHEN s.o_orderkey = t.o_orderkey THEN 1 END) AS BIGINT) AS matched_rows,
    CAST(count(CASE WHEN abs(s.o_totalprice - t.o_totalprice) >= 0.0001 THEN 1 END) AS BIGINT) AS diff_fields,
    CAST(count(CASE WHEN t.o_orderkey IS NULL THEN 1 END) AS BIGINT) AS missing_in_target, CAST(count(CASE WHEN s.o_orderkey IS NULL THEN 1 END) AS BIGINT) AS missing_in_source,
    round(count(CASE WHEN s.o_orderkey = t.o_orderkey THEN 1 END) * 100.0 / greatest(count(s.o_orderkey), count(t.o_orderkey)), 6) AS match_percentage
    FROM orders s FULL JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey""")
def data_diff_stats(t):
    return compare.statistics(t.orders, _target(t), _RULES)


@query("SELECT * FROM orders WHERE o_orderkey % 10 = 0")
def missing_in_target(t):
    return compare.missing_rows(t.orders, _target(t), _RULES)


@query(f"SELECT t.* FROM {_TARGET} t WHERE t.o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def missing_in_source(t):
    return compare.missing_rows(_target(t), t.orders, _RULES)


@query("""SELECT * FROM (VALUES ('o_custkey', 'missing_in_target', 'bigint', NULL), ('customer', 'missing_in_source', NULL, 'bigint'),
    ('o_totalprice', 'different', 'double', 'decimal(12,2)')) AS v(field, issue, source, target)""")
def schema_diff(t):
    target = t.orders.withColumnRenamed("o_custkey", "customer").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    return t.spark.createDataFrame(compare.schema_differences(t.orders.schema, target.schema), "field string, issue string, source string, target string")


@query("""SELECT 'UPDATE region SET r_name = ''' || upper(r_name) || 'X'' WHERE r_regionkey = ' || r_regionkey || ';' AS statement FROM region WHERE r_regionkey = 1
    UNION ALL SELECT 'INSERT INTO region (r_regionkey, r_name) VALUES (' || r_regionkey || ', ''' || upper(r_name) || 'X'');' FROM region WHERE r_regionkey > 2
    UNION ALL SELECT 'DELETE FROM region WHERE r_regionkey = ' || r_regionkey || ';' FROM region WHERE r_regionkey = 0""")
def sync_statements(t):
    shouted = F.concat(F.upper("r_name"), F.lit("X"))
    source = t.region.where("r_regionkey > 0").withColumn("r_name", F.when(F.col("r_regionkey") == 2, F.col("r_name")).otherwise(shouted))
    return compare.sync_statements(source, t.region.where("r_regionkey <= 2"), "region", compare.Rules(key=("r_regionkey",)))


@query("SELECT * FROM orders")
def sync_full(t):
    return sync.synchronise(t.orders, None, ["o_orderkey"])


@query(f"SELECT * FROM {_TARGET} t UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0")
def sync_incremental(t):
    return sync.synchronise(t.orders, _target(t), ["o_orderkey"], "incremental")


@query(f"SELECT * FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT t.* FROM {_TARGET} t WHERE o_orderkey >= 10000000")
def sync_update(t):
    return sync.synchronise(t.orders, _target(t), ["o_orderkey"], "update")


@query(f"SELECT * FROM orders UNION ALL SELECT t.* FROM {_TARGET} t WHERE o_orderkey >= 10000000")
def sync_smart_update(t):
    return sync.synchronise(t.orders, _target(t), ["o_orderkey"], "smart", "update")


@query(f"SELECT * FROM {_TARGET} t UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0")
def sync_smart_skip(t):
    return sync.synchronise(t.orders, _target(t), ["o_orderkey"], "smart", "skip")


@query(f"""SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey,
    coalesce(nullif(s.o_orderpriority, '1-URGENT'), t.o_orderpriority) AS o_orderpriority
    FROM orders s FULL JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey""")
def conflict_merge(t):
    columns = ["o_orderkey", "o_custkey", "o_orderpriority"]
    source = t.orders.select(*columns).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return sync.upsert(source, _target(t).select(*columns), ["o_orderkey"], "merge")


@query(f"""SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30' UNION ALL
    SELECT t.* FROM {_TARGET} t WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = t.o_orderkey AND o.o_orderdate > TIMESTAMP '1996-06-30')""")
def incremental_mark(t):
    return sync.incremental(t.orders, _target(t), ["o_orderkey"], "o_orderdate", dt.datetime(1996, 6, 30))


@query(f"""SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30' UNION ALL
    SELECT t.* FROM {_TARGET} t JOIN orders o ON o.o_orderkey = t.o_orderkey WHERE o.o_orderdate <= TIMESTAMP '1996-06-30'""")
def incremental_with_deletes(t):
    return sync.incremental(t.orders, _target(t), ["o_orderkey"], "o_orderdate", dt.datetime(1996, 6, 30), delete=True)


@query(f"SELECT t.o_orderkey FROM {_TARGET} t WHERE o_orderkey >= 10000000")
def delete_detect(t):
    return sync.deleted(t.orders, _target(t), ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey AS id, o_custkey AS customer_id, o_totalprice AS amount, o_orderstatus AS order_status FROM orders")
def mapped_projection(t):
    return sync.project(t.orders, {"o_orderkey": "id", "o_custkey": "customer_id", "o_totalprice": "amount", "o_orderstatus": "order_status"})


@query("""SELECT 'nation' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part""")
def table_row_counts(t):
    return registry.row_counts({"nation": t.nation, "supplier": t.supplier, "part": t.part})


@query("""SELECT * FROM (VALUES ('nation', 1, 'n_nationkey', 'int', true), ('nation', 2, 'n_name', 'string', true), ('nation', 3, 'n_regionkey', 'int', true),
    ('region', 1, 'r_regionkey', 'int', true), ('region', 2, 'r_name', 'string', true)) AS v(table_name, position, column_name, data_type, nullable)""")
def catalog_columns(t):
    return registry.columns_of({"nation": t.nation, "region": t.region})


@query("SELECT CAST(count(*) AS BIGINT) AS rows FROM orders")
def snapshot_rows(t):
    return snapshots.digest(t.orders).select("rows")


@query("SELECT 'mysql' AS source_db, 'postgresql' AS target_db, CAST(37 AS BIGINT) AS rules, CAST(7 AS BIGINT) AS lossy")
def type_rules(t):
    rules = schema_map.rules_frame(t.spark).where("source_db = 'mysql' and target_db = 'postgresql'")
    return rules.groupBy("source_db", "target_db").agg(F.count("*").alias("rules"), F.count_if("lossy").alias("lossy"))


@query("""SELECT source_db, target_db, CAST(rules AS BIGINT) AS rules, CAST(lossy AS BIGINT) AS lossy FROM (VALUES ('mysql', 'postgresql', 37, 7), ('mysql', 'sqlite', 24, 5),
    ('postgresql', 'mysql', 24, 6), ('postgresql', 'sqlite', 16, 7), ('sqlite', 'mysql', 5, 1), ('sqlite', 'postgresql', 5, 1), ('oracle', 'mysql', 16, 0), ('oracle', 'postgresql', 16, 0),
    ('oracle', 'sqlite', 16, 0), ('mysql', 'mysql', 33, 0), ('mariadb', 'mariadb', 33, 0), ('tidb', 'tidb', 33, 0), ('postgresql', 'postgresql', 33, 0), ('sqlite', 'sqlite', 33, 0),
    ('oracle', 'oracle', 33, 0), ('mssql', 'mssql', 33, 0)) AS v(source_db, target_db, rules, lossy)""")
def type_rule_paths(t):
    return schema_map.rules_frame(t.spark).groupBy("source_db", "target_db").agg(F.count("*").alias("rules"), F.count_if("lossy").alias("lossy"))


@query("""SELECT p_partkey, declared, CASE p_partkey % 6 WHEN 0 THEN 'NUMERIC' || substr(declared, 8) WHEN 1 THEN declared WHEN 2 THEN 'TIMESTAMP' WHEN 3 THEN 'SMALLINT' WHEN 4 THEN 'JSONB' ELSE 'BOOLEAN' END AS target_type,
    p_partkey % 6 IN (2, 5) AS lossy FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'DECIMAL(' || (p_size + 2) || ',2)' WHEN 1 THEN 'VARCHAR(' || p_size || ')' WHEN 2 THEN 'DATETIME'
      WHEN 3 THEN 'TINYINT' WHEN 4 THEN 'JSON' ELSE 'BIT(1)' END AS declared FROM part)""")
def declared_types(t):
    """Columns declared in one dialect, by the rules in another: each distinct declaration is looked up once and joined."""
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    declared = (
        F.when(k == 0, F.concat(F.lit("DECIMAL("), (F.col("p_size") + 2).cast("string"), F.lit(",2)"))).when(k == 1, F.concat(F.lit("VARCHAR("), size, F.lit(")")))
        .when(k == 2, "DATETIME").when(k == 3, "TINYINT").when(k == 4, "JSON").otherwise("BIT(1)")
    )
    return schema_map.convert_declared(t.part.select("p_partkey", declared.alias("declared")), "declared", "mysql", "postgresql")


_EXACT = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 1000 END AS k, o_orderkey AS v, 9007199254740992 + o_orderkey % 3 + {big} AS big,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'NaN' WHEN o_orderkey % 7 = 0 THEN 'inf' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) + {x} AS x, CAST(o_totalprice AS DECIMAL(18,6)) + {d} AS d FROM orders"""
_EXACT_SQL = ", ".join(f"{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS n FROM ({_EXACT.format(**p)})) WHERE n = 1)" for n, p in (
    ("s", {"big": "0", "x": "0", "d": "0"}),
    ("t", {"big": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END", "x": "CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 13 = 0 THEN 0.00001 ELSE 0 END", "d": "CASE WHEN o_orderkey % 3 = 0 THEN 0.000099 WHEN o_orderkey % 3 = 1 THEN 0.0001 ELSE 0 END"}),
))


def _exact(t, changed: bool):
    o = F.col("o_orderkey")
    x = F.when(o % 5 == 0, F.lit(float("nan"))).when(o % 7 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    big, d = F.lit(9007199254740992) + o % 3, F.col("o_totalprice").cast("decimal(18,6)")
    if changed:
        big = big + F.when(o % 2 == 0, 1).otherwise(0)
        x = x + F.when(o % 11 == 0, 1.0).when(o % 13 == 0, 0.00001).otherwise(0.0)
        d = d + F.when(o % 3 == 0, F.lit("0.000099")).when(o % 3 == 1, F.lit("0.000100")).otherwise(F.lit("0")).cast("decimal(18,6)")
    return t.orders.select(F.when(o % 97 != 0, o % 1000).alias("k"), o.alias("v"), big.alias("big"), x.alias("x"), d.alias("d"))


@query(f"""WITH {_EXACT_SQL} SELECT s.k, f.field FROM s JOIN t ON s.k IS NOT DISTINCT FROM t.k, (VALUES ('big'), ('x'), ('d')) AS f(field)
    WHERE CASE f.field WHEN 'big' THEN s.big <> t.big WHEN 'd' THEN abs(s.d - t.d) >= 0.0001 ELSE s.x IS DISTINCT FROM t.x AND NOT coalesce(abs(s.x - t.x) < 0.0001, false) END""")
def data_diff_exact(t):
    """Whole numbers beyond 2^53, NaN, infinities, decimals, repeated and null keys."""
    rules = compare.Rules(key=("k",), latest="v", ignore=("v",))
    return compare.field_differences(_exact(t, False), _exact(t, True), rules).select("k", "field")


_REPEATED = "SELECT CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey % {n} END AS k, o_orderkey AS v, o_orderstatus AS s FROM orders"


@query(f"""WITH a AS ({_REPEATED.format(n=700)} WHERE o_orderkey % 2 = 0), b AS ({_REPEATED.format(n=1100)} WHERE o_orderkey % 2 = 1)
    SELECT k, v, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS n FROM a) WHERE n = 1
    UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k IS NOT DISTINCT FROM b.k)""")
def sync_repeated_keys(t):
    """An upsert from a source with repeated and null keys: one row a key comes of it."""
    o = F.col("o_orderkey")

    def rows(n, part):
        return t.orders.where(o % 2 == part).select(F.when(o % 41 != 0, o % n).alias("k"), o.alias("v"), F.col("o_orderstatus").alias("s"))

    return sync.upsert(rows(700, 0), rows(1100, 1), ["k"], "update", latest="v")


@query(f"""SELECT 'UPDATE orders SET o_custkey = ' || s.o_custkey || ' WHERE o_orderkey = ' || s.o_orderkey || ';' AS statement FROM orders s JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderkey % 7 = 0
    UNION ALL SELECT 'INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus) VALUES (' || o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''');' FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT 'DELETE FROM orders WHERE o_orderkey = ' || o_orderkey || ';' FROM {_TARGET} t WHERE o_orderkey >= 10000000""")
def sync_statements_orders(t):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    target = _target(t).select(*columns).withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return compare.sync_statements(t.orders.select(*columns), target, "orders", _RULES)


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, true AS as_written, true AS in_any_order, true AS nulls_count, true AS one_change_shows FROM orders""")
def snapshot_checksum(t):
    """The checksum of a snapshot read back against its source's, of the rows in another order, with two columns' nulls
    exchanged, and after one value has changed."""
    spark, o = t.spark, t.orders
    path = shared_folder(spark)
    snapshots.backup({"orders": o}, path)
    a, b = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderstatus"))
    forms = {
        "source": o, "written": snapshots.restore(spark, path, "orders"), "ordered": o.orderBy(F.desc("o_totalprice")),
        "left": o.select("o_orderkey", a.alias("a"), b.alias("b")), "right": o.select("o_orderkey", b.alias("a"), a.alias("b")),
        "changed": o.withColumn("o_custkey", F.when(F.col("o_orderkey") == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))),
    }
    found = reduce(DataFrame.union, [snapshots.digest(df).select(F.lit(n).alias("form"), "rows", "checksum") for n, df in forms.items()])
    of = lambda n: F.max(F.when(F.col("form") == n, F.struct("rows", "checksum")))
    return found.agg(
        of("source")["rows"].alias("rows"), (of("source") == of("written")).alias("as_written"), (of("source") == of("ordered")).alias("in_any_order"),
        (of("left") != of("right")).alias("nulls_count"), (of("source") != of("changed")).alias("one_change_shows"),
    )


@query(f"""SELECT CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS operation, coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
    t.o_orderkey IS NOT NULL AS has_before, s.o_orderkey IS NOT NULL AS has_after FROM orders s FULL JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey
    WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_totalprice <> t.o_totalprice OR s.o_orderstatus <> t.o_orderstatus""")
def change_log(t):
    out = sync.change_log(t.orders, _target(t), ["o_orderkey"])
    return out.select("operation", "o_orderkey", F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"))


@query(r"""SELECT CAST(true AS VARCHAR) AS is_open, chr(39) || replace(o_orderpriority, chr(39), chr(39) || chr(39)) || chr(39) AS priority,
    'E' || chr(39) || '\\x' || lower(hex(encode(o_orderstatus))) || chr(39) AS raw, CAST(o_orderkey AS VARCHAR) AS doc FROM orders""")
def converted_columns(t):
    links = [("o_orderstatus", "TINYINT(1)", "is_open", "BOOLEAN"), ("o_orderpriority", "VARCHAR(15)", "priority", "VARCHAR(15)"), ("o_orderstatus", "BLOB", "raw", "BYTEA"), ("o_orderkey", "JSON", "doc", "JSONB")]
    return values.converted_columns(t.orders, links, "postgresql")
