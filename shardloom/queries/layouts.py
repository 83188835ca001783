"""Tables that keep versions, pages, sketches or shards, intervals, change feeds and a source of database files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, intervals, moving, paging, sharding, sketches, versioned
from ..shared import shared_folder
from ..sources import backups, registry, sqlite_shards
from ..streaming import changes, streams
from . import query
from .comparing import _COLUMNS, _EXACT_SQL, _TARGET, _exact, _target


def _versioned(t, df, key, buckets=64):
    table = versioned.VersionedTable(t.spark, shared_folder(t.spark))
    table.create(df, key, buckets)
    return table


@query(f"""SELECT {_COLUMNS} FROM (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 100 <> 13 UNION ALL SELECT o_orderkey + 20000000, {_COLUMNS.split(', ', 1)[1]} FROM orders WHERE o_orderkey < 9)""")
def versioned_upsert(t):
    """One row in a hundred changed, one deleted and a few new ones, in the buckets of these keys."""
    o = F.col("o_orderkey")
    table = _versioned(t, t.orders, ["o_orderkey"])
    changed = t.orders.where(o % 100 == 7).withColumn("o_totalprice", F.col("o_totalprice") + 5)
    new = t.orders.where(o < 9).withColumn("o_orderkey", o + 20_000_000)
    table.upsert(changed.unionByName(new), deletes=t.orders.where(o % 100 == 13))
    return table.read()


@query("""SELECT CAST(1 AS INTEGER) AS version, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    UNION ALL SELECT 2, count(*), round(sum(CASE WHEN o_orderkey = 5 THEN 0 ELSE o_totalprice END), 2) FROM orders UNION ALL SELECT 3, count(*), round(sum(CASE WHEN o_orderkey = 5 THEN 0 ELSE o_totalprice END), 2) FROM orders WHERE o_orderkey > 3""")
def versioned_history(t):
    """Each version is still read after the later ones."""
    table = _versioned(t, t.orders, ["o_orderkey"])
    table.upsert(t.orders.where("o_orderkey = 5").withColumn("o_totalprice", F.lit(0.0)))
    table.upsert(t.orders.limit(0), deletes=t.orders.where("o_orderkey <= 3"))
    each = [table.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")) for v in table.versions()]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query(f"""WITH {_EXACT_SQL} SELECT s.k, f.field FROM s JOIN t ON s.k IS NOT DISTINCT FROM t.k, (VALUES ('big'), ('x'), ('d')) AS f(field)
    WHERE CASE f.field WHEN 'big' THEN s.big <> t.big WHEN 'd' THEN abs(s.d - t.d) >= 0.0001 ELSE s.x IS DISTINCT FROM t.x AND NOT coalesce(abs(s.x - t.x) < 0.0001, false) END""")
def data_diff_tree(t):
    """The rows of data_diff_exact, by the digests of buckets."""
    a, b = (_versioned(t, _exact(t, x), ["k"], n) for x, n in ((False, 64), (True, 128)))
    return versioned.tree_differences(a, b, compare.Rules(key=("k",), latest="v", ignore=("v",))).select("k", "field")


@query(f"""SELECT o_orderkey, 'missing' AS what FROM orders WHERE o_orderkey % 10 = 0 UNION ALL
    SELECT s.o_orderkey, 'o_totalprice' FROM orders s JOIN {_TARGET} t ON s.o_orderkey = t.o_orderkey WHERE abs(s.o_totalprice - t.o_totalprice) >= 0.0001""")
def tree_missing_and_changed(t):
    rules = compare.Rules(key=("o_orderkey",))
    a, b = (_versioned(t, df, ["o_orderkey"], 256) for df in (t.orders, _target(t)))
    gone = versioned.tree_missing(a, b, rules).select("o_orderkey", F.lit("missing").alias("what"))
    return gone.unionAll(versioned.tree_differences(a, b, rules).select("o_orderkey", F.col("field").alias("what")))


@query("""SELECT k AS page, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders),
    (VALUES (0), (1), (2)) AS p(k) WHERE (k = 0 AND n < 40) OR (k = 1 AND n >= c // 2 AND n < c // 2 + 40) OR (k = 2 AND n >= c // 2 + 40 AND n < c // 2 + 80)""")
def page_index(t):
    """The first page, one from the middle by its offset, and the one after that by its token."""
    index = paging.PageIndex.write(t.orders, shared_folder(t.spark), [("o_orderstatus", True), ("o_totalprice", False), ("o_orderkey", True)], rows=5000)
    middle = index.page(index.total // 2, 40, marked=True)
    pages = [index.page(0, 40), middle, index.after(index.token(middle), 40)]
    each = [p.select(F.lit(k).alias("page"), "o_orderkey", "o_totalprice") for k, p in enumerate(pages)]
    return each[0].unionAll(each[1]).unionAll(each[2])


_WINDOWS = """(SELECT s_suppkey, TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((s_suppkey * 37) % 2400 AS INTEGER)) AS opens,
    TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST((s_suppkey * 37) % 2400 + CASE WHEN s_suppkey % 10 = 0 THEN 200 ELSE s_suppkey % 7 END AS INTEGER)) AS closes FROM supplier)"""


@query(f"""SELECT s_suppkey, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
    JOIN {_WINDOWS} ON o_orderdate <= closes AND o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) >= opens GROUP BY 1""")
def interval_join(t):
    """Orders, open for some days, and the windows of suppliers, short and long, that they fall into: joined by ranges alone, once for each
    different range."""
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 5).cast("int"))).alias("done"))
    start = F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval(((F.col("s_suppkey") * 37) % 2400).cast("int"))
    length = F.when(F.col("s_suppkey") % 10 == 0, 200).otherwise(F.col("s_suppkey") % 7).cast("int")
    w = t.supplier.select("s_suppkey", start.alias("opens"), (start + F.make_dt_interval(length)).alias("closes"))
    met = intervals.overlap_totals(o, w, ("o_orderdate", "done"), ("opens", "closes"), "orders", total="o_totalprice")
    return met.groupBy("s_suppkey").agg(F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


@query("""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, true AS customers_close, true AS median_close, true AS top_close FROM orders GROUP BY 1""")
def shard_sketches(t):
    """Sketches a customer shard and status, merged by status: within 3 % of the distinct count, 1 % of the median's rank, and the exact most frequent priorities."""
    o = t.orders.withColumn("shard", sharding.by_modulus(F.col("o_custkey"), 16))
    states = sketches.shard_sketches(o, ["shard", "o_orderstatus"], ["o_custkey"], ["o_totalprice"], ["o_orderpriority"])
    path = shared_folder(t.spark)
    states.write.parquet(path)
    merged = sketches.merge_sketches(t.spark.read.parquet(path), ["o_orderstatus"])
    found = merged.select(
        "o_orderstatus", "rows", sketches.distinct_count("distinct_o_custkey").alias("guess"), sketches.quantile("quantiles_o_totalprice", 0.5).alias("median"),
        F.transform(sketches.most_frequent("top_o_orderpriority", 5), lambda x: x["count"]).alias("top"),
    )
    priorities = o.groupBy("o_orderstatus", "o_orderpriority").count().groupBy("o_orderstatus").agg(F.sort_array(F.collect_list("count"), False).alias("counts"))
    exact = o.join(found.select("o_orderstatus", "median"), "o_orderstatus").groupBy("o_orderstatus").agg(
        F.count_distinct("o_custkey").alias("customers"), (F.count_if(F.col("o_totalprice") <= F.col("median")) / F.count("*")).alias("rank"),
    )
    return found.join(exact, "o_orderstatus").join(priorities, "o_orderstatus").select(
        "o_orderstatus", "rows", "customers", (F.abs(F.col("guess") / F.col("customers") - 1) <= 0.03).alias("customers_close"),
        (F.abs(F.col("rank") - 0.5) <= 0.01 + 1 / F.col("rows")).alias("median_close"), (F.slice("counts", 1, 5) == F.col("top").cast("array<bigint>")).alias("top_close"),
    )


_UNEVEN = "CASE WHEN o_orderkey % 10 < 6 THEN 'a' WHEN o_orderkey % 10 < 9 THEN 'b' ELSE 'c' END"


@query(f"""WITH r AS (SELECT *, {_UNEVEN} AS s, row_number() OVER (PARTITION BY {_UNEVEN} ORDER BY o_orderkey) - 1 AS r FROM orders),
    n AS (SELECT count(*) FILTER (s = 'b') AS nb, count(*) // 3 + CASE WHEN count(*) % 3 > 0 THEN 1 ELSE 0 END AS ga, count(*) // 3 + CASE WHEN count(*) % 3 > 1 THEN 1 ELSE 0 END AS gb FROM r)
    SELECT o_orderkey, o_totalprice, CASE WHEN s <> 'a' OR r < ga THEN s WHEN r < ga + gb - nb THEN 'b' ELSE 'c' END AS shard FROM r, n""")
def shards_rebalanced(t):
    """Three uneven shards made even: the last rows of the largest go to the others, slice by slice."""
    o = F.col("o_orderkey") % 10
    store = moving.ShardStore(t.spark, shared_folder(t.spark))
    store.create(t.orders.withColumn("s", F.when(o < 6, "a").when(o < 9, "b").otherwise("c")), "s")
    store.rebalance(["o_orderkey"])
    return store.read().select("o_orderkey", "o_totalprice", "shard")


def _changes(rows, key, value):
    """Each row inserted; every third changed; every fifth, and some that were never there, deleted: in three files without any order."""
    k = F.col(key)
    step = lambda v, df, x, gone: df.select(key, F.lit(v).alias("v"), x.alias(value), F.lit(gone).alias("gone"))
    made = step(1, rows, F.col(value), False).unionAll(step(2, rows.where(k % 3 == 0), F.col(value) + 1, False)).unionAll(step(3, rows.where(k % 5 == 0), F.lit(None).cast("double"), True))
    made = made.unionAll(step(1, rows.where(k < 20).withColumn(key, k + 50_000_000), F.lit(None).cast("double"), True)).unionAll(step(1, rows.where(k % 7 == 0), F.col(value), False))
    return made.withColumn("file", F.pmod(F.xxhash64(key, "v"), F.lit(3)))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def change_feed(t):
    """Inserts, updates and deletions out of order, by keyed state; the stream stops after two files and goes on from its checkpoint."""
    made, base = _changes(t.customer, "c_custkey", "c_acctbal"), shared_folder(t.spark)
    for part in ((0, 1), (2,)):
        for k in part:
            made.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{base}/in")
        feed = t.spark.readStream.schema(made.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        changes.append_batches(changes.effective_changes(feed, ["c_custkey"], "v", "gone"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = t.spark.read.parquet(f"{base}/out").select("c_custkey", "v", "c_acctbal", "gone")
    return changes.current_rows(out, ["c_custkey"], "v", "gone").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0")
def versioned_stream(t):
    """The same changes of orders applied by micro-batches to a versioned table, which keeps deletions as marked rows."""
    made, base = _changes(t.orders, "o_orderkey", "o_totalprice"), shared_folder(t.spark)
    made.repartition(3, "file").drop("file").write.parquet(f"{base}/in")
    table = _versioned(t, made.drop("file").limit(0), ["o_orderkey"])
    feed = t.spark.readStream.schema(made.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streams.upsert_versions(feed, table, "v", f"{base}/checkpoint").awaitTermination()
    return table.read().where("not gone").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"""SELECT 'incremental' AS name, {_COLUMNS} FROM {_TARGET} t UNION ALL SELECT 'differential', {_COLUMNS} FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT 'full', {_COLUMNS} FROM orders""")
def backup_chain(t):
    """A full backup, an incremental and a differential one, with changed, new and deleted rows, each restored."""
    chain = backups.BackupChain(t.spark, shared_folder(t.spark))
    chain.full("1", {"orders": t.orders}, {"orders": ["o_orderkey"]})
    chain.incremental("2", {"orders": _target(t)}, "1")
    chain.differential("3", {"orders": t.orders.where("o_orderkey % 4 <> 1")}, "2")
    each = [chain.restore(n, "orders").select(F.lit(name).alias("name"), *_COLUMNS.split(", ")) for n, name in (("2", "incremental"), ("3", "differential"), ("1", "full"))]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderkey <> 4")
def sqlite_shards_filtered(t):
    """Orders written to database files and read back with filters that SQLite decides."""
    sqlite_shards.register(t.spark)
    path = shared_folder(t.spark)
    t.orders.repartition(4).write.format("sqlite_shards").mode("append").save(path)
    return t.spark.read.format("sqlite_shards").option("rows", 5000).load(path).where("o_totalprice > 100000 AND o_orderstatus = 'F' AND o_orderkey <> 4").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("""SELECT n_name, o_orderstatus, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000 GROUP BY 1, 2""")
def cross_source_join(t):
    """One statement over orders in Parquet files, customers in database files, and nations in ORC files."""
    sqlite_shards.register(t.spark)
    path, orc = shared_folder(t.spark), shared_folder(t.spark)
    t.customer.repartition(2).write.format("sqlite_shards").mode("append").save(f"{path}/customer.sqlite_shards")
    t.nation.write.orc(f"{orc}/nation.orc")
    held = registry.Registry()
    held.register("files", registry.FileSource(t.spark, t.folder))
    held.register("db", registry.FileSource(t.spark, path, "sqlite_shards"))
    held.register("other", registry.FileSource(t.spark, orc, "orc"))
    return held.sql("""SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM files.orders AS o JOIN db.customer AS c ON o.o_custkey = c.c_custkey
        JOIN other.nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000 GROUP BY n_name, o_orderstatus""")
