"""Versioned tables, digests, pages, intervals, change feeds, moved shards, and sources with filters, commits and balanced bounds."""

import datetime as dt
import decimal
import math
import os
import random

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from shardloom.operators import compare, intervals, moving, paging, sketches, sync, versioned
from shardloom.sources import backups, registry, sqlite_shards
from shardloom.streaming import changes


def listed(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def data_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# --- versions ---


@pytest.fixture
def table(spark, tmp_path):
    rows = [(k if k < 300 else None, f"v{k}", k / 2) for k in range(310)]
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t")
    t.create(spark.createDataFrame(rows, "k long, s string, x double"), ["k"], 16)
    return t


def test_upsert_rewrites_touched_buckets_only(spark, table, tmp_path):
    before, files, old = table.version(), data_files(tmp_path), listed(table.read())
    assert table.upsert(spark.createDataFrame([(5, "new", 0.0), (900, "more", 1.0)], "k int, s string, x double"), deletes=spark.createDataFrame([(7,)], "k long")) == 2
    after = table.version()
    touched = {b for b in after.held if after.held[b] != before.held.get(b)}
    assert 1 <= len(touched) <= 3 and files <= data_files(tmp_path)
    assert all(after.held[b] == before.held[b] for b in after.held if b not in touched)
    kept = {f for b in after.held if b not in touched for f in table.read(buckets=[b]).inputFiles()}
    assert {f.removeprefix("file://") for f in kept} <= files
    want = sorted([r for r in old if r[0] not in (5, 7)] + [(5, "new", 0.0), (900, "more", 1.0)], key=repr)
    assert listed(table.read()) == want and listed(table.read(1)) == old
    found = table.lookup(spark.createDataFrame([(5,), (900,), (7,)], "k int"))
    assert sorted(r["s"] for r in found.collect()) == ["more", "new"] and len(found.inputFiles()) <= 3
    table.vacuum()
    assert table.versions() == [2] and listed(table.read()) == want and not kept - {f"file://{f}" for f in data_files(tmp_path)}


def test_a_batch_counts_once_and_failures_leave_the_last_version(spark, table, tmp_path):
    new = spark.createDataFrame([(1, "one", 1.0)], "k long, s string, x double")
    assert table.upsert(new, batch=4) == 2 and table.upsert(new, batch=4) == 2 and table.upsert(new, batch=3) == 2 and table.upsert(new, batch=5) == 3
    broken = new.withColumn("s", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        table.upsert(broken)
    assert table.versions() == [1, 2, 3]
    # A writer that died while it wrote the version's file.
    (tmp_path / "t" / "versions" / "0000000004.json").write_text('{"schema"')
    with pytest.raises(FileNotFoundError):
        table.version(4)
    assert table.version().number == 3
    with pytest.raises(versioned.Conflict):
        table.upsert(new)
    assert table.repair() == [4] and table.version().number == 3
    with pytest.raises(FileNotFoundError):
        versioned.VersionedTable(spark, f"file://{tmp_path}/none").read()


def test_of_two_writers_one_wins(spark, table, monkeypatch):
    real = versioned.VersionedTable._write

    def late(self, df, key, buckets):
        made = real(self, df, key, buckets)
        monkeypatch.setattr(versioned.VersionedTable, "_write", real)
        self.upsert(spark.createDataFrame([(2, "first", 0.0)], "k long, s string, x double"))
        return made

    monkeypatch.setattr(versioned.VersionedTable, "_write", late)
    with pytest.raises(versioned.Conflict):
        table.upsert(spark.createDataFrame([(2, "second", 0.0)], "k long, s string, x double"))
    assert [r["s"] for r in table.read().where("k = 2").collect()] == ["first"] and table.versions() == [1, 2]


def test_keys_empty_tables_and_newest_rows(spark, table, tmp_path):
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/e")
    t.create(spark.createDataFrame([], "a string, b int, v int, m map<string,int>"), ["a", "b"], 4)
    assert t.read().count() == 0
    rows = [("x", None, 1, {"q": 1}), ("x", None, 3, {"q": 2}), (None, 2, 1, None)]
    t.upsert(spark.createDataFrame(rows, t.version().schema), conflict="newest", latest="v")
    t.upsert(spark.createDataFrame([("x", None, 2, None), (None, 2, 5, {"z": 1})], t.version().schema), conflict="newest", latest="v")
    assert sorted([(r["a"], r["b"], r["v"], r["m"]) for r in t.read().collect()], key=repr) == sorted([("x", None, 3, {"q": 2}), (None, 2, 5, {"z": 1})], key=repr)
    assert table.read().where("k is null").count() == 10 and table.upsert(table.read().limit(0)) == 2


def test_equal_buckets_are_not_read_again(spark, table, tmp_path):
    other = versioned.VersionedTable(spark, f"file://{tmp_path}/o")
    changed = table.read().withColumn("x", F.when(F.col("k") == 42, -1.0).otherwise(F.col("x"))).where("k is null or k <> 43").orderBy(F.desc("s"))
    other.create(changed, ["k"], 64)
    rules = compare.Rules(key=("k",))
    found, compared = versioned.differing_buckets(table.version(), other.version())
    assert 1 <= len(found) <= 2 and compared < 16 + 3
    diff = versioned.tree_differences(table, other, rules)
    assert listed(diff) == listed(compare.field_differences(table.read(), other.read(), rules)) == [(42, "x", "21.0", "-1.0")]
    allowed = {f for b in found for f in table.read(buckets=[b]).inputFiles()} | {f for b in other.version().held if b % 16 in found for f in other.read(buckets=[b]).inputFiles()}
    assert set(diff.inputFiles()) <= allowed and len(allowed) < len(table.read().inputFiles()) + len(other.read().inputFiles())
    assert [r["k"] for r in versioned.tree_missing(table, other, rules).collect()] == [43]
    same = versioned.VersionedTable(spark, f"file://{tmp_path}/s")
    same.create(table.read().orderBy("x"), ["k"], 16)
    assert versioned.differing_buckets(table.version(), same.version()) == ([], 1)
    assert versioned.tree_differences(table, same, rules).count() == 0
    odd = versioned.VersionedTable(spark, f"file://{tmp_path}/odd")
    odd.create(table.read(), ["k"], 24)
    with pytest.raises(ValueError):
        versioned.tree_differences(table, odd, rules)


# --- pages ---


@pytest.mark.parametrize("keys", [[("a", True)], [("a", False), ("b", True)], [("b", True), ("a", False)]])
def test_pages_by_offset_and_by_token(spark, tmp_path, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, "x", "y", "z"]), k) for k in range(500)] + [(1, "x", 7)] * 3
    df = spark.createDataFrame(rows, "a int, b string, c int")
    index = paging.PageIndex.write(df, f"file://{tmp_path}/i", keys, rows=60)
    assert index.total == 503 and len(index.counts) >= 6 and paging.PageIndex.open(spark, f"file://{tmp_path}/i") == index
    pages = [[tuple(r) for r in index.page(at, 50).collect()] for at in range(0, 550, 50)]
    assert [len(p) for p in pages] == [50] * 10 + [3] and sorted((r for p in pages for r in p), key=repr) == sorted(rows, key=repr)

    def rank(r):
        out = []
        for name, up in keys:
            v = r["abc".index(name)]
            v = (v is None, "" if v is None and name == "b" else 0 if v is None else v)
            out.append(v if up else (not v[0], tuple(-ord(c) for c in v[1]) if isinstance(v[1], str) else -v[1]))
        return out

    flat = [r for p in pages for r in p]
    assert [rank(r) for r in flat] == sorted(rank(r) for r in rows)
    page, at = index.page(0, 50, marked=True), 0
    while token := index.token(page):
        assert [tuple(r)[:3] for r in page.collect()] == flat[at : at + 50]
        page, at = index.after(token, 50, marked=True), at + 50
    assert at == 550


def test_a_deep_page_reads_two_files(spark, tmp_path):
    df = spark.range(0, 20_000, numPartitions=7).select(F.col("id"), F.xxhash64("id").alias("h"))
    index = paging.PageIndex.write(df, f"file://{tmp_path}/i", [("h", True)], rows=1000)
    want = [r["h"] for r in df.orderBy("h").collect()]
    for at in (0, 9_990, 19_950):
        page = index.page(at, 50, marked=True)
        assert [r["h"] for r in page.collect()] == want[at : at + 50] and len(page.inputFiles()) <= 2
    token = index.token(index.page(12_000, 50, marked=True))
    page = index.after(token, 50)
    assert [r["h"] for r in page.collect()] == want[12_050:12_100] and len(page.inputFiles()) <= 2
    assert index.has_more(19_949, 50) and not index.has_more(19_950, 50)
    empty = paging.PageIndex.write(df.limit(0), f"file://{tmp_path}/e", [("h", True)])
    assert empty.page(0, 10).count() == 0 and empty.token(empty.page(0, 10, marked=True)) is None


# --- intervals ---


@pytest.mark.parametrize("kind", ["long", "double", "date", "timestamp", "timestamp_ntz", "decimal(12,3)"])
def test_intervals_by_all_pairs(spark, kind):
    rng = random.Random(kind)
    zero = dt.datetime(1969, 12, 25)

    def value(x):
        if kind == "long":
            return int(x)
        if kind == "double":
            return x + 0.25
        if kind.startswith("decimal"):
            return decimal.Decimal(round(x * 1000)) / 1000
        return (zero + dt.timedelta(days=int(x))).date() if kind == "date" else zero + dt.timedelta(minutes=x)

    def made(n):
        out = [(k, value(x := rng.uniform(-50, 50)), value(x + rng.choice([0, 0.3, 1, 5, 40, 200]))) for k in range(n)]
        return out + [(n, None, value(3)), (n + 1, value(3), None), (n + 2, value(9), value(-9)), (0, *out[0][1:])]

    a, b = made(60), made(50)
    left, right = spark.createDataFrame(a, f"i int, lo {kind}, hi {kind}"), spark.createDataFrame(b, f"j int, `from` {kind}, `to` {kind}")
    joined = intervals.interval_join(left, right, ("lo", "hi"), ("from", "to"))
    want = sorted((p[0], q[0]) for p in a for q in b if None not in (*p, *q) and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2])
    assert sorted((r["i"], r["j"]) for r in joined.collect()) == want and want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(left.limit(0), right, ("lo", "hi"), ("from", "to")).count() == 0


def test_overlap_totals_join_different_intervals_alone(spark, monkeypatch):
    rng, joined, join = random.Random(3), [], intervals.interval_join

    def counted(*args):
        joined.append(join(*args).count())
        return join(*args)

    monkeypatch.setattr(intervals, "interval_join", counted)
    made = lambda n: [(k, x := rng.randrange(9), x + rng.choice([0, 1, 4]), None if k % 7 == 0 else k) for k in range(n)] + [(n, None, 3, 1), (n + 1, 3, None, 1), (n + 2, 9, 2, 1)]
    a, b = made(400), made(300)
    left, right = spark.createDataFrame(a, "i int, `a.lo` int, hi int, v long"), spark.createDataFrame(b, "j int, `from` int, `b.to` int, w long")
    got = intervals.overlap_totals(left, right, ("a.lo", "hi"), ("from", "b.to"), "n", total="v", again="i")
    want = []
    for q in b:
        met = [p for p in a if None not in (*p[:3], *q[:3]) and p[1] <= p[2] and q[1] <= q[2] and p[1] <= q[2] and q[1] <= p[2]]
        if met:
            want.append((*q, len(met), sum(p[3] or 0 for p in met), sum(p[0] for p in met)))
    assert got.columns == ["j", "from", "b.to", "w", "n", "total", "again"]
    assert sorted(tuple(r) for r in got.select("j", "n", "total", "again").collect()) == sorted((q[0], *q[4:]) for q in want)
    # 27 different intervals a side at most.
    assert 0 < joined[0] <= 27 * 27
    assert intervals.overlap_totals(left.limit(0), right, ("a.lo", "hi"), ("from", "b.to")).count() == 0


def test_interval_join_query_expands_no_copies(spark, monkeypatch):
    from shardloom.catalog import QUERIES

    sizes, join = [], intervals.interval_join

    def seen(left, right, *ranges):
        sizes.append((left.count(), right.count()))
        return join(left, right, *ranges)

    monkeypatch.setattr(intervals, "interval_join", seen)
    n = len(QUERIES["interval_join"](spark, "/root/testdata/sf0.01").collect())
    orders, days = spark.read.parquet("/root/testdata/sf0.01/orders.parquet"), F.col("o_orderkey") % 5
    assert n and sizes[0][0] == orders.select("o_orderdate", days).distinct().count() < orders.count()


def test_interval_joins_refuse_what_they_can_t_read(spark):
    a = spark.createDataFrame([(1, 2)], "lo int, hi int")
    with pytest.raises(ValueError):
        intervals.interval_join(a, a, ("lo", "hi"), ("lo", "hi"))
    with pytest.raises(TypeError):
        intervals.interval_join(a, spark.createDataFrame([("x", "y")], "f string, t string"), ("lo", "hi"), ("f", "t"))


def test_newest_rows_are_sorted_in_parts_of_a_few_rows(spark, tmp_path, monkeypatch):
    rows = [(1, i, f"x{i % 7}", {"a": i}) for i in range(3000)] + [(k, 5, "y", None) for k in range(2, 900)] + [(None, i, None, {}) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, v long, s string, m map<string, int>")
    plain = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    dealt = sync.one_per_key(df, ["k"], "v", 20)
    assert plain(dealt) == plain(sync.one_per_key(df, ["k"], "v")) and len(plain(dealt)) == 900

    made, one = [], sync.one_per_key
    monkeypatch.setattr(versioned, "ROWS", 100)
    monkeypatch.setattr(versioned, "one_per_key", lambda *a: made.append(one(*a)) or made[-1])
    table = versioned.VersionedTable(spark, f"{tmp_path}/t")
    old = spark.range(1000).selectExpr("id AS k", "id % 9 AS v", "'old' AS s")
    table.create(old, ["k"], 8)
    table.upsert(spark.range(500, 1500).selectExpr("id AS k", "4L AS v", "'new' AS s"), "newest", "v")
    got = {r["k"]: r["s"] for r in table.read().collect()}
    # Of equal v the greatest of the other columns counts.
    assert got == {k: "old" if k < 500 or (k < 1000 and k % 9 >= 4 and (k % 9 > 4 or "old" > "new")) else "new" for k in range(1500)}
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    # Nothing is sorted where it was read: the changes' and the table's 2000 rows are dealt out to 20 tasks before.
    assert "Exchange" in plan[plan.rindex("Aggregate"):plan.rindex("Union")] and plan.count(", 20), REPARTITION_BY_NUM") == 2


# --- change feeds ---


def test_changes_in_any_order_leave_what_the_log_leaves(spark, tmp_path):
    rng = random.Random(3)
    log = [(k, v, f"r{k}.{v}", rng.random() < 0.3) for k in [None, *range(25)] for v in range(rng.randint(1, 6))]
    log += rng.sample(log, 20) + [(3, None, "no order", False)]
    rng.shuffle(log)
    schema = "k long, v int, t string, gone boolean"
    base = f"file://{tmp_path}"
    for n, at in enumerate(range(0, len(log), 30)):
        # Each run is a new start from the checkpoint.
        spark.createDataFrame(log[at : at + 30], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if n % 2 or at + 30 >= len(log):
            feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
            changes.append_batches(changes.effective_changes(feed, ["k"], "v", "gone"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    newest = {}
    for k, v, t, gone in log:
        if v is not None and (k not in newest or v > newest[k][1]):
            newest[k] = (k, v, t, gone)
    want = sorted([r for r in newest.values() if not r[3]], key=repr)
    out = spark.read.parquet(f"{base}/out")
    assert listed(changes.current_rows(out.drop("batch", "operation"), ["k"], "v", "gone")) == want
    assert listed(changes.current_rows(spark.createDataFrame(log, schema), ["k"], "v", "gone")) == want
    for k in newest:
        alive = False
        for r in out.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("v").collect():
            assert r["operation"] == ("delete" if r["gone"] else "update" if alive else "insert") and (alive or not r["gone"])
            alive = not r["gone"]
        assert alive == (not newest[k][3])


# --- shards ---


def test_a_rebalance_writes_only_shards_of_its_plan(spark, tmp_path):
    store = moving.ShardStore(spark, f"file://{tmp_path}/m")
    sizes = {"a": 500, "b": 100, "c": 251, "d": 153, "e": 251}
    rows = [(k, s) for s, n in sizes.items() for k in range(n)]
    store.create(spark.createDataFrame(rows, "id int, home string"), "home")
    _, before, _ = store.layout()
    files = data_files(tmp_path)
    moves = store.rebalance(["id"])
    _, after, _ = store.layout()
    assert {s: n for s, (n, _) in after.items()} == dict.fromkeys(sizes, 251) and {m.source for m in moves} == {"a"}
    assert after["c"] == before["c"] and after["e"] == before["e"] and files <= data_files(tmp_path)
    assert set(before["b"][1]) < set(after["b"][1]) and not set(before["a"][1]) & set(after["a"][1])
    got = listed(store.read())
    moved = [(k, "b") for k in range(251, 402)] + [(k, "d") for k in range(402, 500)]
    assert got == sorted([r for r in rows if r[1] != "a" or r[0] < 251] + moved, key=repr)
    assert store.rebalance(["id"]) == [] and store.layout()[0] == 2 and listed(store.read(1)) == sorted(rows, key=repr)
    with pytest.raises(Exception, match="no shard"):
        moving.ShardStore(spark, f"file://{tmp_path}/n").create(spark.createDataFrame([(1, None)], "id int, home string"), "home")


def test_sketches_merge_to_those_of_all_rows(spark):
    df = spark.range(30_000).select((F.col("id") % 8).alias("shard"), (F.col("id") % 5000).alias("u"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 100 < 60, "hot").otherwise((F.col("id") % 50).cast("string")).alias("w"))
    merged = sketches.merge_sketches(sketches.shard_sketches(df, ["shard"], ["u"], ["x"], ["w"]))
    r = merged.select("rows", sketches.distinct_count("distinct_u").alias("d"), sketches.quantile("quantiles_x", 0.9).alias("q"), sketches.most_frequent("top_w", 1).alias("t")).first()
    assert r["rows"] == 30_000 and abs(r["d"] / 5000 - 1) <= 0.03 and abs(r["q"] / 27_000 - 1) <= 0.01 and r["t"][0]["item"] == "hot" and abs(r["t"][0]["count"] / 18_000 - 1) < 0.01


# --- backup chains ---


def test_backups_are_restored_along_their_chain(spark, tmp_path):
    rng = random.Random(9)
    schema = "k int, j string, v double, m map<string,int>"
    now = {(k if k else None, j): (k if k else None, j, k / 2, {"a": k}) for k in range(60) for j in ("x", None)}
    frame = lambda: spark.createDataFrame(list(now.values()), schema)
    chain = backups.BackupChain(spark, f"file://{tmp_path}/b")
    seen = {"01": dict(now)}
    chain.full("01", {"t": frame()}, {"t": ["k", "j"]})
    for n, mode in (("02", "incremental"), ("03", "incremental"), ("04", "differential"), ("05", "incremental"), ("06", "incremental")):
        for key in rng.sample(sorted(now, key=repr), 9):
            if rng.random() < 0.5:
                del now[key]
            else:
                now[key] = (*now[key][:2], rng.choice([None, math.nan, rng.random()]), rng.choice([None, {"b": 1}]))
        fresh = 100 + int(n)
        now[fresh, "new"] = (fresh, "new", 0.0, None)
        seen[n] = dict(now)
        getattr(chain, mode)(n, {"t": frame()}, f"{int(n) - 1:02d}")
    assert [b.name for b in chain.chain("06")] == ["01", "04", "05", "06"] and [b.name for b in chain.chain("03")] == ["01", "02", "03"] and len(chain.backups()) == 6
    for n, rows in seen.items():
        assert sorted(map(repr, ((r["k"], r["j"], r["v"], r["m"]) for r in chain.restore(n, "t").collect()))) == sorted(map(repr, rows.values())), n
    assert all(chain.verify("06").values()) and spark.read.parquet(f"file://{tmp_path}/b/06/rows/t").count() <= 10
    # A backup that died, a name that is taken, other columns.
    os.remove(tmp_path / "b" / "06" / "backup.json")
    assert [b.name for b in chain.backups()][-1] == "05"
    with pytest.raises(ValueError):
        chain.full("06", {"t": frame()}, {"t": ["k", "j"]})
    with pytest.raises(ValueError):
        chain.incremental("07", {"t": frame().drop("v")}, "05")


# --- SQLite files ---

KINDS = "i int, l long, d double, s string, b boolean, day date, at timestamp_ntz, n decimal(20,4), raw binary"
VALUES = [
    (1, 2**62, 1.5, "a", True, dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5, 678), decimal.Decimal("12.3400"), b"\0\1"),
    (2, -1, math.nan, "é日", False, dt.date(1960, 1, 1), dt.datetime(1950, 1, 1), decimal.Decimal("-0.0001"), b""),
    (3, 0, math.inf, "", None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, 5, -0.5, "a'b\"c", True, dt.date(2000, 1, 1), None, None, b"x"),
]


def test_rows_come_back_from_database_files(spark, tmp_path):
    sqlite_shards.register(spark)
    path = str(tmp_path / "t")
    df = spark.createDataFrame(VALUES, KINDS).repartition(3)
    df.write.format("sqlite_shards").mode("append").save(path)
    read = lambda: spark.read.format("sqlite_shards").option("rows", 1).load(path)
    assert repr(listed(read())) == repr(listed(df)) and read().dtypes == df.dtypes
    tests = [
        "d > 1", "d = double('NaN')", "d < 2", "s = 'a'", "s >= 'b'", "s like 'a%'", "s is null", "s is not null", "b", "not b", "day >= date'1999-01-01'", "i in (1, 5, 9)", "i <> 1", "l <=> 0", "not (l <=> 0)",
        "n > 0", "at < timestamp_ntz'2000-01-01 00:00:00'", "i = 1 or s = ''", "raw = X'78'", "i <=> null", "d <= -0.5 and s like '%c'",
    ]
    for test in tests:
        assert repr(listed(read().where(test))) == repr(listed(df.where(test))), test
    df.write.format("sqlite_shards").mode("append").save(path)
    assert read().count() == 10
    df.limit(2).write.format("sqlite_shards").mode("overwrite").save(path)
    assert read().count() == 2
    with pytest.raises(Exception, match="can't keep"):
        spark.createDataFrame([([1],)], "x array<int>").write.format("sqlite_shards").mode("append").save(str(tmp_path / "u"))


def test_filters_are_decided_in_the_database(spark, tmp_path):
    sqlite_shards.register(spark)
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "cast(id % 10 as string) as s").coalesce(1).write.format("sqlite_shards").mode("append").save(path)
    reader = sqlite_shards.SqliteShards({"path": path, "rows": "300"}).reader(sqlite_shards.SqliteShards({"path": path}).schema())
    left = list(reader.pushFilters([ds.GreaterThan(("id",), 500), ds.EqualTo(("s",), "3"), ds.StringContains(("s",), "3")]))
    assert [type(f) for f in left] == [ds.StringContains]
    parts = reader.partitions()
    assert [(p.low, p.high) for p in parts] == [(1, 301), (301, 601), (601, 901), (901, 1001)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 50
    plan = spark.read.format("sqlite_shards").load(path).where("id > 500 and s = '3'")
    assert plan.count() == 50 and "Filter (" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_failed_write_shows_nothing(spark, tmp_path):
    sqlite_shards.register(spark)
    path = tmp_path / "t"
    spark.range(10).write.format("sqlite_shards").mode("append").save(str(path))
    held = sorted(os.listdir(path))
    bad = spark.range(0, 100, numPartitions=4).select(F.when(F.col("id") == 90, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="stop"):
            bad.write.format("sqlite_shards").mode(mode).save(str(path))
        assert sorted(os.listdir(path)) == held and spark.read.format("sqlite_shards").load(str(path)).count() == 10


# --- balanced bounds ---


def test_parts_of_a_skewed_table_are_even(spark, tmp_path):
    """Keys in a far-off cluster, one value with a third of the rows, and rows without a key."""
    options = {"url": f"jdbc:derby:{tmp_path}/d;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    source = registry.JdbcSource(spark, "derby", options)
    rng = random.Random(1)
    rows = [(7, k) for k in range(2000)] + [(10_000_000 + rng.randrange(500), k) for k in range(2500)] + [(rng.randrange(10**9), k) for k in range(1000)] + [(None, k) for k in range(500)] + [(-k, None) for k in range(5)]
    source.write(spark.createDataFrame(rows, "k long, other int"), "skewed", "overwrite")
    assert len(source.balanced("skewed", "k", 8)) <= 14
    df = source.read_balanced("skewed", "k", 8, second="other")
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert listed(df) == sorted([tuple(r) for r in rows], key=repr)
    assert max(sizes) <= 2 * len(rows) / 8 and 8 <= len(sizes) <= 16
    source.write(spark.createDataFrame([], "k long, other int"), "nothing", "overwrite")
    assert source.read_balanced("nothing", "k").count() == 0


def test_statements_over_several_sources(spark, tmp_path):
    spark.createDataFrame([(1, "db.t"), (2, "x")], "id int, s string").write.parquet(f"file://{tmp_path}/t.parquet")
    spark.createDataFrame([(1, 10), (3, 30)], "id int, v int").write.json(f"file://{tmp_path}/u.json")
    held = registry.Registry({"db": registry.FileSource(spark, f"file://{tmp_path}"), "log": registry.FileSource(spark, f"file://{tmp_path}", "json")})
    got = held.sql("SELECT a.id, s, v /* db.nothing */ FROM db.t a LEFT JOIN log.u b ON a.id = b.id WHERE s <> 'db.missing' AND a.id > 0 -- log.none")
    assert listed(got) == sorted([(1, "db.t", 10), (2, "x", None)], key=repr)
    assert [tuple(r) for r in held.sql("SELECT count(*) FROM db.t x JOIN db.t y ON x.id = y.id").collect()] == [(2,)]
    plan = held.sql("SELECT s FROM db.t WHERE id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in plan
    with pytest.raises(ValueError):
        held.sql("SELECT 1")
