"""Edge cases that the shipped tables do not hold."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.functions import codec, hashing, text, values
from shardloom.operators import adapters, compare, fusion, logs, predicates, sharding, sync
from shardloom.plans import advisor, builder, schema_map
from shardloom.sources import registry, snapshots
from shardloom.streaming import streams


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hashes_wrap_like_unsigned_numbers(spark):
    words = ["", "a", "user_0", "日本語", "x" * 300]
    df = spark.createDataFrame([(w,) for w in words], "w string")

    def fnv(s):
        h = 1469598103934665603
        for b in s.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    def poly(s):
        h = 0
        for b in s.encode():
            h = (h * 31 + b) % 2**64
        return h

    got = df.select("w", hashing.fnv64(F.col("w")), hashing.poly31(F.col("w")), hashing.unsigned_mod(hashing.fnv64(F.col("w")), 7)).collect()
    for w, f, p, m in got:
        assert (f % 2**64, p % 2**64, m) == (fnv(w), poly(w), fnv(w) % 7)


def test_text_hash_is_balanced(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("k"))
    sizes = [r["rows"] for r in sharding.shard_sizes(keys, sharding.by_text_hash(F.col("k"), 4)).collect()]
    assert len(sizes) == 4 and all(abs(n - 2500) <= 250 for n in sizes)


def test_routes(spark):
    df = spark.createDataFrame([(25, "Shanghai", -5), (-1, "nowhere", 7), (1000, "Beijing", 0)], "age int, city string, n int")
    got = df.select(
        sharding.by_range(F.col("age"), 0, 100, 4), sharding.by_range(F.col("age"), 0, 100, 4, True), sharding.by_list(F.col("city"), ["Beijing", "Shanghai"]),
        sharding.by_modulus(F.col("n"), 3), sharding.by_bounded_modulus(F.col("n"), 3),
    )
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1, 2, 0), (0, 3, 0, 1, 1), (3, 3, 0, 0, 0)]


def test_ring_moves_only_what_it_must(spark):
    keys = spark.range(500).select("id", sharding.ring_node(F.col("id"), ["a", "b", "c"], 16).alias("x"), sharding.ring_node(F.col("id"), ["a", "b", "c", "d"], 16).alias("y"))
    rows = keys.collect()
    assert all(r["x"] == r["y"] or r["y"] == "d" for r in rows) and any(r["y"] == "d" for r in rows)


def test_rebalance_evens_out():
    sizes = {"a": 100, "b": 0, "c": 5, "d": 0}
    for m in sharding.rebalance(sizes):
        sizes[m.source] -= m.rows
        sizes[m.target] += m.rows
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 105
    assert sharding.rebalance({}) == []


def test_joins_with_nulls_and_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (1, "r"), (None, "s")], "j int, b string")
    assert fusion.hash_join(a, b, "k", "j").count() == 6
    assert fusion.hash_join(a, b, "k", "j", null_safe=True).count() == 7
    assert fusion.hash_join(a, b, "k", "j", "full").count() == 8
    pairs = fusion.pairing_join(a, b.withColumnRenamed("j", "k"), "k", "a", "b")
    assert listed(pairs) == [(1, "x", "p"), (1, "y", "q")]


def test_aggregates_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    got = fusion.aggregate(empty, [], n=("count", "*"), s=("sum", "v"), a=("avg", "v"), lo=("min", "v"), hi=("max", "v")).first()
    assert tuple(got) == (0, 0.0, 0.0, None, None)
    assert fusion.aggregate(empty, ["k"], n=("count", "*")).count() == 0


def test_text_order_is_not_numeric(spark):
    df = spark.createDataFrame([(9,), (10,), (100,)], "n int")
    assert [r[0] for r in fusion.top_n(df, [("n", True)], 2).collect()] == [9, 10]
    assert [r[0] for r in fusion.top_n(df, [("n", True)], 2, text=True).collect()] == [10, 100]


def test_tolerance_and_nulls(spark):
    rules = compare.Rules(key=("id",))
    schema = "id int, x double, s string, updated_at string"
    s = spark.createDataFrame([(1, 1.0, "a", "u"), (2, None, "b ", "u"), (3, 1.0, None, "u"), (4, 0.0, "", "u")], schema)
    t = spark.createDataFrame([(1, 1.00001, "A", "v"), (2, None, "b", "v"), (3, 1.001, "c", "v"), (5, 0.0, "", "v")], schema)
    assert [r[:2] for r in listed(compare.field_differences(s, t, rules))] == [(1, "s"), (3, "s"), (3, "x")]
    loose = compare.Rules(key=("id",), ignore_case=True)
    assert (1, "s") not in [r[:2] for r in listed(compare.field_differences(s, t, loose))]
    none = s.limit(0)
    assert compare.statistics(none, none, rules).first()["match_percentage"] == 100.0
    assert compare.statistics(s, none, rules).first()["missing_in_target"] == 4


def test_conflict_strategies(spark):
    s = spark.createDataFrame([(1, None), (2, "new")], "k int, v string")
    t = spark.createDataFrame([(1, "old"), (3, "old")], "k int, v string")
    assert listed(sync.upsert(s, t, ["k"], "update")) == [(1, None), (2, "new"), (3, "old")]
    assert listed(sync.upsert(s, t, ["k"], "skip")) == [(1, "old"), (2, "new"), (3, "old")]
    assert listed(sync.upsert(s, t, ["k"], "merge")) == [(1, "old"), (2, "new"), (3, "old")]
    with pytest.raises(Exception, match="a key is in both tables"):
        sync.upsert(s, t, ["k"], "error").collect()
    apart = sync.upsert(s.where("k = 2"), t, ["k"], "error")
    assert listed(apart) == [(1, "old"), (2, "new"), (3, "old")]
    assert sync.high_water_mark(s.limit(0), "k") is None


def test_log_windows_at_an_edge(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(at, "ERROR"), (at + dt.timedelta(seconds=299), "FATAL"), (at + dt.timedelta(seconds=300), "INFO"), (None, "ERROR"), (at, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, level string").withColumn("message", F.lit("m"))
    got = [tuple(r)[2:4] for r in logs.windows(df, 300).orderBy("window_start").collect()]
    assert got == [(3, 2), (1, 0)]
    assert logs.error_rate(df).first()[0] == 0.6
    assert logs.error_rate(df.limit(0)).first()[0] == 0.0
    week = spark.range(1).select(logs.partition_suffix(F.lit("2024-12-30").cast("date"), "week")).first()[0]
    assert week == "2025-W01"


def test_values(spark):
    df = spark.createDataFrame([(" 12 ", "yes"), ("x", "maybe"), (None, None)], "a string, b string")
    got = df.select(values.cleaned(F.col("a"), values.Field("a", "INT")), values.cleaned(F.col("b"), values.Field("b", "BOOLEAN", default="false"), null_to_default=True))
    assert [tuple(r) for r in got.collect()] == [("12", "true"), ("x", "maybe"), (None, "false")]
    field = values.Field("n", "VARCHAR", length=3, nullable=False)
    assert [r[0] for r in df.select(values.violations(F.col("b"), T.StringType(), field)).collect()] == [[], ["length"], ["null"]]
    assert values.family("POINT") == "other" and values.family("BIGINT") == "numeric"


def test_text_functions(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(text.similarity(F.col("a"), F.col("b"))).collect()] == [0.5714, 0.0]
    one = spark.createDataFrame([("1 UNION SELECT sleep(1); -- it's",)], "t string")
    got = one.select(text.injection_findings(F.col("t")), text.injection_risk(F.col("t")), text.sanitized(F.col("t"))).first()
    assert got[0] == ["comment", "quote", "stacked", "union", "function:SLEEP"] and got[1] == "CRITICAL" and got[2] == "1 UNION SELECT sleep(1)  it''s"


def test_many_join_cuts_keys_into_cells(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CELL", (7, 5))
    monkeypatch.setattr(fusion, "PAIRS", 100)
    # Key 1 is long on both sides, 2 on the left, 3 on the right; null is a key for null-safe joins; 4 and 5 have no partner. Row 0 is there twice.
    left = [(i, k) for i, k in enumerate([1] * 40 + [2] * 60 + [3] + [None] * 20 + [4] * 9)] + [(0, 1)]
    right = [(i, float(i % 10), k) for i, k in enumerate([1] * 30 + [2] + [3] * 80 + [None] * 10 + [5])]
    a = spark.createDataFrame(left, "i long, k int")
    b = spark.createDataFrame(right, "j long, v double, `k 2` long")
    for null_safe in (False, True):
        want = sorted(((*x, *y) for x in left for y in right if x[1] == y[2] and y[1] < 4 and (null_safe or x[1] is not None)), key=repr)
        assert listed(fusion.many_join(a, b, "k", "k 2", "v < 4", null_safe)) == want
    sizes = [r[0] for r in fusion.many_join(a, b, "k", "k 2").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 41 * 30 + 60 + 80 and max(sizes) < 41 * 30
    assert fusion.many_join(a.limit(0), b, "k", "k 2").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        fusion.many_join(a, a, "k", "k")


@pytest.mark.parametrize("name", ["hash_join_null_safe", "theta_join"])
def test_joins_of_many_to_many_are_cut_by_pairs(spark, monkeypatch, name):
    from shardloom.catalog import QUERIES

    # Rows lie in one file a side: the join is dealt out by pairs all the same, and cells change nothing.
    whole = listed(QUERIES[name](spark, "/root/testdata/sf0.01"))
    monkeypatch.setattr(fusion, "CELL", (30, 2))
    monkeypatch.setattr(fusion, "PAIRS", 100)
    monkeypatch.setattr(fusion, "ROWS", 100)
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert listed(df) == whole and df.select(F.spark_partition_id()).distinct().count() > 1


def test_many_join_pairs_all_left_rows_with_a_block_at_a_time(spark, monkeypatch, tmp_path):
    # Copies of a few right rows lie next to each other, so files stay small whatever the number of right rows of a key is.
    a, b = spark.range(2000).selectExpr("id AS i", "0 AS k"), spark.range(1801).selectExpr("id AS j", "0 AS k2")
    df = fusion.many_join(a, b, "k", "k2")
    df.write.parquet(f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").agg(F.count("*"), F.count_distinct("i", "j")).first() == (2000 * 1801, 2000 * 1801)
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) < 0.2 * 2000 * 1801
    monkeypatch.setattr(fusion, "CELL", (500, 1801))
    monkeypatch.setattr(fusion, "BLOCK", 4, raising=False)
    rows = [(r["i"], r["j"]) for r in fusion.many_join(a.limit(500), b, "k", "k2").limit(500 * 12).collect()]
    for block in (rows[:2000], rows[2000:4000], rows[4000:]):
        assert len({j for _, j in block}) == 4 and len({i for i, _ in block}) == 500


def test_many_join_keeps_copies_and_its_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CELL", (7, 5))
    monkeypatch.setattr(fusion, "BLOCK", 2, raising=False)
    # Rows alike share a cell, which then has more blocks than turns; zeros are one key, and NaN is.
    nan = float("nan")
    left = [(i % 3, k) for k in (0.0, -0.0, nan, None, 1.5) for i in range(9)]
    right = [(j % 2, k) for k in (0.0, -0.0, nan, None, 2.5) for j in range(40)]
    a, b = spark.createDataFrame(left, "i int, k double"), spark.createDataFrame(right, "j int, k2 double")
    same = {(x, y): repr(abs(x) if x is not None else x) == repr(abs(y) if y is not None else y) for _, x in left for _, y in right}
    for null_safe in (False, True):
        want = sorted(repr((i, j)) for i, x in left for j, y in right if same[x, y] and (null_safe or x is not None))
        got = fusion.many_join(a, b, "k", "k2", null_safe=null_safe)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
        assert sorted(repr((r["i"], r["j"])) for r in got.collect()) == want


def test_codec_round_trip(spark):
    rows = [("a" * 2000,), ("äö" * 600,), ("short",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    packed = F.octet_length("t") > 1024
    back = df.select(codec.decompress(codec.compress(F.col("t")), packed), codec.shift_decrypt(codec.shift_encrypt(F.col("t"), "k3y"), "k3y"))
    assert [tuple(r) for r in back.collect()] == [(r[0], r[0]) for r in rows]


def test_cipher_holds_one_text_at_a_time_in_small_batches(spark):
    import tracemalloc

    import pandas as pd

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        spark.conf.set(key, str(2**31 - 1))
        there, back = (codec._shifted("k3y", sign).func for sign in (1, -1))
        assert int(spark.conf.get(key)) <= 4_000_000
    finally:
        spark.conf.set(key, held)
    texts = pd.Series([*["äb" * 20_000] * 200, None, ""], dtype=object)
    coded = there(texts)
    tracemalloc.start()
    try:
        assert back(coded).tolist() == texts.tolist()
        assert tracemalloc.get_traced_memory()[1] < 8 * texts.dropna().map(len).sum()
    finally:
        tracemalloc.stop()


def test_packing_columns_bounds_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    df = spark.createDataFrame([("a" * 2000,), ("short",), (None,)], "t string")
    moved = df.selectExpr("CAST(null AS string) AS t", "CAST(null AS string) AS _c_t")
    try:
        for run in (lambda: codec.packed_columns(df, ["t"]), lambda: codec.unpacked_columns(moved, ["t"])):
            spark.conf.set(key, str(2**31 - 1))
            run()
            assert int(spark.conf.get(key)) <= 4_000_000
        assert listed(codec.unpacked_columns(codec.packed_columns(df, ["t"]), ["t"])) == listed(df)
    finally:
        spark.conf.set(key, held)


def test_codec_bounds_batches_of_the_session_it_runs_in(spark):
    from conftest import DATA
    from shardloom.catalog import QUERIES

    key, folder = "spark.sql.execution.arrow.maxBytesPerBatch", f"{DATA}/sf0.001"
    other = spark.newSession()  # which isn't the active one
    df = other.range(150).selectExpr("id", "CASE WHEN id % 3 > 0 THEN repeat('ä' || id, 20 * CAST(id AS int)) END AS t")
    moved = df.selectExpr("CAST(null AS string) AS t", "CAST(null AS string) AS _c_t")
    for run in (lambda: codec.packed_columns(df, ["t"]), lambda: codec.unpacked_columns(moved, ["t"]), lambda: QUERIES["compress_columns"](other, folder), lambda: QUERIES["compress_roundtrip"](other, folder)):
        other.conf.set(key, str(2**31 - 1))
        run()
        assert int(other.conf.get(key)) <= 4_000_000
    assert listed(codec.unpacked_columns(codec.packed_columns(df, ["t"]), ["t"])) == listed(df)


def test_line_protocol_escapes(spark):
    df = spark.createDataFrame([("a b", 'say "hi"', 3, 1.5), (None, None, None, None)], "host string, note string, n int, v double")
    got = adapters.line_protocol(df, "m", ["host"], ["note", "n", "v"], F.lit(7)).collect()
    assert [r[0] for r in got] == ['m,host=a\\ b n=3i,note="say \\"hi\\"",v=1.5 7']


def test_filters(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "a")], "k int, v string")
    assert predicates.without_nulls(df).count() == 2 and predicates.without_duplicates(df).count() == 2
    assert predicates.removed(df, predicates.without_duplicates(df, ["k"])).first()[0] == 2
    with pytest.raises(ValueError):
        predicates.where("k", "= 1 OR 1", 1)


def test_schema_mapping():
    types = schema_map.TypeTable()
    assert types.lookup("DECIMAL(10,2)", "mysql", "postgresql").target_type == "NUMERIC(10,2)"
    assert types.lookup("TINYINT(1)", "mysql", "postgresql").target_type == "BOOLEAN"
    assert types.lookup("DATETIME", "sqlite", "postgresql") is None
    f = values.Field
    links = schema_map.link_fields([f("id", "INT"), f("createdAt", "DATETIME"), f("email", "TEXT"), f("x", "JSON")], [f("ID", "INT"), f("created_at", "TIMESTAMP"), f("mail", "TEXT")])
    assert [(x.target, x.kind) for x in links] == [("ID", "case_insensitive"), ("created_at", "naming"), ("mail", "semantic"), (None, "unmatched")]
    matched = schema_map.match_fields([f("name", "varchar"), f("email", "varchar")], [f("full_name", "varchar"), f("email_address", "varchar")])
    assert [m.target for m in matched] == ["full_name", "email_address"]
    made = schema_map.convert_table("t", [f("id", "INT", nullable=False, primary_key=True), f("at", "DATETIME")], "mysql", "postgresql")
    assert made.lossy == ("at",) and "PRIMARY KEY" in made.ddl
    assert schema_map.parse_version("8.0.32-log (x 9)") == (8, 0, 32) and schema_map.direction("mysql", "mysql", "5.7.1", "8.0") == "version"
    assert schema_map.spark_type("DECIMAL(12,3)") == "decimal(12,3)" and schema_map.spark_type("TINYINT(1)") == "boolean"


def test_addresses():
    a = registry.Address.parse("postgres://u:secret@db/x")
    assert a.port == 5432 and a.masked() == "postgresql://u:s***t@db:5432/x" and not a.is_local()
    assert a.jdbc()["url"] == "jdbc:postgresql://db:5432/x"
    with pytest.raises(ValueError):
        registry.Address.parse("nonsense")


def test_builders(spark):
    assert builder.strategy("SELECT a FROM b ORDER BY a LIMIT 3") == "top_n"
    assert builder.insert_text("t", ["a", "b"], "dollar", 2) == "INSERT INTO t (a, b) VALUES ($1, $2), ($3, $4)"
    assert builder.identifier('a"b', "sqlite") == '"a""b"'
    assert advisor.maintenance_statements("t", "mysql")[0] == "ANALYZE TABLE t;"


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    snapshots.backup({"t": df, "empty": df.limit(0)}, f"file://{tmp_path}/b")
    assert snapshots.verify(spark, f"file://{tmp_path}/b") == {"t": True, "empty": True}
    assert listed(snapshots.restore(spark, f"file://{tmp_path}/b", "t")) == listed(df)
    df.limit(1).write.mode("append").parquet(f"file://{tmp_path}/b/t")
    assert not snapshots.verify(spark, f"file://{tmp_path}/b")["t"]
    assert snapshots.transfer(df, {"k": "id", "v": "name"}, f"file://{tmp_path}/c") == {"read": 2, "written": 1, "skipped": 1}


def test_stream_upsert(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string").write.parquet(f"{tmp_path}/in")
    versions = []

    def publish(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/v{number}")
        versions.append(number)

    changes = spark.readStream.schema("k int, seq int, v string").parquet(f"{tmp_path}/in")
    streams.upsert_stream(changes, lambda: spark.createDataFrame([(2, 0, "old"), (3, 0, "kept")], "k int, seq int, v string"), publish, ["k"], "seq", f"{tmp_path}/cp").awaitTermination()
    assert listed(spark.read.parquet(f"{tmp_path}/v{versions[-1]}")) == [(1, 2, "b"), (2, 1, "c"), (3, 0, "kept")]


def test_values_are_compared_exactly(spark):
    big, nan, inf = 9007199254740993, float("nan"), float("inf")
    a = spark.createDataFrame([(1, big, nan, 1.0), (2, 5, inf, 1.0), (3, None, -inf, None), (None, 7, 0.0, 2.0)], "id int, n long, x double, y double")
    b = spark.createDataFrame([(1, big - 1, nan, 1.00005), (2, 5, inf, 1.0002), (3, None, inf, 3.0), (None, 7, 0.0, 2.0)], "id int, n long, x double, y double")
    got = [(r["id"], r["field"]) for r in compare.field_differences(a, b, compare.Rules()).collect()]
    assert sorted(got) == [(1, "n"), (2, "y"), (3, "x"), (3, "y")]
    stats = compare.statistics(a, b, compare.Rules()).first()
    assert (stats["matched_rows"], stats["diff_fields"], stats["match_percentage"]) == (4, 4, 100.0)
    assert compare.missing_rows(a, b, compare.Rules()).count() == 0
    text = compare.report(stats, compare.field_differences(a, b, compare.Rules()).collect(), "t")
    assert "matched 4 (100.0 %)" in text and f"n: {big} | {big - 1}" in text
    statements = [r[0] for r in compare.sync_statements(a, b.where("id is not null"), "t", compare.Rules()).collect()]
    assert any(s.startswith("INSERT INTO t") and "NULL" in s for s in statements)
    gone = [r[0] for r in compare.sync_statements(a.where("id = 1"), b, "t", compare.Rules()).collect()]
    assert "DELETE FROM t WHERE id IS NULL;" in gone


def test_repeated_and_null_keys_come_once(spark):
    s = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (None, 1, "n")], "k int, seq int, v string")
    t = spark.createDataFrame([(1, 0, "t1"), (None, 0, "tn"), (2, 0, "t2")], "k int, seq int, v string")
    assert listed(sync.upsert(s, t, ["k"], latest="seq")) == sorted([(1, 2, "new"), (None, 1, "n"), (2, 0, "t2")], key=repr)
    assert listed(sync.upsert(s, t, ["k"], "skip")) == listed(t)
    assert listed(sync.upsert(s, t, ["k"], "merge", "seq")) == sorted([(1, 2, "new"), (None, 1, "n"), (2, 0, "t2")], key=repr)
    assert listed(sync.update_existing(s, t, ["k"], "seq")) == sorted([(1, 2, "new"), (None, 1, "n"), (2, 0, "t2")], key=repr)
    assert sync.deleted(s, t, ["k"]).collect()[0]["k"] == 2
    with pytest.raises(Exception, match="in both"):
        sync.upsert(s, t, ["k"], "error").collect()
    assert sync.upsert(s.where("k = 1"), t.where("k = 2"), ["k"], "error").count() == 2


def test_checksums_see_nulls_and_snapshots_are_listed(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    swapped = df.select(F.col("y").alias("x"), F.col("x").alias("y"))
    assert snapshots.digest(df).first() != snapshots.digest(swapped).first() and snapshots.digest(df.limit(0)).first()[0] == 0
    base = f"file://{tmp_path}/all"
    for name in ("one", "two"):
        snapshots.backup({"t": df}, f"{base}/{name}")
    assert listed(snapshots.list_snapshots(spark, base)) == [("one", "t", "full", 2), ("two", "t", "full", 2)]
    assert snapshots.delete_snapshot(spark, base, "one") and not snapshots.delete_snapshot(spark, base, "one")
    assert snapshots.list_snapshots(spark, base).count() == 1 and snapshots.list_snapshots(spark, f"{base}/none").count() == 0
    with pytest.raises(ValueError):
        snapshots.delete_snapshot(spark, base, "../all")
    mapping = {"x": "a", "y": "b"}
    assert snapshots.load_mapping(snapshots.save_mapping(mapping)) == mapping
    for mode in ("schema", "data", "incremental"):
        m = snapshots.backup({"t": df}, f"{base}/{mode}", mode, "x", "a").first()
        assert (m["rows"], bool(m["schema"])) == {"schema": (0, True), "data": (2, False), "incremental": (1, True)}[mode]


def test_numbers_within_groups(spark):
    from shardloom.operators import ordering

    rows = [(None if k % 5 == 0 else "hot" if k % 2 else f"g{k % 7}", k, k % 3) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(6)
    got = {r["k"]: r["before"] for r in ordering.running_total(df, ["g"], ["k"], F.col("w"), "before").collect()}
    assert got == {k: sum(w for h, j, w in rows if h == g and j < k) for g, k, _ in rows}
    assert ordering.number_in_groups(df.limit(0), ["g"], ["k"]).count() == 0
    assert sorted(r["_shard"] for r in sharding.roll_over(df.where("g = 'hot'"), "g", ["k"], 50).collect()) == sorted(k // 50 + 1 for k in range(160))


def test_ring_and_topologies(spark):
    nodes = tuple(sharding.Node(f"s{k}", f"t_{k}") for k in range(4))
    ring = sharding.Topology("t", "k", nodes, "consistent_hash")
    df = spark.range(2000).select(F.col("id").alias("k"))
    was = {r["k"]: r["_node"] for r in ring.route(df).collect()}
    now = {r["k"]: r["_node"] for r in ring.without("s2").route(df).collect()}
    assert set(was.values()) == {n.id for n in nodes} and all(now[k] == n for k, n in was.items() if n != "s2") and "s2" not in now.values()
    assert ring.prune(ring.route(df), [3, 4]).count() == 2
    held = sharding.Topologies()
    held.register(ring)
    assert held.get("t") is ring
    with pytest.raises(KeyError):
        held.get("x")
    with pytest.raises(Exception, match="no k"):
        spark.createDataFrame([(None,)], "k string").select(sharding.required_key(F.col("k"), "k")).collect()
    assert "a -> b: 3" in sharding.migration_report([sharding.Move("a", "b", 3)])
    registry = spark.createDataFrame([("t", 0, 5, 1.0, False), ("t", 1, 2, 0.5, True)], "table_name string, shard int, row_count long, size_mb double, is_active boolean")
    sizes = spark.createDataFrame([("t", 1, 9, 2.0)], "table_name string, shard int, row_count long, size_mb double")
    assert listed(sharding.update_registry(registry, sizes)) == [("t", 0, 5, 1.0, False), ("t", 1, 9, 2.0, True)]


def test_sharded_tables_are_pruned(spark, tmp_path):
    topology = sharding.Topology("t", "k", tuple(sharding.Node(f"s{k}", f"t_{k}") for k in range(8)))
    sharding.write_sharded(spark.range(500).select(F.col("id").alias("k")), f"file://{tmp_path}/t", topology)
    found = topology.prune(spark.read.parquet(f"file://{tmp_path}/t"), [7])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PartitionFilters: [" in plan and "_shard#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_log_tables_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), "INFO", "m") for d in range(1, 6)], "ts timestamp_ntz, level string, message string")
    logs.append(df, f"file://{tmp_path}/log")
    logs.append(df.limit(1), f"file://{tmp_path}/log")
    found = logs.read(spark, f"file://{tmp_path}/log", dt.date(2024, 1, 4), dt.date(2024, 1, 9))
    assert found.count() == 2 and "log_date" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert logs.read(spark, f"file://{tmp_path}/log").count() == 6
    assert listed(logs.roll(df, "month").select("_partition").distinct()) == [("202401",)]


def test_streams(spark, tmp_path):
    """Sessions and first sights of keys, over a stream in two parts."""
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(minutes=m)) for k, m in ((1, 0), (1, 10), (1, 90), (2, 5), (1, 10), (9, 600))]
    spark.createDataFrame(rows, "k int, ts timestamp_ntz").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")

    def run(made, name, mode):
        got = []
        stream = spark.readStream.schema("k int, ts timestamp").parquet(f"{tmp_path}/in")
        made(stream).writeStream.foreachBatch(lambda batch, n: got.extend(batch.collect())).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return got

    seen = run(lambda s: streams.sessions(s, "k"), "sessions", "append")
    assert sorted((r["k"], r["total"]) for r in seen if r["k"] != 9) == [(1, 1), (1, 3), (2, 1)]
    assert sorted(r["k"] for r in run(lambda s: streams.first_seen(s, ["k"]), "first", "append")) == [1, 2, 9]
    slid = run(lambda s: streams.log_windows(s.withColumn("level", F.lit("ERROR")), 600, slide=300), "slide", "append")
    assert sum(r["total"] for r in slid) == sum(r["errors"] for r in slid) >= 10


def test_sources(spark, tmp_path):
    """Files, a database on disk and the catalog behind one interface."""
    df = spark.range(100).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    df.write.parquet(f"file://{tmp_path}/files/people.parquet")
    files = registry.open_source(spark, f"parquet:file://{tmp_path}/files")
    assert files.tables() == ["people"] and files.read("people").count() == 100
    assert registry.table_sizes(spark, f"file://{tmp_path}/files").first()["bytes"] > 0
    db = registry.JdbcSource(spark, "derby", {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    db.write(df, "PEOPLE", "overwrite")
    db.write(df.where("id < 10"), "PEOPLE")
    assert db.tables() == ["PEOPLE"]
    read = db.read("PEOPLE", "id", 0, 100, 4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 110 and db.query("SELECT * FROM PEOPLE WHERE \"id\" = 3").count() == 2
    gone = registry.JdbcSource(spark, "derby", {"url": f"jdbc:derby:{tmp_path}/none", "driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    held = registry.Registry()
    for name, source in (("files", files), ("db", db), ("gone", gone)):
        held.register(name, source)
    assert held.names() == ["db", "files", "gone"] and held.healthy() == {"files": True, "db": True, "gone": False}
    del held.sources["gone"]
    both = held.on_all(lambda s: s.read(s.tables()[0]).groupBy().count())
    assert listed(both.select("_source", "count")) == [("db", 110), ("files", 100)]
    spark.sql("DROP TABLE IF EXISTS kept")
    df.where("id < 0").write.saveAsTable("kept")
    df.createOrReplaceTempView("people")
    assert snapshots.run_transfer(spark, "SELECT * FROM people WHERE id < 7", "kept") == 7
    catalog = registry.open_source(spark, "catalog:default")
    assert "kept" in catalog.tables() and catalog.read("kept").count() == 7
    spark.sql("DROP TABLE kept")


def test_addresses_go_round():
    for text in ("mysql://u:p%40ss@h:3307/d", "oracle://h:1521/x", "sqlite:/tmp/a.db"):
        a = registry.Address.parse(text)
        assert registry.Address.parse(a.text()) == a
    assert registry.Address.parse("oracle://u:p@h/x").jdbc()["url"] == "jdbc:oracle:thin:@//h:1521/x"


def test_catalog(spark):
    registry.create_view(spark, "few", "SELECT 1 AS x")
    registry.rename_view(spark, "few", "fewer")
    assert ("fewer", True) in listed(registry.views(spark)) and registry.drop_view(spark, "fewer") and not registry.drop_view(spark, "few")
    registry.create_function(spark, "twice", "x INT", "INT", "x * 2")
    assert spark.sql("SELECT twice(4)").first()[0] == 8 and any("twice" in f for f in registry.functions(spark))
    registry.drop_function(spark, "twice")
    assert registry.identity(spark).first()["database"] == "default"


def test_profiles(spark, tmp_path):
    spark.range(50).write.parquet(f"file://{tmp_path}/p")
    spark.read.parquet(f"file://{tmp_path}/p").createOrReplaceTempView("numbers")
    df, p = advisor.run_and_profile(spark, "SELECT * FROM numbers")
    assert (p.statement_class, p.table, p.rows, len(p.unfiltered_scans)) == ("select", "numbers", 50, 1) and "select_star" in p.lint and df.count() == 50
    assert advisor.unfiltered_scans(spark.table("numbers").where("id > 3")) == []


def test_versions_and_suggestions():
    f = values.Field
    up = schema_map.upgrade_type
    assert [up("DATETIME", "mysql", (5, 7, 0), (8, 0, 0)), up("TINYINT(1)", "mysql", (5, 7, 0), (8, 0, 0)), up("DATETIME", "mysql", (8, 0, 0), (8, 0, 0))] == ["DATETIME(6)", "BOOLEAN", "DATETIME"]
    assert [up("BIGSERIAL", "postgresql", (9, 6, 0), (16, 0, 0)), up("JSON", "sqlite", (3, 30, 0), (3, 45, 0))] == ["BIGINT GENERATED BY DEFAULT AS IDENTITY", "JSONB"]
    assert schema_map.compatible_type("TEXT", "postgresql", (13, 0, 0)) == "VARCHAR" and schema_map.compatible_statement("SELECT 1", "mysql", (5, 7, 0)).startswith("/* mysql before 8")
    assert schema_map.compatible_statement("SELECT 1", "mysql", (8, 0, 0)) == "SELECT 1"
    moved = schema_map.migrate_table("orders", [f("id", "INT"), f("amount", "DECIMAL(10,2)"), f("created_at", "DATETIME"), f("data", "JSON")], "mysql", "postgresql", "5.7.40", "16.2.0")
    assert [x.data_type for x in moved.fields] == ["INTEGER", "NUMERIC(10,2)", "TIMESTAMP", "JSONB"] and not moved.unmapped
    same = schema_map.migrate_table("t", [f("at", "DATETIME")], "mysql", "mysql", "5.7.40", "8.0.32")
    assert same.fields[0].data_type == "DATETIME(6)"
    a, b = [f("id", "int"), f("user_name", "varchar"), f("x", "json")], [f("id", "int"), f("username", "varchar")]
    assert schema_map.auto_mappings(a, b) == {"id": "id", "user_name": "username"}
    assert schema_map.mappings_of(schema_map.link_fields(a, b)) == {"id": "id", "user_name": "username"}
    assert schema_map.mapping_faults({"": "x"}, "s", " ") == ["the target table is blank", "the source field is blank"]
    kinds = [(s.kind, s.field) for s in schema_map.suggestions(a, b, "redis")]
    assert ("structure", "") in kinds and ("missing_field", "x") in kinds
    assert schema_map.store_kind("InfluxDB") == "time_series" and not schema_map.supports_sql("mongodb")


def test_types_of_every_path():
    types = schema_map.TypeTable()
    for (a, b), rows in schema_map.PATHS.items():
        for r in rows:
            found = types.lookup(r[0], a, b)
            assert (found.target_type, found.lossy) == (r[1], len(r) > 2) or r[0] == "TINYINT(1)"
    assert types.lookup("LONG RAW", "oracle", "postgresql").target_type == "BYTEA" and types.lookup("XMLTYPE", "oracle", "sqlite").target_type == "TEXT"
    assert types.lookup("BIT(1)", "mysql", "postgresql").lossy and types.lookup("VARCHAR(70)", "postgresql", "mysql").target_type == "VARCHAR(70)"
    types.add("mysql", "hstore", "postgresql", "HSTORE")
    assert types.lookup("HSTORE", "mysql", "postgresql").target_type == "HSTORE" and schema_map.built_in_types().lookup("HSTORE", "mysql", "postgresql") is None


def test_statement_texts():
    m = {"a": "x", "b": "y"}
    assert builder.insert_select(m, "s", "t") == "INSERT INTO t (x, y) SELECT s.a, s.b FROM s"
    assert builder.transfer_script({("s", "t"): m}, "dollar") == ["SELECT a, b FROM s", "INSERT INTO t (x, y) VALUES ($1, $2)"]
    assert builder.linked_statement([("a", "x", "o'k"), ("b", "y", None)], "t", "update") == "UPDATE t SET x = 'o''k', y = NULL"
    assert builder.linked_statement([], "t", "insert") == "" and builder.linked_statement([("a", "x", 1)], "t", "INSERT") == "INSERT INTO t (x) VALUES (?)"
    with pytest.raises(ValueError):
        builder.linked_statement([], "t", "merge")
    assert builder.update_text("t", ["a"], ["k"], "at") == "UPDATE t SET a = @p1 WHERE k = @p2" and builder.delete_text("t", ["k", "j"]) == "DELETE FROM t WHERE k = ? AND j = ?"
    assert builder.create_text("t", {"a": "INT"}) == "CREATE TABLE IF NOT EXISTS t (a INT)" and builder.drop_text("t", False) == "DROP TABLE t"
    assert schema_map.create_index("i", "t", ["a"], "mysql", True) == "CREATE UNIQUE INDEX `i` ON `t` (`a`)"
    assert adapters.interval_seconds("2h") == 7200 and adapters.interval_text(86_400) == "1d" and adapters.interval_text(5400) == "90m"
    assert "create_hypertable('m', 'ts'" in adapters.hypertable_statements("m", "ts", {"v": "DOUBLE PRECISION"})[1]


def test_written_points_and_buckets(spark, tmp_path):
    lines = spark.createDataFrame([("m v=1 1",), ("m v=2 2",)], "line string")
    adapters.write_points(lines, f"file://{tmp_path}/points")
    assert listed(spark.read.text(f"file://{tmp_path}/points")) == listed(lines)
    buckets = {r[0] for r in spark.range(200).select(hashing.bucket(F.col("id"), 7)).collect()}
    assert buckets == set(range(7))


def test_marks_and_change_logs(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    for mark in (at, 17, "b", dt.date(2024, 5, 6), 1.5, decimal.Decimal("3.25"), True, at.replace(tzinfo=dt.timezone.utc)):
        sync.save_mark(spark, f"file://{tmp_path}/mark", mark)
        got = sync.load_mark(spark, f"file://{tmp_path}/mark")
        assert got == (mark.replace(tzinfo=None) if getattr(mark, "tzinfo", None) else mark)
    # A write that died half-way is not a mark.
    (tmp_path / "mark" / "mark-9999999999").mkdir()
    assert sync.load_mark(spark, f"file://{tmp_path}/mark") == at
    assert sync.load_mark(spark, f"file://{tmp_path}/none") is None
    s = spark.createDataFrame([(1, "a"), (2, "new"), (None, "n")], "k int, v string")
    t = spark.createDataFrame([(1, "a"), (2, "old"), (3, None)], "k int, v string")
    got = sync.change_log(s, t, ["k"]).collect()
    assert sorted((r["operation"], r["k"], r["before"], r["after"]) for r in got if r["k"]) == [("delete", 3, '{"k":3,"v":null}', None), ("update", 2, '{"k":2,"v":"old"}', '{"k":2,"v":"new"}')]
    assert [r["operation"] for r in got if r["k"] is None] == ["insert"]
    made = schema_map.empty_frame(spark, [values.Field("id", "BIGINT", nullable=False), values.Field("x", "DECIMAL(9,2)")])
    assert made.dtypes == [("id", "bigint"), ("x", "decimal(9,2)")] and made.count() == 0


def test_outer_joins_keep_their_keys(spark):
    a = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 0, "n")], "k int, v int, w string")
    b = spark.createDataFrame([(2, "B", 7), (3, "C", 8), (None, "N", 9)], "k int, w string, x int")
    ab = lambda how, **kw: sorted([tuple(r) for r in fusion.hash_join(a, b, "k", "k", how, **kw).select("k", "v", "w", "x").collect()], key=repr)
    assert ab("left") == sorted([(1, 10, "a", None), (2, 20, "B", 7), (None, 0, "n", None)], key=repr)
    assert ab("right") == sorted([(2, 20, "B", 7), (3, None, "C", 8), (None, None, "N", 9)], key=repr)
    assert ab("full") == sorted([(1, 10, "a", None), (2, 20, "B", 7), (3, None, "C", 8), (None, 0, "n", None), (None, None, "N", 9)], key=repr)
    assert ab("full", null_safe=True) == sorted([(1, 10, "a", None), (2, 20, "B", 7), (3, None, "C", 8), (None, 0, "N", 9)], key=repr)
    c = b.withColumnRenamed("k", "j")
    assert fusion.hash_join(a, c, "k", "j").columns == ["k", "v", "w", "x"] == fusion.merge_join(a, c, "k", "j", "left").columns
    assert sorted([(r["k"], r["j"]) for r in fusion.hash_join(a, c, "k", "j", "full").collect()], key=repr) == sorted([(1, None), (2, 2), (None, 3), (None, None), (None, None)], key=repr)
    assert sorted([(r["k"], r["j"]) for r in fusion.merge_join(a, c, "k", "j", "right").collect()], key=repr) == sorted([(2, 2), (None, 3), (None, None)], key=repr)
    assert sorted(r["k"] for r in fusion.hash_join(a, a, "k", "k", "full").collect() if r["k"]) == [1, 2]
    assert [tuple(r) for r in fusion.hash_join(a, c, "k", "j", "left_semi").collect()] == [(2, 20, "b")]


def test_columns_without_an_order_are_paired(spark):
    """Maps: repeated keys, diff, change log, upsert; and plans that send each side once."""
    s = spark.createDataFrame([(1, {"a": 1}, 5), (1, {"a": 2}, 6), (2, {"b": 1}, 1), (None, {"n": 1}, 1)], "k int, m map<string,int>, v int")
    t = spark.createDataFrame([(1, {"a": 1}, 6), (3, {"c": 1}, 1), (None, {"n": 2}, 1)], "k int, m map<string,int>, v int")
    rules = compare.Rules(key=("k",), latest="v")
    assert sorted([(r["k"], r["field"]) for r in compare.field_differences(s, t, rules).collect()], key=repr) == [(1, "m"), (None, "m")]
    stats = compare.statistics(s, t, rules).first()
    assert (stats["source_rows"], stats["target_rows"], stats["matched_rows"], stats["diff_fields"], stats["missing_in_target"], stats["missing_in_source"]) == (3, 3, 2, 2, 1, 1)
    assert sorted([(r["operation"], r["k"]) for r in sync.change_log(s, t, ["k"], "v").collect()], key=repr) == [("delete", 3), ("insert", 2), ("update", 1), ("update", None)]
    assert sorted([(r["k"], r["m"]) for r in sync.upsert(s, t, ["k"], "update", "v").collect()], key=repr) == [(1, {"a": 2}), (2, {"b": 1}), (3, {"c": 1}), (None, {"n": 1})]
    for df in (compare.statistics(s, t, compare.Rules(key=("k",))), sync.change_log(s, t, ["k"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning") <= 1 and "Join" not in plan


def test_profiles_time_all_columns(spark):
    """A column that fails shows that no column was pruned."""
    with pytest.raises(Exception, match="seen"):
        advisor.run_and_profile(spark, "SELECT id, raise_error('seen') AS x FROM range(3)")
    df, p = advisor.run_and_profile(spark, "SELECT id, id + 1 AS x FROM range(30)")
    assert p.rows == 30 == df.count()


def test_changes_of_a_table(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", None), (None, "d", 4)], "k int, s string, v int")
    ch = builder.Change()
    assert listed(ch.where("v > 1").update(t, v="v * 10", s=F.lit("z"))) == sorted([(1, "a", 1), (2, "z", 20), (3, "c", None), (None, "z", 40)], key=repr)
    assert listed(ch.where("s <> 'a'").where("v is not null").delete(t)) == sorted([(1, "a", 1), (2, None, 2), (3, "c", None)], key=repr)
    assert ch.where("s <> 'a'").count(t).first()[0] == 2 and ch.delete(t).count() == 0 and listed(ch.update(t, k="v", v="k")) == sorted([(1, "a", 1), (2, None, 2), (None, "c", 3), (4, "d", None)], key=repr)
    other = spark.createDataFrame([(1, 100), (3, 300), (None, 9)], "id int, w int")
    use = ch.using(other.withColumnRenamed("id", "k"), ["k"], {"w": "extra"})
    assert listed(use.update(t, v="extra + coalesce(v, 0)")) == sorted([(1, "a", 101), (2, None, 2), (3, "c", 300), (None, "d", 4)], key=repr)
    assert listed(use.where("extra > 100").delete(t).select("k")) == sorted([(1,), (2,), (None,)], key=repr)
    assert listed(ch.insert(t, spark.createDataFrame([(7,)], "k long"), {"s": "new"}).where("k = 7")) == [(7, "new", None)]
    for bad in (lambda: ch.insert(t, t.withColumn("q", F.lit(1))), lambda: ch.update(t, q="1")):
        with pytest.raises(ValueError):
            bad()


def test_ring_lookup_is_the_first_point_at_or_after(spark):
    nodes = [f"n{k}" for k in range(37)]
    points = sorted((r[0], n) for n in nodes for r in spark.range(64).select(F.xxhash64(F.concat(F.lit(f"{n}#"), F.col("id").cast("string")))).collect())
    keys = spark.range(3000).select(F.col("id").alias("k"), F.xxhash64(F.col("id").cast("string")).alias("h"), sharding.ring_node(F.col("id"), nodes).alias("n")).collect()
    for r in keys:
        assert r["n"] == next((n for h, n in points if h >= r["h"]), points[0][1])
    for few in (["a"], ["a", "b"]):
        got = {r[0] for r in spark.range(200).select(sharding.ring_node(F.col("id"), few, 1)).collect()}
        assert got <= set(few) and got


def test_catalog_statements_run_in_databases():
    """The statements for SQLite in SQLite, and those for MySQL and PostgreSQL in an engine with the same catalog."""
    import sqlite3

    import duckdb

    lite, duck = sqlite3.connect(":memory:"), duckdb.connect()
    duck.execute("CREATE MACRO database() AS current_schema()")
    for db in (lite, duck):
        db.execute("CREATE TABLE t1 (x INT)")
        db.execute("CREATE TABLE t2 (x INT)")
        db.execute("CREATE VIEW v AS SELECT * FROM t1")
    assert sorted(lite.execute(registry.TABLE_LISTS["sqlite"]).fetchall()) == [("t1",), ("t2",)]
    for kind in ("mysql", "mariadb", "postgresql"):
        assert sorted(duck.execute(registry.TABLE_LISTS[kind]).fetchall()) == [("t1",), ("t2",)]


def test_converters_of_any_shape(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    key = adapters.key_text("t:{id}", id=F.col("id"))
    made = adapters.converted(df, {
        "json": adapters.key_value_converter("json", key, {"s": "name"}), "hash": adapters.key_value_converter("hash", key, {"s": "name"}),
        "graph": lambda d: d.select(F.col("id").alias("node"), F.lit("has").alias("edge")),
    })
    assert made.columns == ["shape", "key", "value", "field", "node", "edge"]
    assert sorted((r["shape"], r["key"], r["field"], r["node"]) for r in made.where("shape <> 'graph'").collect()) == [("hash", "t:1", "name", None), ("json", "t:1", None, None), ("json", "t:2", None, None)]
    assert sorted(r["node"] for r in made.where("shape = 'graph'").collect()) == [1, 2]


def test_view_texts_and_rewrites(spark):
    spark.sql("CREATE OR REPLACE VIEW kept_view AS SELECT 1 AS one, 2 AS two")
    try:
        assert {r["name"]: r["text"] for r in registry.view_texts(spark).collect()}["kept_view"] == "SELECT 1 AS one, 2 AS two"
    finally:
        spark.sql("DROP VIEW kept_view")
    sqls = ["SELECT a FROM t", "select a from t order by a;", "SELECT a FROM t LIMIT 5", "SELECT count(*) FROM t", "UPDATE t SET a = 1", None]
    got = [r[0] for r in spark.createDataFrame([(s, k) for k, s in enumerate(sqls)], "s string, k int").orderBy("k").select(advisor.suggested_rewrite(F.col("s"))).collect()]
    assert got == ["SELECT a FROM t LIMIT 100", "select a from t order by a LIMIT 1000", None, None, None, None]


def test_numbers_of_rows_alike(spark):
    """Rows alike in group and order are numbered apart, and spread over partitions."""
    from shardloom.operators.ordering import number_in_groups

    df = spark.range(2000).select(F.lit("g").alias("g"), F.lit(1).alias("o"), F.col("id"))
    out = number_in_groups(df, ["g"], ["o"])
    assert sorted(r["row_number"] for r in out.collect()) == list(range(2000))
