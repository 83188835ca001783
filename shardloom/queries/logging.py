"""Log analytics on events, and advice from a query log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import logs
from ..plans import advisor
from ..shared import shared_folder
from ..streaming import streams
from . import query

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END"
_LOGS = f"(SELECT event_id, ts, {_LEVEL} AS level, event_type || ' by ' || user_id AS message FROM events)"


def _logs(t):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    return t.events.select("event_id", "ts", level.alias("level"), F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("message"))


@query(f"SELECT level, CAST(count(*) AS BIGINT) AS count FROM {_LOGS} GROUP BY 1")
def log_level_counts(t):
    return logs.level_counts(_logs(t))


_WINDOWS = f"""SELECT w AS window_start, w + 299 AS window_end, CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN level = 'ERROR' THEN 1 END) AS BIGINT) AS errors,
    CAST(count(CASE WHEN level = 'WARN' THEN 1 END) AS BIGINT) AS warnings FROM (SELECT CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS w, level FROM {_LOGS}) GROUP BY w"""


@query(_WINDOWS)
def log_windows_300s(t):
    return logs.windows(_logs(t), 300)


@query(f"SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS window_start, level, CAST(count(*) AS BIGINT) AS count FROM {_LOGS} GROUP BY 1, 2")
def log_window_levels(t):
    return logs.window_levels(_logs(t), 3600)


@query(f"SELECT * FROM ({_WINDOWS}) WHERE errors >= 2")
def log_error_spikes(t):
    return logs.error_spikes(_logs(t), 2, 300)


@query(f"SELECT round(avg(CASE WHEN level = 'ERROR' THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM {_LOGS}")
def log_error_rate(t):
    return logs.error_rate(_logs(t)).select(F.round("error_rate", 9).alias("error_rate"))


@query(f"""SELECT * FROM {_LOGS} WHERE level IN ('ERROR', 'WARN') AND message LIKE '%by 1%' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def log_query(t):
    return logs.matching(_logs(t), ["ERROR", "WARN"], "by 1", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))


@query(f"SELECT * FROM {_LOGS} WHERE level = 'ERROR' ORDER BY ts, event_id LIMIT 50 OFFSET 20")
def log_query_page(t):
    return logs.matching(_logs(t), ["ERROR"]).orderBy("ts", "event_id").offset(20).limit(50)


@query(f"SELECT event_id FROM {_LOGS} WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def log_retained(t):
    return logs.retained(_logs(t), dt.datetime(2024, 1, 31), 7).select("event_id")


@query(f"SELECT event_id FROM {_LOGS} WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def log_expired(t):
    return logs.expired(_logs(t), dt.datetime(2024, 1, 31), 7).select("event_id")


@query("""SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y%m') AS month, strftime(ts, '%Y%m%d%H') AS hour FROM events""")
def log_partition_suffix(t):
    return t.events.select("event_id", *[logs.partition_suffix(F.col("ts"), u).alias(u) for u in ("day", "week", "month", "hour")])


@query(f"""SELECT strftime(ts, '%Y%m%d') AS partition, CAST(count(*) AS BIGINT) AS rows, round(avg(length(message)), 6) AS avg_length FROM {_LOGS} GROUP BY 1""")
def log_partition_stats(t):
    return logs.partition_stats(_logs(t)).withColumn("avg_length", F.round("avg_length", 6))


@query("""SELECT CAST(count(*) AS BIGINT) AS partitions, CAST(sum(n) AS BIGINT) AS rows, round(sum(CAST(n AS DOUBLE)) / 1024, 6) AS size_gb, CAST(min(d) AS VARCHAR) AS oldest, CAST(max(d) AS VARCHAR) AS newest,
    round(avg(CASE WHEN n > 100 THEN 1.0 ELSE 0.0 END), 9) AS compressed_share FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)""")
def log_registry_stats(t):
    days = t.events.groupBy(F.to_date("ts").alias("start_date")).agg(F.count("*").alias("row_count"))
    registry = days.withColumn("size_mb", F.col("row_count").cast("double")).withColumn("compressed", F.col("row_count") > 100)
    out = logs.registry_stats(registry).withColumn("compressed_share", F.round("compressed_share", 9))
    return out.withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query(f"SELECT window_start, total, errors FROM ({_WINDOWS})")
def streaming_log_windows(t):
    """The windows by Structured Streaming over all events, in one run through what is there. Each micro-batch writes the
    windows it has changed into the shared folder; a window's last version counts. State goes with the watermark."""
    spark, out = t.spark, shared_folder(t.spark)
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    source = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    stream = source.select(F.col("ts").cast("timestamp").alias("ts"), level.alias("level"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/windows/{number}")

    started = (
        streams.log_windows(stream, 300).writeStream.foreachBatch(keep).outputMode("update")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    written = spark.read.schema("window_start long, total long, errors long, batch long").option("recursiveFileLookup", "true").parquet(f"{out}/windows")
    last = written.groupBy("window_start").agg(F.max(F.struct("batch", "total", "errors")).alias("w"))
    return last.select("window_start", "w.total", "w.errors")


_SQLS = """CASE event_type WHEN 'error' THEN 'SELECT * FROM events_' || (user_id % 5) WHEN 'click' THEN 'SELECT id FROM clicks WHERE user_id = ' || user_id || ' and kind = 1 ORDER BY ts'
    WHEN 'view' THEN 'SELECT a.id FROM views a JOIN users u ON a.user_id = u.id JOIN pages p ON p.id = a.page_id WHERE u.name LIKE ''%x'' OR u.id NOT IN (1, 2) GROUP BY a.id'
    WHEN 'purchase' THEN 'INSERT INTO purchases VALUES (' || user_id || ')' ELSE 'SELECT COUNT(*) FROM signups' END"""
_LOG = f"(SELECT event_id AS query_id, {_SQLS} AS sql, 'table_' || (user_id % 9) AS table_name, CAST(abs(value) * 20 AS BIGINT) AS execution_ms FROM events)"


def _query_log(t):
    return t.events.select(
        F.col("event_id").alias("query_id"), F.expr(_SQLS).alias("sql"), F.concat(F.lit("table_"), (F.col("user_id") % 9).cast("string")).alias("table_name"),
        F.round(F.abs("value") * 20).cast("long").alias("execution_ms"),
    )


@query(f"""SELECT query_id, CASE WHEN sql LIKE 'SELECT%' THEN 'select' ELSE 'insert' END AS class,
    CASE WHEN sql LIKE 'INSERT%' THEN 'purchases' WHEN sql LIKE '%FROM views%' THEN 'views' WHEN sql LIKE '%clicks%' THEN 'clicks' WHEN sql LIKE '%signups%' THEN 'signups'
      ELSE regexp_extract(lower(sql), 'from ([a-z_0-9]+)', 1) END AS table_name,
    CASE WHEN sql LIKE '%JOIN%' THEN 'complex' ELSE 'simple' END AS complexity FROM {_LOG}""")
def sql_classify(t):
    s = F.col("sql")
    return _query_log(t).select("query_id", advisor.statement_class(s).alias("class"), advisor.table_name(s).alias("table_name"), advisor.complexity(s).alias("complexity"))


@query(f"""SELECT query_id, concat_ws(',', CASE WHEN contains(s, 'select *') THEN 'select_star' END, CASE WHEN contains(s, ' like ''%') THEN 'like_prefix' END,
    CASE WHEN contains(s, ' or ') AND contains(s, ' where ') THEN 'or_condition' END, CASE WHEN contains(s, ' order by ') AND NOT contains(s, ' limit ') THEN 'order_without_limit' END,
    CASE WHEN contains(s, ' from ') AND NOT contains(s, ' where ') THEN 'no_where' END, CASE WHEN contains(s, 'not in') OR contains(s, 'not exists') THEN 'not_in' END,
    CASE WHEN contains(s, 'count(*)') AND contains(s, ' from ') AND NOT contains(s, ' where ') THEN 'count_star' END) AS findings FROM (SELECT query_id, lower(sql) AS s FROM {_LOG})""")
def sql_lint(t):
    return _query_log(t).select("query_id", F.concat_ws(",", advisor.lint(F.col("sql"))).alias("findings"))


@query(f"""SELECT DISTINCT suggestion FROM (SELECT unnest(['CREATE INDEX idx_clicks_user_id ON clicks (user_id)', 'CREATE INDEX idx_clicks_kind ON clicks (kind)']) AS suggestion FROM events WHERE event_type = 'click')""")
def sql_index_suggestions(t):
    clicks = _query_log(t).where("sql like '%clicks%'")
    return clicks.select(F.explode(advisor.index_suggestions(F.col("sql"))).alias("suggestion")).distinct()


_BY_TABLE = f"""SELECT table_name, CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN execution_ms > 1000 THEN 1 END) AS BIGINT) AS slow,
    round(count(CASE WHEN execution_ms > 1000 THEN 1 END) / count(*), 6) AS ratio FROM {_LOG} GROUP BY 1"""


@query(_BY_TABLE)
def slow_ratio(t):
    return advisor.slow_by_table(_query_log(t))


@query(f"SELECT * FROM ({_BY_TABLE}) WHERE total > 10 AND slow >= 0.1 * total")
def slow_attention(t):
    return advisor.needing_attention(_query_log(t))


@query(f"SELECT CAST(count(*) AS BIGINT) AS slow, CAST(coalesce(floor(avg(execution_ms)), 0) AS BIGINT) AS avg_ms, CAST(count(DISTINCT table_name) AS BIGINT) AS tables FROM {_LOG} WHERE execution_ms > 1000")
def slow_report(t):
    return advisor.slow_summary(_query_log(t))


@query(f"SELECT query_id, execution_ms FROM {_LOG} WHERE execution_ms > 1000 ORDER BY execution_ms DESC, query_id LIMIT 10")
def slow_top_k(t):
    return advisor.slowest(_query_log(t), 10).select("query_id", "execution_ms")


@query("""SELECT p_partkey, CASE WHEN p_retailprice > 1024 THEN 'critical' WHEN p_size * 1000000 > 10000000 OR p_retailprice > p_size * 1000000 * 10 THEN 'warning' ELSE 'healthy' END AS health FROM part""")
def table_health(t):
    return t.part.select("p_partkey", advisor.health(F.col("p_size") * 1_000_000, F.col("p_retailprice")).alias("health"))


@query("""SELECT user_id, CAST(n AS BIGINT) AS events, event_type AS last_type FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def final_state_by_key(t):
    """The last state of each key in an event log, as of a coordinator's transactions."""
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")
    return t.events.groupBy("user_id").agg(F.count("*").alias("events"), last)


@query(f"""WITH m AS (SELECT * FROM {_LOGS} WHERE level IN ('ERROR', 'WARN') AND ts >= TIMESTAMP '2024-01-05')
    SELECT 'total' AS kind, '' AS name, CAST(count(*) AS BIGINT) AS count FROM m HAVING count(*) > 0 UNION ALL SELECT 'level', level, count(*) FROM m GROUP BY level
    UNION ALL SELECT 'window', CAST(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS VARCHAR), count(*) FROM m GROUP BY 2""")
def log_report(t):
    return logs.matching_report(_logs(t), 300, levels=["ERROR", "WARN"], start=dt.datetime(2024, 1, 5))


_ROLLED = f"""SELECT strftime(ts, '%Y%m%d') || '_p' || CAST(before // 2000 AS VARCHAR) AS partition, ts, message FROM (SELECT ts, message,
    CAST(coalesce(sum(strlen(message)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {_LOGS})"""


@query(f"""SELECT partition, CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(strlen(message)) AS BIGINT) AS size_bytes,
    partition = (SELECT partition FROM ({_ROLLED}) ORDER BY ts DESC, partition DESC LIMIT 1) AS is_active FROM ({_ROLLED}) GROUP BY 1""")
def log_rolled_by_size(t):
    """Day partitions, each cut anew after 2000 bytes of messages, and their registry."""
    return logs.partition_registry(logs.roll(_logs(t), "day", max_bytes=2000, order=("ts", "event_id")))


@query(f"SELECT strftime(ts, '%Y%m') || '_p' || CAST((row_number() OVER (PARTITION BY strftime(ts, '%Y%m') ORDER BY ts, event_id) - 1) // 1500 AS VARCHAR) AS _partition, event_id FROM {_LOGS}")
def log_rolled_by_rows(t):
    return logs.roll(_logs(t), "month", max_rows=1500, order=("ts", "event_id")).select("_partition", "event_id")


@query(f"""SELECT CASE WHEN sql LIKE 'SELECT%' THEN 'SELECT' ELSE 'INSERT' END AS class, CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN execution_ms > 1000 THEN 1 END) AS BIGINT) AS slow,
    CAST(count(CASE WHEN query_id % 10 = 0 THEN 1 END) AS BIGINT) AS failed, CAST(floor(avg(execution_ms)) AS BIGINT) AS avg_ms FROM {_LOG} GROUP BY 1""")
def query_class_metrics(t):
    return advisor.class_metrics(_query_log(t).withColumn("failed", F.col("query_id") % 10 == 0))


@query(f"SELECT query_id, ts, execution_ms FROM (SELECT l.*, e.ts FROM {_LOG} l JOIN events e ON e.event_id = l.query_id) WHERE execution_ms > 1000 ORDER BY ts DESC, query_id DESC LIMIT 10")
def slow_newest(t):
    log = _query_log(t).join(t.events.select(F.col("event_id").alias("query_id"), "ts"), "query_id")
    return advisor.newest_slow(log).select("query_id", "ts", "execution_ms")


@query(f"SELECT query_id, execution_ms FROM {_LOG} WHERE table_name = 'table_3'")
def slow_of_table(t):
    return advisor.of_table(_query_log(t), "table_3").select("query_id", "execution_ms")


@query(f"""SELECT query_id, suggestion FROM (SELECT query_id, unnest(CASE WHEN sql LIKE '%clicks%' THEN ['CREATE INDEX idx_clicks_user_id ON clicks (user_id)', 'CREATE INDEX idx_clicks_kind ON clicks (kind)'] ELSE [] END) AS suggestion FROM {_LOG})""")
def index_suggestions_by_query(t):
    """Over the whole log, whatever its statements."""
    return _query_log(t).select("query_id", F.explode(advisor.index_suggestions(F.col("sql"))).alias("suggestion"))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 1 DAY")
def sessions_expired(t):
    sessions = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return logs.expired_sessions(sessions, dt.datetime(2024, 1, 31), 86_400)
