"""Rows for key-value, document and time-series stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adapters
from . import query

_NAMES = {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}


def _key(name="c_custkey"):
    return adapters.key_text("db:customer:{pk}", pk=F.col(name))


@query("""SELECT 'db:customer:' || c_custkey AS key, '{"id":' || c_custkey || ',"name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS value FROM customer""")
def kv_json(t):
    rows = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return adapters.json_values(rows, _key(), _NAMES)


@query("""SELECT 'db:customer:' || c_custkey AS key, f.field, CASE f.field WHEN 'id' THEN CAST(c_custkey AS VARCHAR) WHEN 'name' THEN c_name ELSE c_mktsegment END AS value
    FROM customer, (VALUES ('id'), ('name'), ('segment')) AS f(field)""")
def kv_hash(t):
    return adapters.hash_fields(t.customer, _key(), _NAMES)


@query("""SELECT 'db:customer:' || c_custkey || ':' || f.field AS key, CASE f.field WHEN 'id' THEN CAST(c_custkey AS VARCHAR) WHEN 'name' THEN c_name ELSE c_mktsegment END AS value
    FROM customer, (VALUES ('id'), ('name'), ('segment')) AS f(field)""")
def kv_separate(t):
    return adapters.separate_keys(t.customer, _key(), _NAMES)


@query("""SELECT '*3' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'SET' || chr(13) || chr(10) || '$' || strlen('k' || c_custkey) || chr(13) || chr(10) || 'k' || c_custkey || chr(13) || chr(10)
    || '$' || strlen(c_name) || chr(13) || chr(10) || c_name || chr(13) || chr(10) AS wire FROM customer""")
def kv_wire(t):
    commands = t.customer.select(F.lit("SET").alias("op"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("k"), "c_name")
    return adapters.wire_commands(commands, ["op", "k", "c_name"])


@query("""SELECT '{"_id":' || s_suppkey || ',"data":{"name":"' || s_name || '","nation":' || s_nationkey || '},"source":"supplier"}' AS doc FROM supplier""")
def document_store(t):
    return adapters.documents(t.supplier, "s_suppkey", {"s_name": "name", "s_nationkey": "nation"}, {"source": F.lit("supplier")})


@query("""SELECT 'events,event_type=' || event_type || ',user=u\\ ' || user_id || ' id=' || event_id || 'i,kind="' || event_type || '" ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line FROM events""")
def line_protocol(t):
    rows = t.events.select("ts", "event_type", F.concat(F.lit("u "), F.col("user_id").cast("string")).alias("user"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return adapters.line_protocol(rows, "events", ["user", "event_type"], ["kind", "id"], F.unix_micros(F.col("ts").cast("timestamp")) * 1000)


@query("""SELECT 'events' AS measurement, CAST(epoch_us(ts) * 1000 AS BIGINT) AS time, 'event_type=' || event_type || ',user_id=' || user_id AS tag_text, m.metric,
    round(CASE m.metric WHEN 'value' THEN value ELSE CAST(event_id AS DOUBLE) END, 6) AS value FROM events, (VALUES ('value'), ('event_id')) AS m(metric)""")
def time_series_points(t):
    out = adapters.points(t.events, "events", ["user_id", "event_type"], ["value", "event_id"], F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return out.withColumn("value", F.round("value", 6))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT 'json' AS shape, 'db:customer:' || c_custkey AS key, NULL AS field, '{"id":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS value FROM customer
    UNION ALL SELECT 'hash', 'db:customer:' || c_custkey, f.field, CASE f.field WHEN 'id' THEN CAST(c_custkey AS VARCHAR) WHEN 'name' THEN c_name ELSE c_mktsegment END FROM customer, (VALUES ('id'), ('name'), ('segment')) AS f(field)
    UNION ALL SELECT 'separate', 'db:customer:' || c_custkey || ':' || f.field, NULL, CASE f.field WHEN 'id' THEN CAST(c_custkey AS VARCHAR) WHEN 'name' THEN c_name ELSE c_mktsegment END FROM customer, (VALUES ('id'), ('name'), ('segment')) AS f(field)""")
def kv_all_shapes(t):
    return adapters.key_values(t.customer, ("json", "hash", "separate"), _key(), _NAMES)


@query("""SELECT 'INSERT INTO sensors (field user_id=' || user_id || ') TAGS (tag event_type=''' || event_type || ''') VALUES (ts) ' || CAST(floor(epoch(ts)) AS BIGINT) AS statement FROM events""")
def point_statements(t):
    return adapters.point_statements(t.events, "sensors", ["event_type"], ["user_id"], "ts", F.unix_timestamp(F.col("ts").cast("timestamp")))


@query("""SELECT event_id, m.metric, CASE m.metric WHEN 'flag' THEN CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END WHEN 'label' THEN coalesce(TRY_CAST(CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS DOUBLE), 0.0)
      ELSE CAST(user_id AS DOUBLE) END AS value, CASE m.metric WHEN 'flag' THEN CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END
      WHEN 'label' THEN '"' || CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END || '"' ELSE user_id || 'i' END AS shown FROM events, (VALUES ('flag'), ('label'), ('user_id')) AS m(metric)""")
def metric_values(t):
    label = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    rows = t.events.select("event_id", "user_id", (F.col("event_type") == "error").alias("flag"), label.alias("label"))
    kinds = dict(rows.dtypes)
    shown = F.create_map(*[x for m in ("flag", "label", "user_id") for x in (F.lit(m), adapters.metric_text(F.col(m), kinds[m]))])
    found = adapters.points(rows.withColumns({"e": F.col("event_id"), "shown": shown}), "m", ["e"], ["flag", "label", "user_id"], F.struct("event_id", "shown"))
    return found.select("time.event_id", "metric", "value", F.col("time.shown")[F.col("metric")].alias("shown"))
