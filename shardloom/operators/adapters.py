"""Rows in the shapes of key-value, document and time-series stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(template: str, **parts: Column) -> Column:
    """A key from a template with {name} places."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def json_values(df: DataFrame, key: Column, mapping: Mapping[str, str]) -> DataFrame:
    """(key, value): the mapped fields as one JSON object; nulls are kept."""
    body = F.to_json(F.struct(*[F.col(s).alias(t) for s, t in mapping.items()]), {"ignoreNullFields": "false"})
    return df.select(key.alias("key"), body.alias("value"))


def hash_fields(df: DataFrame, key: Column, mapping: Mapping[str, str]) -> DataFrame:
    """(key, field, value): one row per field that is not null; such stores have no null."""
    each = F.array(*[F.struct(F.lit(t).alias("field"), F.col(s).cast("string").alias("value")) for s, t in mapping.items()])
    return df.select(key.alias("key"), F.explode(each).alias("f")).select("key", "f.*").where("value is not null")


def separate_keys(df: DataFrame, key: Column, mapping: Mapping[str, str]) -> DataFrame:
    """(key, value): one key per field, named key:field."""
    return hash_fields(df, key, mapping).select(F.concat_ws(":", "key", "field").alias("key"), "value")


class Converter(Protocol):
    """Anything that turns a table into the rows of another store's shape. What it returns is of its own columns."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def key_value_converter(shape: str, key: Column, mapping: Mapping[str, str]) -> Converter:
    """One of the shapes json, hash and separate."""
    made = {"json": json_values, "hash": hash_fields, "separate": separate_keys}[shape]
    return lambda df: made(df, key, mapping)


def converted(df: DataFrame, converters: Mapping[str, Converter]) -> DataFrame:
    """(shape, ...): the rows of several converters over one table, each with its name; a column that one lacks is null there."""
    made = [c(df).select(F.lit(n).alias("shape"), "*") for n, c in converters.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def key_values(df: DataFrame, shapes: Sequence[str], key: Column, mapping: Mapping[str, str]) -> DataFrame:
    """(shape, key, field, value): the rows in several shapes at once, json, hash and separate."""
    out = converted(df, {s: key_value_converter(s, key, mapping) for s in shapes})
    return out.select("shape", "key", (F.col("field") if "field" in out.columns else F.lit(None).cast("string")).alias("field"), "value")


def documents(df: DataFrame, id_column: str, mapping: Mapping[str, str], metadata: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc): {_id, data, ...metadata} as JSON."""
    data = F.struct(*[F.col(s).alias(t) for s, t in mapping.items()])
    meta = [c.alias(n) for n, c in (metadata or {}).items()]
    return df.select(F.to_json(F.struct(F.col(id_column).alias("_id"), data.alias("data"), *meta), {"ignoreNullFields": "false"}).alias("doc"))


def wire_commands(commands: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(wire): each row's parts as one command in the length-prefixed wire format; null parts are left out."""
    end = F.lit("\r\n")
    bulk = [F.when(F.col(p).isNotNull(), F.concat(F.lit("$"), F.octet_length(F.col(p)).cast("string"), end, F.col(p), end)) for p in parts]
    n = sum((F.when(F.col(p).isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return commands.select(F.concat(F.lit("*"), n.cast("string"), end, F.concat_ws("", *bulk)).alias("wire"))


def _escaped(c: Column, marks: str) -> Column:
    out = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit("\\" + m))
    return out


def line_protocol(df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], time_ns: Column) -> DataFrame:
    """(line): measurement,tags fields time; names sorted, whole numbers with i, texts quoted, nulls left out,
    rows without any field left out."""
    kinds = dict(df.dtypes)

    def shown(f: str) -> Column:
        if kinds[f] in ("tinyint", "smallint", "int", "bigint"):
            return F.concat(F.col(f).cast("string"), F.lit("i"))
        if kinds[f] == "string":
            return F.concat(F.lit('"'), F.replace(F.replace(F.col(f), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.col(f).cast("string")

    tag = [F.when(F.col(t).isNotNull() & (F.col(t).cast("string") != ""), F.concat(F.lit(t + "="), _escaped(F.col(t), ", ="))) for t in sorted(tags)]
    head = F.concat_ws(",", F.lit(measurement), *tag)
    body = F.concat_ws(",", *[F.concat(F.lit(f + "="), shown(f)) for f in sorted(fields)])
    return df.where(body != "").select(F.concat_ws(" ", head, body, time_ns.cast("string")).alias("line"))


def points(df: DataFrame, measurement: str, tags: Sequence[str], metrics: Sequence[str], time: Column) -> DataFrame:
    """(measurement, time, tag_text, metric, value): one row per metric of a point; a boolean counts 1 or 0, a text
    what number it holds, or 0."""
    kinds = dict(df.dtypes)

    def number(m: str) -> Column:
        if kinds[m] == "string":
            return F.when(F.col(m).isNotNull(), F.coalesce(F.col(m).try_cast("double"), F.lit(0.0)))
        return F.col(m).cast("double")

    tag_text = F.concat_ws(",", *[F.concat(F.lit(t + "="), F.col(t).cast("string")) for t in sorted(tags)])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), number(m).alias("value")) for m in metrics])
    out = df.select(F.lit(measurement).alias("measurement"), time.alias("time"), tag_text.alias("tag_text"), F.explode(each).alias("m"))
    return out.select("measurement", "time", "tag_text", "m.*").where("value is not null")


def metric_text(value: Column, kind: str) -> Column:
    """A metric as text: whole numbers with i, texts in quotes, all else as it is. `kind` is a Spark type's name."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.concat(value.cast("string"), F.lit("i"))
    return F.concat(F.lit('"'), value, F.lit('"')) if kind == "string" else value.cast("string")


def point_statements(df: DataFrame, table: str, tags: Sequence[str], metrics: Sequence[str], time_name: str, time: Column) -> DataFrame:
    """(statement): an INSERT of each point with its tags and numeric metrics."""
    tag = F.concat_ws(", ", *[F.when(F.col(t).isNotNull(), F.concat(F.lit(f"tag {t}='"), F.replace(F.col(t).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))) for t in sorted(tags)])
    value = F.concat_ws(", ", *[F.when(F.col(m).isNotNull(), F.concat(F.lit(f"field {m}="), F.col(m).cast("string"))) for m in sorted(metrics)])
    return df.where(value != "").select(F.concat(F.lit(f"INSERT INTO {table} ("), value, F.lit(") TAGS ("), tag, F.lit(f") VALUES ({time_name}) "), time.cast("string")).alias("statement"))


#: Seconds of a unit of an interval.
UNITS = {"m": 60, "h": 3600, "d": 86_400}


def interval_seconds(text: str) -> int:
    """Seconds of an interval like 5m, 2h or 1d."""
    n, unit = text[:-1], text[-1:]
    if not n.isdigit() or unit not in UNITS:
        raise ValueError(f"not an interval: {text!r}")
    return int(n) * UNITS[unit]


def interval_text(seconds: int) -> str:
    """The shortest text of an interval of whole minutes."""
    if seconds <= 0 or seconds % 60:
        raise ValueError(f"{seconds} seconds are no whole minutes")
    unit = next(u for u in ("d", "h", "m") if seconds % UNITS[u] == 0)
    return f"{seconds // UNITS[unit]}{unit}"


def hypertable_statements(table: str, time: str, columns: Mapping[str, str], interval: str = "1 hour") -> list[str]:
    """The statements that make a time-partitioned table."""
    body = ", ".join(f"{c} {t}" for c, t in columns.items())
    return [f"CREATE TABLE {table} ({time} TIMESTAMPTZ NOT NULL, {body});", f"SELECT create_hypertable('{table}', '{time}', chunk_time_interval => INTERVAL '{interval}');"]


def write_points(lines: DataFrame, path: str) -> None:
    """Write lines as text files, as bulk loaders take them."""
    lines.select("line").write.text(path)
