"""Log analytics over (ts, level, message, ...) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_total

ERRORS = ("ERROR", "FATAL", "CRITICAL")
WARNINGS = ("WARN", "WARNING")


def level_counts(logs: DataFrame) -> DataFrame:
    """(level, count); rows without a level are left out."""
    return logs.where("level is not null").groupBy("level").agg(F.count("*").alias("count"))


def _window_start(ts: Column, seconds: int) -> Column:
    return (F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds).cast("long")


def windows(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """(window_start, window_end, total, errors, warnings) of each tumbling window with rows, as epoch
    seconds with an inclusive end."""
    return (
        logs.where("ts is not null")
        .groupBy(_window_start(F.col("ts"), seconds).alias("window_start"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"), F.count_if(F.col("level").isin(*WARNINGS)).alias("warnings"))
        .select("window_start", (F.col("window_start") + seconds - 1).alias("window_end"), "total", "errors", "warnings")
    )


def window_levels(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """(window_start, level, count)."""
    return logs.where("ts is not null and level is not null").groupBy(_window_start(F.col("ts"), seconds).alias("window_start"), "level").agg(F.count("*").alias("count"))


def error_spikes(logs: DataFrame, threshold: int, seconds: int = 300) -> DataFrame:
    """The windows with at least `threshold` errors."""
    return windows(logs, seconds).where(F.col("errors") >= threshold)


def error_rate(logs: DataFrame) -> DataFrame:
    """(error_rate): errors over all rows, 0 for none."""
    return logs.agg(F.coalesce(F.avg(F.coalesce(F.col("level").isin(*ERRORS), F.lit(False)).cast("double")), F.lit(0.0)).alias("error_rate"))


def matching(logs: DataFrame, levels: Sequence[str] = (), keyword: str | None = None, start=None, end=None) -> DataFrame:
    """Rows by level, keyword in the message and time; either bound of the time may be left open."""
    if levels:
        logs = logs.where(F.col("level").isin(*levels))
    if keyword:
        logs = logs.where(F.contains("message", F.lit(keyword)))
    if start is not None:
        logs = logs.where(F.col("ts") >= F.lit(start).cast(logs.schema["ts"].dataType))
    if end is not None:
        logs = logs.where(F.col("ts") <= F.lit(end).cast(logs.schema["ts"].dataType))
    return logs


def partition_suffix(ts: Column, unit: str) -> Column:
    """The name suffix of a time partition: day 20240131, week 2024-W05 (ISO year), month 202401, hour 2024013107."""
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"day": "yyyyMMdd", "month": "yyyyMM", "hour": "yyyyMMddHH"}[unit])


def retained(logs: DataFrame, now, days: int) -> DataFrame:
    """The rows not older than `days` before `now`."""
    return logs.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def expired(logs: DataFrame, now, days: int) -> DataFrame:
    """The rows that `retained` leaves out, to archive."""
    return logs.where(F.col("ts") < F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def partition_stats(logs: DataFrame, unit: str = "day") -> DataFrame:
    """(partition, rows, avg_length) by time partition."""
    return logs.groupBy(partition_suffix(F.col("ts"), unit).alias("partition")).agg(F.count("*").alias("rows"), F.avg(F.length("message")).alias("avg_length"))


def registry_stats(partitions: DataFrame) -> DataFrame:
    """(partitions, rows, size_gb, oldest, newest, compressed_share) over a partition registry."""
    return partitions.agg(
        F.count("*").alias("partitions"), F.sum("row_count").alias("rows"), F.round(F.sum("size_mb") / 1024, 6).alias("size_gb"),
        F.min("start_date").alias("oldest"), F.max("start_date").alias("newest"), F.avg(F.col("compressed").cast("double")).alias("compressed_share"),
    )


def matching_report(logs: DataFrame, seconds: int = 300, **conditions) -> DataFrame:
    """(kind, name, count): the rows that `matching` finds, in all, by level and by time window, in one pass."""
    found = matching(logs, **conditions)
    window = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds
    each = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("level").alias("kind"), F.col("level").alias("name")),
        F.struct(F.lit("window").alias("kind"), window.cast("long").cast("string").alias("name")),
    )
    return found.select(F.explode(each).alias("g")).where("g.name is not null").groupBy("g.kind", "g.name").agg(F.count("*").alias("count"))


def roll(logs: DataFrame, unit: str, max_rows: int | None = None, max_bytes: int | None = None, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The rows with `_partition`: their time partition, and within it a running part once it has `max_rows` rows or
    `max_bytes` bytes of messages before it. `order` should tell the rows apart."""
    named = logs.withColumn("_suffix", partition_suffix(F.col("ts"), unit))
    size, most = (F.coalesce(F.octet_length("message"), F.lit(0)), max_bytes) if max_bytes else (F.lit(1), max_rows)
    if not most:
        return named.withColumnRenamed("_suffix", "_partition")
    counted = running_total(named, ["_suffix"], order, size, "_before")
    return counted.select(*logs.columns, F.concat_ws("_p", "_suffix", F.floor(F.col("_before") / most).cast("string")).alias("_partition"))


def partition_registry(logs: DataFrame) -> DataFrame:
    """(partition, start_date, end_date, row_count, size_bytes, is_active) of rows with `_partition`; the latest is active."""
    each = logs.groupBy(F.col("_partition").alias("partition")).agg(
        F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"), F.count("*").alias("row_count"), F.sum(F.octet_length("message")).alias("size_bytes"), F.max("ts").alias("_last"),
    )
    newest = each.agg(F.max(F.struct("_last", "partition")).alias("_newest"))
    return each.join(F.broadcast(newest)).select("partition", "start_date", "end_date", "row_count", "size_bytes", (F.col("partition") == F.col("_newest.partition")).alias("is_active"))


def expired_sessions(sessions: DataFrame, now, timeout_seconds: int) -> DataFrame:
    """The sessions whose `last_seen` is more than the timeout before `now`."""
    return sessions.where(F.col("last_seen") < F.lit(now).cast(sessions.schema["last_seen"].dataType) - F.make_dt_interval(secs=F.lit(timeout_seconds)))


def append(logs: DataFrame, path: str) -> None:
    """Append rows to a log table partitioned by day, so that a time filter prunes files."""
    logs.withColumn("log_date", F.to_date("ts")).write.mode("append").partitionBy("log_date").parquet(path)


def read(spark, path: str, start=None, end=None) -> DataFrame:
    """The log rows between two dates, inclusive; only their partitions are listed."""
    logs = spark.read.parquet(path)
    if start is not None:
        logs = logs.where(F.col("log_date") >= F.lit(start).cast("date"))
    if end is not None:
        logs = logs.where(F.col("log_date") <= F.lit(end).cast("date"))
    return logs
