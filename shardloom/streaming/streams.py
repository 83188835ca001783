"""Log windows and upserts over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import ERRORS
from ..operators.sync import upsert
from ..operators.versioned import VersionedTable


def log_windows(events: DataFrame, seconds: int = 300, late: str = "10 minutes", slide: int | None = None) -> DataFrame:
    """(window_start, total, errors) of tumbling (or sliding) event-time windows; rows later than `late`
    behind the newest are dropped, which bounds the state."""
    w = F.window("ts", f"{seconds} seconds", f"{slide or seconds} seconds")
    counted = events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("total"), F.count_if(F.col("level").isin(*ERRORS)).alias("errors"))
    return counted.select(F.unix_timestamp("window.start").alias("window_start"), "total", "errors")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, total) of each key's sessions."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(key, w).agg(F.count("*").alias("total"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "total")


def first_seen(events: DataFrame, key: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def upsert_stream(changes: DataFrame, read_target: Callable[[], DataFrame | None], publish: Callable[[DataFrame, int], None], key: Sequence[str], order: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of changes to a target: the last change per key (by `order`) replaces its row.

    `read_target` gives the current version, `publish` stores a new one under the batch's number; a batch
    that is run again writes the same version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rest = F.struct(order, *[c for c in batch.columns if c != order and c not in key])
        last = batch.groupBy(*key).agg(F.max(rest).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in batch.columns])
        target = read_target()
        publish(last if target is None else upsert(last, target, key), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_versions(changes: DataFrame, table: VersionedTable, order: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of changes to a versioned table: of each key the row with the greatest `order` counts, be it a change or the
    table's. Each batch reads and rewrites only the buckets that its keys touch. Where changes can be deletions, keep them as marked
    rows, so that an older change that comes later does not bring a key back.

    A batch that is run again after a failure finds its number in the table's last version and changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(batch, conflict="newest", latest=order, batch=number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
