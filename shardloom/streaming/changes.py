"""Change feeds with deletions, in any order: keyed state decides what each change does."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestChange(StatefulProcessor):
    """Holds for each key the order of its newest change and whether that left a row; passes on the newest change of a batch if it is
    newer. One row is held at a time, however many changes of a key a batch has."""

    def __init__(self, order: str, deleted: str, order_kind: str, ttl_ms: int | None) -> None:
        self.order, self.deleted, self.order_kind, self.ttl_ms = order, deleted, order_kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", f"at {self.order_kind}, alive boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = None
        for row in rows:
            at = row[self.order]
            if at is not None and (newest is None or (at, bool(row[self.deleted])) > (newest[self.order], bool(newest[self.deleted]))):
                newest = row
        if newest is None:
            return
        at, alive = self.held.get() if self.held.exists() else (None, False)
        if at is not None and newest[self.order] <= at:
            return
        gone = bool(newest[self.deleted])
        self.held.update((newest[self.order], not gone))
        if alive or not gone:  # the end of a key that has no row says nothing
            yield Row(**newest.asDict(), operation="delete" if gone else "update" if alive else "insert")

    def close(self) -> None:
        pass


def effective_changes(changes: DataFrame, key: Sequence[str], order: str, deleted: str, ttl_ms: int | None = None) -> DataFrame:
    """The columns of `changes`, and operation: insert, update or delete of what earlier batches left.

    Of a stream of changes, which may come late, repeated and out of order, the newest of each key and batch goes out, if it is newer by
    `order` (which tells a key's changes apart; of equal ones a deletion counts, then the first) than all changes of its key before. `deleted`
    is a boolean column. State is two values a key, in RocksDB; with `ttl_ms` it is forgotten when a key had no change for so
    long, after which a change older than the last counts as new. Rows without an order are passed over; null keys are a key.
    """
    kinds = {f.name: f.dataType for f in changes.schema}
    schema = T.StructType([*changes.schema.fields, T.StructField("operation", T.StringType())])
    processor = LatestChange(order, deleted, kinds[order].simpleString(), ttl_ms)
    return changes.groupBy(*key).transformWithState(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def append_batches(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream gives to `path`, a folder a batch; a batch that is run again replaces its folder. RocksDB keeps the state."""
    spark = out.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return with_state_store(spark, lambda: out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def with_state_store(spark: SparkSession, start):
    """Start a query whose state lies in RocksDB; the session's own setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        return start()
    finally:
        spark.conf.set(name, held)


def current_rows(changes: DataFrame, key: Sequence[str], order: str, deleted: str) -> DataFrame:
    """The rows that a whole change log leaves: of each key the newest change, unless it is a deletion. Aggregates of fixed size, so a key
    with very many changes is no large group."""
    rest = [c for c in changes.columns if c not in key and c not in (order, deleted)]
    newest = F.max(F.struct(order, F.coalesce(deleted, F.lit(False)).alias("_gone"), *rest)).alias("_row")
    rows = changes.where(F.col(order).isNotNull()).groupBy(*key).agg(newest).where("not _row._gone")
    return rows.select(*[F.col(c) if c in key else F.lit(False).alias(c) if c == deleted else F.col(f"_row.{c}").alias(c) for c in changes.columns])
