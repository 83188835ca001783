"""Results written once into storage that driver and executors share, and bounded batches for Python."""

from __future__ import annotations

import atexit
import threading
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Bytes in one Arrow batch handed to Python, unless one row alone is more.
ARROW_BYTES = 4_000_000

#: Folders made so far: the session, the thread that asked, and the path.
_written: list[tuple[SparkSession, int, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, so that long texts fit in a worker.

    Batches of short rows stay as they were, so the setting may stay behind in the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(key)).removesuffix("b")
    if not held.isdigit() or int(held) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, or where the session names none below its warehouse: driver and executors share
    both. The folder goes when the application ends (see `release`), or before (see `release_since`).

    Only with a local master may the warehouse be a folder of the driver's own machine; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if urlsplit(base).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share: the warehouse {base} is a local one")
    path = f"{base.rstrip('/')}/shardloom-{uuid.uuid4().hex}"
    _written.append((spark, threading.get_ident(), path))
    return path


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and Python
    work above it runs once. The files go when the application ends (see `release`).
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked() -> int:
    """A mark for `release_since`."""
    return len(_written)


def release_since(mark: int, keep: int = 1) -> None:
    """Delete the folders that this thread asked for since the mark, but for the last `keep` of them. No DataFrame that is still to be read may
    stand on the others."""
    mine = [w for w in _written[mark:] if w[1] == threading.get_ident()]
    release(mine[: len(mine) - keep])


def release(folders: list[tuple[SparkSession, int, str]] | None = None) -> None:
    """Delete folders of `shared_folder`, without any given all; no DataFrame may still read them."""
    for held in list(_written if folders is None else folders):
        spark, _, path = held
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may be gone when the interpreter exits
            pass
        # A mark counts places, so what is gone stays in the list, without a path to delete.
        if folders is not None and held in _written:
            _written[_written.index(held)] = (spark, 0, path)
    if folders is None:
        _written.clear()


atexit.register(release)
