"""Small files and folders in any store that Spark reaches, by its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none where there is no such folder."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def create(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file; fails if there is one by that name, so of two writers only one succeeds."""
    fs, where = _at(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> str:
    """The text of a file."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether there was one."""
    fs, where = _at(spark, path)
    return bool(fs.exists(where) and fs.delete(where, True))
