"""Named sources with one interface, and queries over all of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ports taken where an address names none.
PORTS = {"mysql": 3306, "mariadb": 3306, "postgresql": 5432, "redis": 6379, "mongodb": 27017, "oracle": 1521}


@dataclass(frozen=True)
class Address:
    """A connection string's parts."""

    kind: str
    host: str = ""
    port: int | None = None
    database: str = ""
    user: str | None = None
    password: str | None = None

    @classmethod
    def parse(cls, text: str) -> Address:
        if text.startswith("sqlite:"):
            return cls("sqlite", database=text.split(":", 1)[1].removeprefix("//"))
        u = urlsplit(text)
        kind = {"postgres": "postgresql"}.get(u.scheme, u.scheme)
        if kind not in PORTS or not u.hostname:
            raise ValueError(f"not a connection string: {text.split('://')[0]}")
        part = lambda x: None if x is None else unquote(x)
        return cls(kind, u.hostname, u.port or PORTS[kind], u.path.strip("/"), part(u.username), part(u.password))

    def masked(self) -> str:
        """For display: the password's first and last character only."""
        if self.kind == "sqlite":
            return f"sqlite://{self.database}"
        p = self.password
        hidden = "" if p is None else ":" + (p[0] + "***" + p[-1] if len(p) > 2 else "***")
        who = "" if self.user is None else f"{self.user}{hidden}@"
        return f"{self.kind}://{who}{self.host}:{self.port}/{self.database}"

    def text(self) -> str:
        """The connection string again, with the password in it."""
        if self.kind == "sqlite":
            return f"sqlite:{self.database}"
        who = "" if self.user is None else quote(self.user, safe="") + ("" if self.password is None else f":{quote(self.password, safe='')}") + "@"
        return f"{self.kind}://{who}{self.host}:{self.port}/{self.database}"

    def is_local(self) -> bool:
        return self.kind == "sqlite" or self.host in ("localhost", "127.0.0.1", "::1")

    def jdbc(self) -> dict[str, str]:
        """Options of Spark's JDBC reader and writer."""
        if self.kind == "sqlite":
            return {"url": f"jdbc:sqlite:{self.database}"}
        where = f"{self.host}:{self.port}/{self.database}"
        out = {"url": f"jdbc:oracle:thin:@//{where}" if self.kind == "oracle" else f"jdbc:{self.kind}://{where}"}
        return out | {k: v for k, v in (("user", self.user), ("password", self.password)) if v is not None}


class Source(Protocol):
    """Where tables come from."""

    def tables(self) -> list[str]: ...

    def read(self, table: str) -> DataFrame: ...


@dataclass
class FileSource:
    """One file or folder per table, in any format that Spark reads."""

    spark: SparkSession
    path: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def tables(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
        return sorted(n.removesuffix(f".{self.format}") for n in names if n.endswith(f".{self.format}"))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format(self.format).options(**self.options).load(f"{self.path}/{table}.{self.format}")


# Queries for the tables of a database.
TABLE_LISTS = {
    "mysql": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = database() AND table_type = 'BASE TABLE'",
    "mariadb": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = database() AND table_type = 'BASE TABLE'",
    "postgresql": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = current_schema() AND table_type = 'BASE TABLE'",
    "sqlite": "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'",
    "oracle": "SELECT table_name AS name FROM user_tables",
    "derby": "SELECT tablename AS name FROM sys.systables WHERE tabletype = 'T'",
}


@dataclass
class JdbcSource:
    """A database; give the partition column and its bounds of a large table to read it in parallel.

    `options` go to Spark's JDBC reader and writer: those of an Address, or any url and driver."""

    spark: SparkSession
    kind: str
    options: dict[str, str]
    fetch_size: int = 10_000

    @classmethod
    def at(cls, spark: SparkSession, address: Address) -> JdbcSource:
        return cls(spark, address.kind, address.jdbc())

    def query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, query=sql, fetchsize=str(self.fetch_size)).load()

    def tables(self) -> list[str]:
        return sorted(r[0] for r in self.query(TABLE_LISTS[self.kind]).collect())

    def read(self, table: str, column: str | None = None, lower=None, upper=None, partitions: int = 8) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self.options, dbtable=table, fetchsize=str(self.fetch_size))
        if column:
            reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
        return reader.load()

    def balanced(self, table: str, column: str, partitions: int = 8, second: str | None = None) -> list[str]:
        """Predicates that split a table into about so many parts of like size by a column of whole numbers, however skewed it is.

        The database counts rows in equal ranges of the column; a range with more than a quarter of a part's rows is counted again in
        finer ones, until it is small or one value. Neighbouring ranges are put together up to a part's size. A single value with more rows
        than that is split by the remainder of `second`, another column of whole numbers; without one it is a part of its own, as are the rows
        without a value. Counts reach the driver, 64 a query.
        """
        mark = "`" if self.kind in ("mysql", "mariadb") else '"'
        column, second = (c and mark + c.replace(mark, mark * 2) + mark for c in (column, second))
        low, high, rows, held = (int(x) if x is not None else None for x in self.query(f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS n, COUNT({column}) AS held FROM {table}").first())
        share = max(1, -(-rows // partitions))
        # Ranges [a, b) with their rows, by a.
        todo, cells = [(low, high + 1)] if held else [], []
        while todo:
            a, b = todo.pop()
            width = -(-(b - a) // 64)
            inner = f"SELECT ({column} - {a}) / {width} AS cell FROM {table} WHERE {column} >= {a} AND {column} < {b}"
            for cell, n in self.query(f"SELECT cell, COUNT(*) AS n FROM ({inner}) x GROUP BY cell").collect():
                start = a + int(cell) * width
                end = min(start + width, b)
                if n > share / 4 and end - start > 1:
                    todo.append((start, end))
                else:
                    cells.append((start, end, n))
        out: list[str] = []
        start, end, filled = None, None, 0

        def close() -> None:
            nonlocal start, filled
            if start is not None:
                out.append(f"{column} >= {start} AND {column} < {end}")
            start, filled = None, 0

        def split(test: str, n: int) -> None:
            parts = -(-n // share) if second else 1
            kept = f"({test})" if parts > 1 else test
            out.extend([f"{kept} AND MOD(ABS({second}), {parts}) = {k}" for k in range(parts)] if parts > 1 else [test])
            if parts > 1:
                out.append(f"{kept} AND {second} IS NULL")

        for a, b, n in sorted(cells):
            if n > share:
                close()
                split(f"{column} = {a}", n)
                continue
            if filled and filled + n > share:
                close()
            start, end, filled = a if start is None else start, b, filled + n
        close()
        if rows > (held or 0):
            split(f"{column} IS NULL", rows - (held or 0))
        return out

    def read_balanced(self, table: str, column: str, partitions: int = 8, second: str | None = None) -> DataFrame:
        """A table read by `balanced` predicates, one task each; an empty table by one."""
        predicates = self.balanced(table, column, partitions, second) or ["1 = 1"]
        options = {k: v for k, v in self.options.items() if k != "url"} | {"fetchsize": str(self.fetch_size)}
        return self.spark.read.jdbc(self.options["url"], table, predicates=predicates, properties=options)

    def write(self, df: DataFrame, table: str, mode: str = "append", batch: int = 1000) -> None:
        df.write.format("jdbc").options(**self.options, dbtable=table, batchsize=str(batch)).mode(mode).save()


@dataclass
class CatalogSource:
    """The tables and views of the session's catalog."""

    spark: SparkSession
    database: str = "default"

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def read(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{table}")


def open_source(spark: SparkSession, text: str) -> Source:
    """A source by its text: a connection string, catalog:<database>, or <format>:<path>."""
    kind, _, rest = text.partition(":")
    if kind == "catalog":
        return CatalogSource(spark, rest or "default")
    if kind in ("parquet", "orc", "json", "csv"):
        return FileSource(spark, rest, kind)
    return JdbcSource.at(spark, Address.parse(text))


@dataclass
class Registry:
    """Sources by name."""

    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, name: str, source: Source) -> None:
        self.sources[name] = source

    def names(self) -> list[str]:
        return sorted(self.sources)

    def on_all(self, query: Callable[[Source], DataFrame]) -> DataFrame:
        """A query's rows from every source, with the source's name in `_source`."""
        from ..operators.fusion import tag_sources

        return tag_sources({n: query(s) for n, s in self.sources.items()})

    def sql(self, text: str) -> DataFrame:
        """A query over tables of several sources, named source.table in it. Each table it names is read by its own source, with the filters and
        columns that Spark pushes there; joins between sources are Spark's. Texts in quotes and comments are left alone."""
        made: dict[tuple[str, str], DataFrame] = {}

        def named(m: re.Match) -> str:
            if not m["source"] or m["source"] not in self.sources:
                return m[0]
            key = m["source"], m["table"]
            if key not in made:
                made[key] = self.sources[key[0]].read(key[1])
            return f"{{t{list(made).index(key)}}}"

        skipped = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/"
        bound = re.sub(rf"{skipped}|(?<![\w.])(?P<source>[A-Za-z_]\w*)\.(?P<table>[A-Za-z_]\w*)(?![\w.])", named, text, flags=re.S)
        if not made:
            raise ValueError(f"the query names no table of {self.names()}")
        return next(iter(made.values())).sparkSession.sql(bound, **{f"t{k}": df for k, df in enumerate(made.values())})

    def healthy(self) -> dict[str, bool]:
        """Whether each source answers: a database a query, any other the list of its tables."""
        out = {}
        for n, s in self.sources.items():
            try:
                if isinstance(s, JdbcSource):
                    s.query({"oracle": "SELECT 1 AS x FROM dual", "derby": "VALUES 1"}.get(s.kind, "SELECT 1 AS x")).count()
                else:
                    s.tables()
                out[n] = True
            except Exception:
                out[n] = False
        return out


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, data_type, nullable) of each column: a catalog view."""
    rows = [(t, k, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for k, f in enumerate(df.schema, 1)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of each table, in one job."""
    from ..operators.fusion import union_all

    return union_all([df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t, df in tables.items()])


def table_sizes(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """(table_name, files, bytes) of each table's files below a folder, by the store's own listing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for s in fs.listStatus(hadoop):
        if s.getPath().getName().endswith(suffix):
            whole = fs.getContentSummary(s.getPath())
            rows.append((s.getPath().getName().removesuffix(suffix), whole.getFileCount(), whole.getLength()))
    return spark.createDataFrame(rows, "table_name string, files long, bytes long")


def views(spark: SparkSession) -> DataFrame:
    """(name, is_temporary) of the session's views."""
    return spark.sql("SHOW VIEWS").select(F.col("viewName").alias("name"), F.col("isTemporary").alias("is_temporary"))


def view_texts(spark: SparkSession, database: str = "default") -> DataFrame:
    """(name, text): the query of each view of the catalog; temporary views have no text there."""
    names = [r["viewName"] for r in spark.sql(f"SHOW VIEWS IN {database}").collect() if not r["isTemporary"]]
    rows = [(n, spark.sql(f"DESCRIBE TABLE EXTENDED {database}.`{n}`").where("col_name = 'View Text'").first()["data_type"]) for n in names]
    return spark.createDataFrame(rows, "name string, text string")


def create_view(spark: SparkSession, name: str, sql: str) -> None:
    """A temporary view of a query, in place of any of that name."""
    spark.sql(sql).createOrReplaceTempView(name)


def rename_view(spark: SparkSession, old: str, new: str) -> None:
    spark.table(old).createTempView(new)
    spark.catalog.dropTempView(old)


def drop_view(spark: SparkSession, name: str) -> bool:
    """Whether there was one."""
    return spark.catalog.dropTempView(name)


def functions(spark: SparkSession, own: bool = True) -> list[str]:
    """Names of functions, by default only of those that were registered here."""
    return sorted(r[0] for r in spark.sql(f"SHOW {'USER' if own else 'ALL'} FUNCTIONS").collect())


def create_function(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL function of the session, which Spark expands in the plan: no Python runs for it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def drop_function(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def identity(spark: SparkSession) -> DataFrame:
    """(database, version): where a query without a database's name looks, and the engine."""
    return spark.sql("SELECT current_database() AS database, split(version(), ' ')[0] AS version")
