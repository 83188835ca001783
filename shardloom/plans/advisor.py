"""Reading query logs: classes, lint, complexity, slow queries, table health. All on columns, so a log of any
size is one scan."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statement classes by their first word, tested in this order.
CLASSES = (
    ("SELECT", "select"), ("WITH", "select"), ("INSERT", "insert"), ("UPDATE", "update"), ("DELETE", "delete"), ("REPLACE", "replace"),
    ("CREATE", "create"), ("ALTER", "alter"), ("DROP", "drop"), ("TRUNCATE", "truncate"), ("SHOW", "show"), ("DESC", "show"),
    ("EXPLAIN", "explain"), ("START TRANSACTION", "begin"), ("BEGIN", "begin"), ("COMMIT", "commit"), ("ROLLBACK", "rollback"), ("SET", "set"), ("USE", "use"),
)


def statement_class(sql: Column) -> Column:
    """What kind of statement a text is; other if none."""
    head, out = F.upper(F.trim(sql)), F.lit("other")
    for word, kind in reversed(CLASSES):
        out = F.when(head.startswith(word), kind).otherwise(out)
    return out


def table_name(sql: Column) -> Column:
    """The word after the first of from, into, update and join that the text has, in that priority."""
    low = F.lower(sql)
    found = [F.nullif(F.regexp_extract(low, rf"(?:^|\s){w}\s+([^\s,;()]+)", 1), F.lit("")) for w in ("from", "into", "update", "join")]
    return F.coalesce(*found)


def complexity_score(sql: Column) -> Column:
    """3 a join, 2 a grouping, 1 an ordering, 2 a further select."""
    low = F.lower(sql)
    count = lambda w: F.regexp_count(low, F.lit(w))
    return count(r"\bjoin\b") * 3 + count(r"\bgroup by\b") * 2 + count(r"\border by\b") + F.greatest(count(r"\bselect\b") - 1, F.lit(0)) * 2


def complexity(sql: Column) -> Column:
    """simple up to 2, medium up to 5, complex above."""
    score = complexity_score(sql)
    return F.when(score <= 2, "simple").when(score <= 5, "medium").otherwise("complex")


def lint(sql: Column) -> Column:
    """Names of the weak spots of a query's text."""
    s = F.lower(sql)
    has = lambda w: F.contains(s, F.lit(w))
    rules = {
        "select_star": has("select *"),
        "like_prefix": has(" like '%"),
        "or_condition": has(" or ") & has(" where "),
        "order_without_limit": has(" order by ") & ~has(" limit "),
        "no_where": has(" from ") & ~has(" where "),
        "not_in": has("not in") | has("not exists"),
        "count_star": has("count(*)") & has(" from ") & ~has(" where "),
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]))


def index_suggestions(sql: Column) -> Column:
    """CREATE INDEX for each field compared in the WHERE clause's conjuncts."""
    clause = F.regexp_extract(F.lower(sql), r"where\s+(.*)$", 1)
    fields = F.transform(F.split(clause, " and "), lambda c: F.regexp_extract(c, r"^\s*\(?\s*([\w.]+)\s*[=<>]", 1))
    table = table_name(sql)
    return F.transform(F.filter(fields, lambda f: f != ""), lambda f: F.concat(F.lit("CREATE INDEX idx_"), table, F.lit("_"), f, F.lit(" ON "), table, F.lit(" ("), f, F.lit(")")))


def suggested_rewrite(sql: Column) -> Column:
    """A statement's text with its weak spots mended: a bound on rows for a SELECT that has none (1000 if it sorts, else 100), once; null if
    there is nothing that a text can mend."""
    low = F.lower(F.trim(sql))
    bare = F.regexp_replace(F.rtrim(sql), r"[;\s]+$", "")
    open_ended = low.startswith("select") & ~F.regexp_like(low, F.lit(r"\blimit\s+\d+|\bfetch\s+first\b")) & ~F.regexp_like(low, F.lit(r"^select\s+(count|sum|min|max|avg)\s*\("))
    bound = F.when(F.regexp_like(low, F.lit(r"\border\s+by\b")), " LIMIT 1000").otherwise(" LIMIT 100")
    return F.when(open_ended, F.concat(bare, bound))


def slow_by_table(log: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """(table_name, total, slow, ratio) of each table in a log of (table_name, execution_ms)."""
    return (
        log.groupBy("table_name").agg(F.count("*").alias("total"), F.count_if(F.col("execution_ms") > threshold_ms).alias("slow"))
        .withColumn("ratio", F.round(F.col("slow") / F.col("total"), 6))
    )


def needing_attention(log: DataFrame, threshold_ms: int = 1000, ratio: float = 0.1, more_than: int = 10) -> DataFrame:
    """Tables with more than so many queries, of which at least the ratio is slow; the worst first."""
    return slow_by_table(log, threshold_ms).where((F.col("total") > more_than) & (F.col("slow") >= ratio * F.col("total"))).orderBy(F.desc("ratio"), "table_name")


def slow_summary(log: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """(slow, avg_ms whole, tables) of the slow queries."""
    return log.where(F.col("execution_ms") > threshold_ms).agg(
        F.count("*").alias("slow"), F.coalesce(F.floor(F.avg("execution_ms")), F.lit(0)).cast("long").alias("avg_ms"), F.count_distinct("table_name").alias("tables")
    )


def slowest(log: DataFrame, n: int, threshold_ms: int = 1000) -> DataFrame:
    """The n slowest queries."""
    return log.where(F.col("execution_ms") > threshold_ms).orderBy(F.desc("execution_ms"), "query_id").limit(n)


def class_metrics(log: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """(class, total, slow, failed, avg_ms whole) by SELECT, INSERT, UPDATE, DELETE and OTHER, of a log of (sql,
    execution_ms, failed)."""
    head = F.upper(F.trim("sql"))
    kind = F.lit("OTHER")
    for word in ("SELECT", "INSERT", "UPDATE", "DELETE"):
        kind = F.when(head.startswith(word), word).otherwise(kind)
    return log.groupBy(kind.alias("class")).agg(
        F.count("*").alias("total"), F.count_if(F.col("execution_ms") > threshold_ms).alias("slow"), F.count_if("failed").alias("failed"),
        F.floor(F.avg("execution_ms")).cast("long").alias("avg_ms"),
    )


def newest_slow(log: DataFrame, n: int = 10, threshold_ms: int = 1000) -> DataFrame:
    """The n newest slow queries of a log with `ts`."""
    return log.where(F.col("execution_ms") > threshold_ms).orderBy(F.desc("ts"), F.desc("query_id")).limit(n)


def of_table(log: DataFrame, table: str) -> DataFrame:
    """The log's rows of one table."""
    return log.where(F.col("table_name") == table)


@dataclass(frozen=True)
class Profile:
    """A statement that was run: its class, table and lint, its time, and scans without a pushed filter."""

    sql: str
    statement_class: str
    table: str | None
    seconds: float
    slow: bool
    rows: int
    lint: tuple[str, ...]
    unfiltered_scans: tuple[str, ...]


def unfiltered_scans(df: DataFrame) -> list[str]:
    """The file scans of a plan to which no filter is pushed: format, columns and first path of each. The plan's own nodes are asked, not
    its text."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    out = []
    for k in range(leaves.size()):
        scan = leaves.apply(k)
        if scan.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        if scan.dataFilters().isEmpty() and scan.partitionFilters().isEmpty():
            paths = scan.relation().location().rootPaths()
            at = paths.apply(0).toString() if paths.size() else ""
            out.append(f"{scan.relation().fileFormat().toString()} [{', '.join(scan.requiredSchema().fieldNames())}] {at}")
    return out


def run_and_profile(spark: SparkSession, sql: str, threshold_seconds: float = 1.0) -> tuple[DataFrame, Profile]:
    """Run a statement; its rows as a DataFrame, and how it went. A query is run once, with all its columns, into a sink that keeps
    nothing; its rows are counted on the way."""
    from pyspark.sql import Observation

    began = time.perf_counter()
    df = spark.sql(sql)
    rows = 0
    if df.columns:
        seen = Observation()
        df.observe(seen, F.count("*").alias("rows")).write.format("noop").mode("overwrite").save()
        rows = seen.get["rows"]
    took = time.perf_counter() - began
    text = F.lit(sql)
    kind, table, found = spark.range(1).select(statement_class(text), table_name(text), lint(text)).first()
    return df, Profile(sql, kind, table, took, took > threshold_seconds, rows, tuple(found), tuple(unfiltered_scans(df)))


def health(rows: Column, size_mb: Column) -> Column:
    """critical over 1 GB; warning over 10 million rows or 10 MB a row; else healthy."""
    return F.when(size_mb > 1024, "critical").when((rows > 10_000_000) | (size_mb > rows * 10), "warning").otherwise("healthy")


def maintenance_statements(table: str, dialect: str) -> list[str]:
    """The statements that refresh a table's statistics and storage."""
    return {
        "mysql": [f"ANALYZE TABLE {table};", f"OPTIMIZE TABLE {table};"],
        "postgresql": [f"VACUUM ANALYZE {table};", f"REINDEX TABLE {table};"],
        "sqlite": [f"ANALYZE {table};"],
        "spark": [f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS"],
    }.get(dialect.lower(), [])
