"""A builder for one-table queries that compiles to DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """select, where (all hold), join, group_by with aggregates, having, order_by, offset and limit, in
    SQL's order of evaluation. Conditions are expressions or columns; each call gives a new query."""

    fields: tuple = ()
    conditions: tuple = ()
    joins: tuple = ()
    groups: tuple[str, ...] = ()
    aggregates: tuple[Column, ...] = ()
    group_conditions: tuple = ()
    order: tuple[tuple[str, bool], ...] = ()
    skip: int = 0
    most: int | None = None
    _: object = field(default=None, repr=False)

    def select(self, *fields) -> Query:
        return replace(self, fields=self.fields + fields)

    def where(self, condition) -> Query:
        return replace(self, conditions=(*self.conditions, condition))

    def join(self, other: DataFrame, on, how: str = "inner") -> Query:
        return replace(self, joins=(*self.joins, (other, on, how)))

    def group_by(self, *names: str, **aggregates: Column) -> Query:
        return replace(self, groups=names, aggregates=tuple(c.alias(n) for n, c in aggregates.items()))

    def having(self, condition) -> Query:
        return replace(self, group_conditions=(*self.group_conditions, condition))

    def order_by(self, name: str, ascending: bool = True) -> Query:
        return replace(self, order=(*self.order, (name, ascending)))

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def on(self, df: DataFrame) -> DataFrame:
        """The query's result on a table."""
        expr = lambda c: F.expr(c) if isinstance(c, str) else c
        for other, on, how in self.joins:
            df = df.join(other, expr(on) if not isinstance(on, list) else on, how)
        for c in self.conditions:
            df = df.where(expr(c))
        if self.aggregates:
            df = df.groupBy(*self.groups).agg(*self.aggregates)
        for c in self.group_conditions:
            df = df.where(expr(c))
        if self.order:
            df = df.orderBy(*[F.col(n).asc_nulls_last() if a else F.col(n).desc_nulls_first() for n, a in self.order])
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*[expr(f) for f in self.fields]) if self.fields else df


@dataclass(frozen=True)
class Change:
    """INSERT, UPDATE and DELETE on one table, each as the table that results; a writer such as a versioned table takes it from there.

    `where` conditions all have to hold, and null is not holding, as in SQL; without any, every row is meant. Each call gives a new change.
    """

    conditions: tuple = ()
    others: tuple = ()

    def where(self, condition) -> Change:
        return replace(self, conditions=(*self.conditions, condition))

    def using(self, other: DataFrame, on: Sequence[str], columns: Mapping[str, str]) -> Change:
        """Take rows of another table by equal keys: `columns` gives its columns names that conditions and values can use. At most one row of it
        may have a key; rows without a partner are not meant."""
        return replace(self, others=(*self.others, (other, tuple(on), dict(columns))))

    def _met(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """The table with what `using` adds, and whether a row is meant; never null."""
        expr = lambda c: F.expr(c) if isinstance(c, str) else c
        met = F.lit(True)
        for n, (other, on, columns) in enumerate(self.others):
            keys = [F.col(f"`{k}`").alias(f"_on_{n}_{i}") for i, k in enumerate(on)]
            side = other.select(*keys, *[F.col(f"`{c}`").alias(a) for c, a in columns.items()], F.lit(True).alias(f"_met_{n}"))
            same = F.lit(True)
            for i, k in enumerate(on):
                same = same & (df[f"`{k}`"] == F.col(f"_on_{n}_{i}"))
            df, met = df.join(side, same, "left"), met & F.coalesce(F.col(f"_met_{n}"), F.lit(False))
        for c in self.conditions:
            met = met & F.coalesce(expr(c), F.lit(False))
        return df, met

    def insert(self, df: DataFrame, rows: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
        """The table and new rows. A column that these lack has its default, or is null; one that the table lacks is an error."""
        unknown = [c for c in rows.columns if c not in df.columns]
        if unknown:
            raise ValueError(f"the table has no columns {unknown}")
        kinds = {f.name: f.dataType for f in df.schema}
        value = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit((defaults or {}).get(c))
        return df.unionByName(rows.select(*[value(c).cast(kinds[c]).alias(c) for c in df.columns]))

    def update(self, df: DataFrame, **values) -> DataFrame:
        """The table with new values, expressions or columns over the old ones, in the rows that are meant; columns keep their types."""
        unknown = [c for c in values if c not in df.columns]
        if unknown:
            raise ValueError(f"the table has no columns {unknown}")
        wide, met = self._met(df)
        kinds = {f.name: f.dataType for f in df.schema}
        new = {c: (F.expr(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast(kinds[c]) for c, v in values.items()}
        return wide.select(*[F.when(met, new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])

    def delete(self, df: DataFrame) -> DataFrame:
        """The table without the rows that are meant."""
        wide, met = self._met(df)
        return wide.where(~met).select(*[F.col(f"`{c}`") for c in df.columns])

    def count(self, df: DataFrame) -> DataFrame:
        """(rows): how many rows are meant."""
        wide, met = self._met(df)
        return wide.agg(F.count_if(met).alias("rows"))


def strategy(sql: str) -> str:
    """How shards' results of a query are merged: aggregate, top_n, join or union."""
    s = sql.lower()
    if any(w in s for w in ("group by", "count(", "sum(")):
        return "aggregate"
    if "order by" in s and "limit" in s:
        return "top_n"
    return "join" if "join" in s else "union"


def identifier(name: str, dialect: str) -> str:
    """A quoted identifier."""
    mark = {"mysql": "`", "mariadb": "`", "tidb": "`"}.get(dialect.lower(), '"')
    if dialect.lower() == "mssql":
        return f"[{name.replace(']', ']]')}]"
    return f"{mark}{name.replace(mark, mark * 2)}{mark}"


def placeholder(style: str, i: int) -> str:
    """The i-th (from 1) parameter mark of a style: question, dollar, at, colon."""
    return {"question": "?", "dollar": f"${i}", "at": f"@p{i}", "colon": f":{i}"}[style]


def insert_text(table: str, columns: Sequence[str], style: str = "question", rows: int = 1) -> str:
    """INSERT with parameter marks for so many rows."""
    n = len(columns)
    groups = ["(" + ", ".join(placeholder(style, r * n + k + 1) for k in range(n)) + ")" for r in range(rows)]
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES {', '.join(groups)}"


def update_text(table: str, columns: Sequence[str], key: Sequence[str], style: str = "question") -> str:
    """UPDATE by key with parameter marks."""
    sets = ", ".join(f"{c} = {placeholder(style, k)}" for k, c in enumerate(columns, 1))
    where = " AND ".join(f"{c} = {placeholder(style, k)}" for k, c in enumerate(key, len(columns) + 1))
    return f"UPDATE {table} SET {sets} WHERE {where}"


def delete_text(table: str, key: Sequence[str], style: str = "question") -> str:
    """DELETE by key with parameter marks."""
    return f"DELETE FROM {table} WHERE " + " AND ".join(f"{c} = {placeholder(style, k)}" for k, c in enumerate(key, 1))


def insert_select(mapping: Mapping[str, str], source: str, target: str) -> str:
    """INSERT of the mapped columns of one table into another."""
    return f"INSERT INTO {target} ({', '.join(mapping.values())}) SELECT {', '.join(f'{source}.{c}' for c in mapping)} FROM {source}"


def transfer_script(mappings: Mapping[tuple[str, str], Mapping[str, str]], style: str = "question") -> list[str]:
    """For each (source table, target table) the SELECT to read and the INSERT to write its mapped columns."""
    out = []
    for (source, target), columns in mappings.items():
        out += [f"SELECT {', '.join(columns)} FROM {source}", insert_text(target, list(columns.values()), style)]
    return out


def value_text(value) -> str:
    """A Python value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def linked_statement(links: Sequence[tuple[str, str, object]], table: str, operation: str, style: str = "question") -> str:
    """INSERT with parameter marks or UPDATE with values, from linked fields (source, target, value); empty for none."""
    if operation.upper() not in ("INSERT", "UPDATE"):
        raise ValueError(f"unknown operation {operation}")
    if not links:
        return ""
    if operation.upper() == "INSERT":
        return insert_text(table, [t for _, t, _ in links], style)
    return f"UPDATE {table} SET " + ", ".join(f"{t} = {value_text(v)}" for _, t, v in links)


def create_text(table: str, columns: Mapping[str, str], absent: bool = True) -> str:
    """CREATE TABLE, by default only where there is none."""
    return f"CREATE TABLE {'IF NOT EXISTS ' if absent else ''}{table} ({', '.join(f'{c} {t}' for c, t in columns.items())})"


def drop_text(table: str, present: bool = True) -> str:
    """DROP TABLE, by default only where there is one."""
    return f"DROP TABLE {'IF EXISTS ' if present else ''}{table}"
