"""Field-by-field comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sync import keyed_join, one_per_key, paired

#: Columns that change by themselves and are not compared by default.
IGNORED = ("updated_at", "created_at", "modified_at")


@dataclass(frozen=True)
class Rules:
    """How values are compared."""

    key: tuple[str, ...] = ("id",)
    ignore: tuple[str, ...] = IGNORED
    tolerance: float = 1e-4
    ignore_case: bool = False
    trim: bool = True
    #: Of rows that share a key the one with the greatest value here counts, then of the other columns.
    latest: str | None = None


WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def same_value(a: Column, b: Column, kind: T.DataType, rules: Rules, other: T.DataType | None = None) -> Column:
    """Null equals only null. Whole numbers are compared exactly, decimals by their exact difference and all
    other numbers by the tolerance, with NaN and each infinity equal to itself; texts exactly, or without regard
    to case, else without outer spaces. Never null. `other` is the type of b, where it is not that of a."""
    other = kind if other is None else other
    if isinstance(kind, WHOLE) and isinstance(other, WHOLE):
        return a.eqNullSafe(b)
    if isinstance(kind, (T.DecimalType, *WHOLE)) and isinstance(other, (T.DecimalType, *WHOLE)):
        same = F.abs(a - b) < F.lit(Decimal(str(rules.tolerance)))
    elif isinstance(kind, T.NumericType):
        same = a.cast("double").eqNullSafe(b.cast("double")) | (F.abs(a.cast("double") - b.cast("double")) < rules.tolerance)
    elif isinstance(kind, T.StringType) and rules.ignore_case:
        same = F.lower(a) == F.lower(b)
    elif isinstance(kind, T.StringType) and rules.trim:
        same = F.trim(a) == F.trim(b)
    elif isinstance(kind, (T.MapType, T.VariantType)):
        same = a.cast("string") == b.cast("string")
    else:
        same = a == b
    return (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & F.coalesce(same, F.lit(False)))


def _compared(source: DataFrame, target: DataFrame, rules: Rules) -> list[str]:
    return [c for c in source.columns if c in target.columns and c not in rules.key and c not in rules.ignore]


def _matched(source: DataFrame, target: DataFrame, rules: Rules, how: str = "inner") -> DataFrame:
    """(key..., _s, _t): one row of each side per key; a null key is a key like any other."""
    both = paired(source, target, rules.key, rules.latest)
    return both if how == "full" else both.where(F.col("_s").isNotNull() & F.col("_t").isNotNull())


def field_differences(source: DataFrame, target: DataFrame, rules: Rules) -> DataFrame:
    """(key..., field, source_value, target_value) of each differing field of rows in both, values as text."""
    fields = _compared(source, target, rules)
    kinds, others = ({f.name: f.dataType for f in df.schema} for df in (source, target))
    each = [
        F.when(
            ~same_value(F.col(f"_s.{c}"), F.col(f"_t.{c}"), kinds[c], rules, others[c]),
            F.struct(F.lit(c).alias("field"), F.col(f"_s.{c}").cast("string").alias("source_value"), F.col(f"_t.{c}").cast("string").alias("target_value")),
        )
        for c in fields
    ]
    return _matched(source, target, rules).select(*rules.key, F.explode(F.array_compact(F.array(*each))).alias("d")).select(*rules.key, "d.*")


def statistics(source: DataFrame, target: DataFrame, rules: Rules) -> DataFrame:
    """One row: source_rows, target_rows (one a key), matched_rows (key on both sides), diff_fields, missing_in_target,
    missing_in_source and match_percentage, 100 when both are empty. One full join of both sides."""
    fields = _compared(source, target, rules)
    kinds, others = ({f.name: f.dataType for f in df.schema} for df in (source, target))
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    wrong = F.lit(0)
    for c in fields:
        wrong = wrong + F.when(both & ~same_value(F.col(f"_s.{c}"), F.col(f"_t.{c}"), kinds[c], rules, others[c]), 1).otherwise(0)
    rows = _matched(source, target, rules, "full").agg(
        F.count("_s").alias("source_rows"), F.count("_t").alias("target_rows"), F.count_if(both).alias("matched_rows"),
        F.coalesce(F.sum(wrong), F.lit(0)).alias("diff_fields"),
        F.count_if(F.col("_t").isNull()).alias("missing_in_target"), F.count_if(F.col("_s").isNull()).alias("missing_in_source"),
    )
    most = F.greatest("source_rows", "target_rows")
    share = F.when(most == 0, 100.0).otherwise(F.col("matched_rows") * 100.0 / F.nullif(most, F.lit(0)))
    return rows.withColumn("match_percentage", F.round(share.cast("double"), 6))


def missing_rows(source: DataFrame, target: DataFrame, rules: Rules) -> DataFrame:
    """The source rows whose key the target lacks; a null key is a key like any other."""
    return keyed_join(source, target, rules.key, "left_anti")


def schema_differences(source: T.StructType, target: T.StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(field, issue, source, target); issue is missing_in_target, missing_in_source or different."""
    def shape(f: T.StructField) -> str:
        return f"{f.dataType.simpleString()}{'' if f.nullable else ' not null'}"

    s, t = {f.name: f for f in source}, {f.name: f for f in target}
    out = [(n, "missing_in_target", shape(f), None) for n, f in s.items() if n not in t]
    out += [(n, "missing_in_source", None, shape(f)) for n, f in t.items() if n not in s]
    out += [(n, "different", shape(f), shape(t[n])) for n, f in s.items() if n in t and shape(f) != shape(t[n])]
    return out


def literal(value: Column, kind: T.DataType) -> Column:
    """A SQL literal of a value."""
    if isinstance(kind, T.NumericType):
        shown = value.cast("string")
    elif isinstance(kind, T.BooleanType):
        shown = F.upper(value.cast("string"))
    else:
        shown = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(shown, F.lit("NULL"))


def sync_statements(source: DataFrame, target: DataFrame, table: str, rules: Rules) -> DataFrame:
    """(statement): INSERTs of rows the target lacks, UPDATEs of differing fields to the source's value and
    DELETEs of rows the source lacks."""
    kinds, others = ({f.name: f.dataType for f in df.schema} for df in (source, target))

    def where(row: str = "") -> Column:
        terms = [F.when(F.col(f"{row}{k}").isNull(), F.lit(f"{k} IS NULL")).otherwise(F.concat(F.lit(f"{k} = "), literal(F.col(f"{row}{k}"), kinds[k]))) for k in rules.key]
        return F.concat_ws(" AND ", *terms)

    columns = ", ".join(source.columns)
    values = F.concat_ws(", ", *[literal(F.col(c), kinds[c]) for c in source.columns])
    inserts = missing_rows(one_per_key(source, rules.key, rules.latest), target, rules).select(F.concat(F.lit(f"INSERT INTO {table} ({columns}) VALUES ("), values, F.lit(");")).alias("statement"))
    sets = [
        F.when(~same_value(F.col(f"_s.{c}"), F.col(f"_t.{c}"), kinds[c], rules, others[c]), F.concat(F.lit(f"{c} = "), literal(F.col(f"_s.{c}"), kinds[c])))
        for c in _compared(source, target, rules)
    ]
    change = F.concat_ws(", ", *sets)
    updates = _matched(source, target, rules).where(change != "").select(
        F.concat(F.lit(f"UPDATE {table} SET "), change, F.lit(" WHERE "), where(), F.lit(";")).alias("statement")
    )
    deletes = missing_rows(target, source, rules).select(F.concat(F.lit(f"DELETE FROM {table} WHERE "), where(), F.lit(";")).alias("statement"))
    return inserts.union(updates).union(deletes)


def report(stats, differences: Sequence, name: str) -> str:
    """A text report of one comparison; `differences` are the first rows to show."""
    lines = [f"Table {name}", f"  rows: {stats['source_rows']} and {stats['target_rows']}, matched {stats['matched_rows']} ({stats['match_percentage']} %)"]
    lines += [f"  missing: {stats['missing_in_target']} in target, {stats['missing_in_source']} in source", f"  differing fields: {stats['diff_fields']}"]
    return "\n".join(lines + [f"    {d['field']}: {d['source_value']} | {d['target_value']}" for d in differences])
