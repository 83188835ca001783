"""Checking, cleaning and converting values by their declared types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column as a database declares it."""

    name: str
    data_type: str
    length: int | None = None
    nullable: bool = True
    default: str | None = None
    primary_key: bool = False
    auto_increment: bool = False


def family(data_type: str) -> str:
    """boolean, numeric, string or other, by the declared type's name."""
    t = data_type.lower()
    if t in ("boolean", "bool", "bit"):
        return "boolean"
    if any(w in t for w in ("char", "text", "string", "enum")):
        return "string"
    if t.split("(")[0].strip() != "point" and any(w in t for w in ("int", "float", "double", "decimal", "numeric", "real")):
        return "numeric"
    return "other"


def violations(value: Column, kind: T.DataType, declared: Field) -> Column:
    """What keeps a value from its declared field: null, type, length; an empty array if nothing does."""
    want = family(declared.data_type)
    have = "boolean" if isinstance(kind, T.BooleanType) else "numeric" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else "complex"
    fits = have == want or (have == "boolean" and declared.data_type.lower() == "tinyint")
    found = [F.when(value.isNull(), F.lit("null"))] if not declared.nullable else []
    if not fits:
        found.append(F.when(value.isNotNull(), F.lit("type")))
    elif declared.length is not None and have in ("numeric", "string"):
        found.append(F.when(F.octet_length(value.cast("string")) > declared.length, F.lit("length")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def cleaned(text: Column, declared: Field, trim: bool = True, null_to_default: bool = False) -> Column:
    """A text as its declared type, as text: numbers in their plain form, booleans as true or false, and
    what can't be read unchanged."""
    value = F.trim(text) if trim else text
    t = declared.data_type.lower()
    if "int" in t:
        value = F.coalesce(value.try_cast("bigint").cast("string"), value)
    elif any(w in t for w in ("float", "double", "decimal", "real")):
        value = F.coalesce(value.try_cast("double").cast("string"), value)
    elif t in ("boolean", "bool"):
        low = F.lower(value)
        value = F.when(low.isin("true", "1", "yes"), "true").when(low.isin("false", "0", "no"), "false").otherwise(value)
    if null_to_default and declared.default is not None:
        value = F.coalesce(value, F.lit(declared.default))
    return value


def converted(raw: Column, source_type: str, target_type: str, target_db: str) -> Column:
    """struct<target, rule> for a value that moves between databases: the literal to write, and why."""
    src, tgt = source_type.upper(), target_type.upper()
    quoted = F.concat(F.lit("'"), F.replace(raw, F.lit("'"), F.lit("''")), F.lit("'"))
    if tgt in ("BOOLEAN", "BOOL") and ("TINYINT" in src or src.startswith("BIT")):
        target, rule = F.when(F.lower(raw).isin("0", "false"), "false").otherwise("true"), "boolean"
    elif ("DATETIME" in src or "TIMESTAMP" in src) and (target_db.lower() == "sqlite" or tgt == "TEXT"):
        iso = F.when(F.contains(raw, F.lit("T")), raw).otherwise(F.replace(raw, F.lit(" "), F.lit("T")))
        target, rule = F.concat(F.lit("'"), iso, F.lit("'")), "iso datetime"
    elif src == "JSON" and tgt == "JSONB":
        target, rule = raw, "json"
    elif tgt == "BYTEA" and ("BLOB" in src or "BINARY" in src):
        target, rule = F.concat(F.lit("E'\\\\x"), F.lower(F.hex(F.encode(raw, "UTF-8"))), F.lit("'")), "bytea hex"
    else:
        target, rule = quoted, "text"
    none = raw.isNull() | (F.trim(raw) == "") | (F.lower(raw) == "null")
    return F.struct(F.when(none, "NULL").otherwise(target).alias("target"), F.when(none, "null").otherwise(F.lit(rule)).alias("rule"))


def converted_columns(df: DataFrame, links: Sequence[tuple[str, str, str, str]], target_db: str) -> DataFrame:
    """The linked columns (source name, source type, target name, target type) under their target names, as the literals
    to write in another database: a whole table of values in one pass."""
    return df.select(*[converted(F.col(s).cast("string"), st, tt, target_db)["target"].alias(t) for s, st, t, tt in links])
