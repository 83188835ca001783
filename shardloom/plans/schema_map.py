"""Mapping schemas between SQL dialects: type rules, field linking, DDL, versions.

Schemas are small, so this is plain Python; `rules_frame` gives the rules as a DataFrame for catalogs.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Field

DIALECTS = ("mysql", "mariadb", "tidb", "postgresql", "sqlite", "oracle", "mssql")

# Type rules by path as (source type, target type), and with "lossy" where the conversion loses something.
MYSQL_TO_POSTGRESQL = (
    ("TINYINT", "SMALLINT"), ("SMALLINT", "SMALLINT"), ("MEDIUMINT", "INTEGER"), ("INT", "INTEGER"), ("INTEGER", "INTEGER"), ("BIGINT", "BIGINT"),
    ("FLOAT", "REAL", "lossy"), ("DOUBLE", "DOUBLE PRECISION"), ("DECIMAL(10,0)", "NUMERIC(10,0)"), ("DECIMAL", "NUMERIC"), ("NUMERIC", "NUMERIC"),
    ("DATE", "DATE"), ("DATETIME", "TIMESTAMP", "lossy"), ("TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "lossy"), ("TIME", "TIME"), ("YEAR", "SMALLINT", "lossy"),
    ("CHAR(1)", "CHAR(1)"), ("CHAR", "CHAR"), ("VARCHAR(255)", "VARCHAR(255)"), ("VARCHAR", "VARCHAR"), ("TEXT", "TEXT"), ("TINYTEXT", "TEXT"), ("MEDIUMTEXT", "TEXT"),
    ("LONGTEXT", "TEXT"), ("BLOB", "BYTEA"), ("TINYBLOB", "BYTEA"), ("MEDIUMBLOB", "BYTEA"), ("LONGBLOB", "BYTEA"), ("BINARY(16)", "BYTEA"), ("VARBINARY(255)", "BYTEA"),
    ("JSON", "JSONB"), ("ENUM", "VARCHAR(255)", "lossy"), ("SET", "VARCHAR(255)", "lossy"), ("BOOLEAN", "BOOLEAN"), ("BIT(1)", "BOOLEAN", "lossy"), ("UUID", "UUID"),
    ("GEOMETRY", "GEOMETRY"),
)
MYSQL_TO_SQLITE = (
    ("TINYINT", "INTEGER"), ("SMALLINT", "INTEGER"), ("MEDIUMINT", "INTEGER"), ("INT", "INTEGER"), ("INTEGER", "INTEGER"), ("BIGINT", "INTEGER"), ("FLOAT", "REAL"),
    ("DOUBLE", "REAL", "lossy"), ("DECIMAL(10,0)", "NUMERIC(10,0)"), ("DECIMAL", "NUMERIC"), ("NUMERIC", "NUMERIC"), ("DATE", "TEXT", "lossy"),
    ("DATETIME", "TEXT", "lossy"), ("TIMESTAMP", "TEXT", "lossy"), ("TIME", "TEXT", "lossy"), ("YEAR", "INTEGER"), ("CHAR(1)", "TEXT(1)"), ("CHAR", "TEXT"),
    ("VARCHAR(255)", "TEXT(255)"), ("VARCHAR", "TEXT"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("JSON", "TEXT"), ("BOOLEAN", "INTEGER"),
)
POSTGRESQL_TO_MYSQL = (
    ("SMALLINT", "SMALLINT"), ("INTEGER", "INT"), ("BIGINT", "BIGINT"), ("REAL", "FLOAT"), ("DOUBLE PRECISION", "DOUBLE"), ("NUMERIC", "DECIMAL"), ("DATE", "DATE"),
    ("TIME", "TIME"), ("TIMESTAMP", "DATETIME", "lossy"), ("TIMESTAMP WITH TIME ZONE", "TIMESTAMP", "lossy"), ("BOOLEAN", "TINYINT(1)"), ("TEXT", "TEXT"),
    ("VARCHAR(255)", "VARCHAR(255)"), ("CHAR(1)", "CHAR(1)"), ("BYTEA", "BLOB"), ("JSONB", "JSON"), ("JSON", "JSON"), ("UUID", "CHAR(36)", "lossy"),
    ("SERIAL", "INT AUTO_INCREMENT"), ("BIGSERIAL", "BIGINT AUTO_INCREMENT"), ("MONEY", "DECIMAL(19,2)"), ("INET", "VARCHAR(45)", "lossy"),
    ("CIDR", "VARCHAR(45)", "lossy"), ("MACADDR", "VARCHAR(17)", "lossy"),
)
POSTGRESQL_TO_SQLITE = (
    ("SMALLINT", "INTEGER"), ("INTEGER", "INTEGER"), ("BIGINT", "INTEGER"), ("REAL", "REAL"), ("DOUBLE PRECISION", "REAL", "lossy"), ("NUMERIC", "NUMERIC"),
    ("DATE", "TEXT", "lossy"), ("TIME", "TEXT", "lossy"), ("TIMESTAMP", "TEXT", "lossy"), ("TIMESTAMP WITH TIME ZONE", "TEXT", "lossy"), ("BOOLEAN", "INTEGER"),
    ("TEXT", "TEXT"), ("VARCHAR(255)", "TEXT(255)"), ("BYTEA", "BLOB"), ("JSONB", "TEXT", "lossy"), ("UUID", "TEXT(36)", "lossy"),
)
SQLITE_TO_MYSQL = (("INTEGER", "BIGINT", "lossy"), ("REAL", "DOUBLE"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("NUMERIC", "DECIMAL(10,0)"))
SQLITE_TO_POSTGRESQL = (("INTEGER", "BIGINT", "lossy"), ("REAL", "DOUBLE PRECISION"), ("TEXT", "TEXT"), ("BLOB", "BYTEA"), ("NUMERIC", "NUMERIC(10,0)"))
# Oracle's types by group, what a group is in MySQL, PostgreSQL and SQLite, and what any other type is there.
ORACLE_GROUPS = (
    (("VARCHAR2", "CHAR", "NCHAR", "NVARCHAR2"), ("VARCHAR", "VARCHAR", "TEXT")),
    (("NUMBER",), ("BIGINT", "BIGINT", "INTEGER")),
    (("FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE"), ("DOUBLE", "DOUBLE PRECISION", "REAL")),
    (("DATE", "TIMESTAMP"), ("DATETIME", "TIMESTAMP", "TEXT")),
    (("CLOB", "NCLOB"), ("TEXT", "TEXT", "TEXT")),
    (("BLOB", "RAW", "LONG RAW"), ("BLOB", "BYTEA", "BLOB")),
    (("ROWID",), ("BIGINT", "BIGINT", "TEXT")),
)
ORACLE_OTHER = {"mysql": "VARCHAR", "postgresql": "VARCHAR", "sqlite": "TEXT"}
# Types that every dialect keeps.
KEPT = (
    "TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "DATE", "DATETIME", "TIMESTAMP", "TIME", "YEAR", "CHAR",
    "VARCHAR", "TEXT", "TINYTEXT", "MEDIUMTEXT", "LONGTEXT", "BLOB", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB", "BINARY", "VARBINARY", "JSON", "ENUM", "SET", "BOOLEAN", "BIT",
    "UUID",
)
PATHS = {
    ("mysql", "postgresql"): MYSQL_TO_POSTGRESQL, ("mysql", "sqlite"): MYSQL_TO_SQLITE, ("postgresql", "mysql"): POSTGRESQL_TO_MYSQL,
    ("postgresql", "sqlite"): POSTGRESQL_TO_SQLITE, ("sqlite", "mysql"): SQLITE_TO_MYSQL, ("sqlite", "postgresql"): SQLITE_TO_POSTGRESQL,
}
# Names that mean the same.
SYNONYMS = (
    ("created_at", "create_time"), ("created_at", "created_time"), ("updated_at", "update_time"), ("updated_at", "updated_time"), ("deleted_at", "delete_time"),
    ("user_id", "uid"), ("birthday", "birth_date"), ("phone", "mobile"), ("phone", "telephone"), ("email", "mail"), ("remark", "comment"), ("description", "desc"),
)
SAME_DIALECT = {"mariadb": "mysql", "tidb": "mysql"}


@dataclass(frozen=True)
class Rule:
    source_db: str
    source_type: str
    target_db: str
    target_type: str
    lossy: bool = False


@cache
def built_in_rules() -> tuple[Rule, ...]:
    """All rules: the written paths, Oracle's, and each dialect to itself."""
    out = [Rule(a, r[0], b, r[1], len(r) > 2) for (a, b), rows in PATHS.items() for r in rows]
    for k, target in enumerate(ORACLE_OTHER):
        out += [Rule("oracle", name, target, to[k]) for names, to in ORACLE_GROUPS for name in names]
    return tuple(out + [Rule(d, t, d, t) for d in DIALECTS for t in KEPT])


def rules_frame(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rules as a table, in order of priority."""
    rows = [(r.source_db, r.source_type, r.target_db, r.target_type, r.lossy, k) for k, r in enumerate(built_in_rules() if rules is None else rules)]
    return spark.createDataFrame(rows, "source_db string, source_type string, target_db string, target_type string, lossy boolean, priority int")


@lru_cache(4096)
def split_type(declared: str) -> tuple[str, str]:
    """A type's upper-case name and what stands in its parentheses."""
    m = re.fullmatch(r"([^(]+)(\([^)]*\))?(.*)", declared)
    name = " ".join(f"{m[1]} {m[3]}".split()).upper() if m else declared.strip().upper()
    return name, (m[2] or "") if m else ""


#: Target types that take the size of their source.
_SIZED = re.compile("(VAR)?CHAR|DECIMAL|NUMERIC|TEXT")


class TypeTable:
    """Type rules with those added by a caller; the first rule that fits wins. Rules are found by path and name, and
    what has been looked up is remembered."""

    def __init__(self, rules: Sequence[Rule] | None = None) -> None:
        self.rules = list(built_in_rules() if rules is None else rules)
        self._whole: dict[tuple[str, str, str], Rule] = {}
        self._named: dict[tuple[str, str, str], Rule] = {}
        self._any: dict[tuple[str, str, str], Rule] = {}
        self._found: dict[tuple[str, str, str], Rule | None] = {}
        for r in self.rules:
            self._index(r)

    def _index(self, r: Rule) -> None:
        name, size = split_type(r.source_type)
        self._whole.setdefault((r.source_db, r.target_db, name + size), r)
        self._any.setdefault((r.source_db, r.target_db, name), r)
        if not size:
            self._named.setdefault((r.source_db, r.target_db, name), r)

    def add(self, source_db: str, source_type: str, target_db: str, target_type: str, lossy: bool = False) -> None:
        self.rules.append(Rule(source_db, source_type.upper(), target_db, target_type, lossy))
        self._index(self.rules[-1])
        self._found.clear()

    def forget(self) -> None:
        """Forget what was looked up."""
        self._found.clear()

    def lookup(self, declared: str, source_db: str, target_db: str) -> Rule | None:
        """The rule of a declared type; lengths and scales carry over where the target has none of its own."""
        key = (declared, source_db, target_db)
        try:
            return self._found[key]
        except KeyError:
            return self._found.setdefault(key, self._look_up(*key))

    def _look_up(self, declared: str, source_db: str, target_db: str) -> Rule | None:
        name, size = split_type(declared)
        a, b = SAME_DIALECT.get(source_db, source_db), SAME_DIALECT.get(target_db, target_db)
        if name == "TINYINT" and size == "(1)" and (a, b) == ("mysql", "postgresql"):
            return Rule(source_db, declared, target_db, "BOOLEAN")
        for path in ((source_db, target_db), (a, b)):
            if r := self._whole.get((*path, name + size)):
                return Rule(r.source_db, declared, r.target_db, r.target_type, r.lossy)
            if r := self._named.get((*path, name)) or self._any.get((*path, name)):
                base = r.target_type if split_type(r.source_type)[1] == "" else split_type(r.target_type)[0]
                carried = size if size and "(" not in base and (_SIZED.match(base) or path[0] == path[1]) else ""
                return Rule(r.source_db, declared, r.target_db, base + carried, r.lossy)
        if a == "oracle" and b in ORACLE_OTHER:
            return Rule(source_db, declared, target_db, ORACLE_OTHER[b])
        return None


@cache
def built_in_types() -> TypeTable:
    """The table of the built-in rules, made once; add rules to a TypeTable of your own."""
    return TypeTable()


def convert_declared(df: DataFrame, column: str, source_db: str, target_db: str, types: TypeTable | None = None) -> DataFrame:
    """Add target_type and lossy for a column of declared types; both null where no rule fits. A join with the rules, by
    the whole type first and then by its name; a size goes along as in `TypeTable.lookup`."""
    table = types or built_in_types()
    a, b = SAME_DIALECT.get(source_db, source_db), SAME_DIALECT.get(target_db, target_db)
    rows: dict[str, tuple] = {}
    for r in table.rules:
        if (r.source_db, r.target_db) in ((source_db, target_db), (a, b)):
            name, size = split_type(r.source_type)
            base = r.target_type if not size else split_type(r.target_type)[0]
            carry = "(" not in base and bool(_SIZED.match(base) or a == b)
            rows.setdefault(name + size, (name + size, r.target_type if size else base, r.lossy, carry and not size))
            rows.setdefault(name, (name, base, r.lossy, carry))
    if (a, b) == ("mysql", "postgresql"):
        rows["TINYINT(1)"] = ("TINYINT(1)", "BOOLEAN", False, False)
    rules = df.sparkSession.createDataFrame(list(rows.values()), "_type string, _target string, _lossy boolean, _carry boolean")
    size = F.regexp_extract(column, r"\(.*?\)", 0)
    name = F.trim(F.regexp_replace(F.upper(F.regexp_replace(F.col(column), r"\(.*?\)", " ")), r"\s+", " "))
    known = F.broadcast(rules)  # the rules of one path, a few dozen rows
    out = df.withColumns({"_size": size, "_name": name, "_full": F.concat(name, size)})
    out = out.join(known.select(F.col("_type").alias("_full"), F.struct("_target", "_lossy", "_carry").alias("_whole")), "_full", "left")
    out = out.join(known.select(F.col("_type").alias("_name"), F.struct("_target", "_lossy", "_carry").alias("_by_name")), "_name", "left")
    r = F.coalesce("_whole", "_by_name")
    other = F.lit(ORACLE_OTHER.get(b) if a == "oracle" else None).cast("string")
    target = F.coalesce(F.concat(r["_target"], F.when(r["_carry"], F.col("_size")).otherwise("")), other)
    return out.select(*df.columns, target.alias("target_type"), F.coalesce(r["_lossy"], F.when(other.isNotNull(), False)).alias("lossy"))


@dataclass(frozen=True)
class Link:
    source: str
    target: str | None
    confidence: float
    kind: str
    transform: str | None = None


@lru_cache(4096)
def snake(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


# How the types of a family begin.
FAMILIES = {
    "int": ("int", "tinyint", "smallint", "mediumint", "bigint"), "text": ("varchar", "char", "text", "nvarchar"), "decimal": ("decimal", "numeric", "number"),
    "float": ("float", "double", "real"), "datetime": ("datetime", "timestamp"), "blob": ("blob", "bytea", "binary"),
}


@lru_cache(4096)
def type_family(declared: str) -> str:
    """int, text, decimal, float, datetime, blob, bool or other."""
    t = declared.lower().strip()
    if t in ("boolean", "bool", "tinyint(1)"):
        return "bool"
    for name, starts in FAMILIES.items():
        if t.startswith(starts):
            return name
    return "datetime" if t in ("date", "time") else "other"


_PARTNERS: dict[str, list[str]] = {}
for _one, _other in SYNONYMS:
    _PARTNERS.setdefault(_one, []).append(_other)
    _PARTNERS.setdefault(_other, []).append(_one)


class _Free:
    """Target fields not yet linked, in their order under each of their keys."""

    def __init__(self, fields: Sequence[Field], key) -> None:
        self.by: dict[str, deque[Field]] = {}
        for f in fields:
            self.by.setdefault(key(f), deque()).append(f)

    def first(self, key: str, taken: set[str]) -> Field | None:
        held = self.by.get(key)
        while held and held[0].name in taken:
            held.popleft()
        return held[0] if held else None


def link_fields(source: Sequence[Field], target: Sequence[Field], manual: dict[str, str] | None = None) -> list[Link]:
    """Link each source field to at most one target field: by hand, by name, without regard to case, by
    naming style, by meaning, by type; each target once."""
    targets = list({t.name: t for t in target}.values())
    named = {t.name: t for t in targets}
    place = {t.name: k for k, t in enumerate(targets)}
    lower, styled, typed = _Free(targets, lambda t: t.name.lower()), _Free(targets, lambda t: snake(t.name)), _Free(targets, lambda t: type_family(t.data_type))
    taken: set[str] = set()
    out = []

    def find(s: Field) -> tuple[str, float, Field | None]:
        by_hand = (manual or {}).get(s.name)
        if by_hand in named and by_hand not in taken:
            return "manual", 1.0, named[by_hand]
        if s.name in named and s.name not in taken:
            return "exact", 1.0, named[s.name]
        if t := lower.first(s.name.lower(), taken):
            return "case_insensitive", 0.95, t
        if t := styled.first(snake(s.name), taken):
            return "naming", 0.9, t
        near = [t for p in _PARTNERS.get(s.name.lower(), ()) if (t := lower.first(p, taken))]
        if near:
            return "semantic", 0.8, min(near, key=lambda t: place[t.name])
        family = type_family(s.data_type)
        return "type", 0.6, typed.first(family, taken) if family != "other" else None

    for s in source:
        kind, confidence, t = find(s)
        if t is None:
            out.append(Link(s.name, None, 0.0, "unmatched"))
            continue
        taken.add(t.name)
        cast = s.data_type != t.data_type and type_family(s.data_type) == type_family(t.data_type) == "datetime" and s.data_type.lower() != t.data_type.lower()
        out.append(Link(s.name, t.name, confidence, kind, f"CAST({s.name} AS TIMESTAMP)" if cast else None))
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def match_fields(source: Sequence[Field], target: Sequence[Field], threshold: float = 0.6) -> list[Link]:
    """The best target of each source field: same name 1, same core name 0.95, similar name, same type 0.5."""
    def core(name: str) -> str:
        return re.sub("(_id|_name)$", "", re.sub("^(tbl_|tab_)", "", name.lower()))

    out = []
    for s in source:
        best = Link(s.name, None, 0.0, "unmatched")
        for t in target:
            a, b = s.name.lower(), t.name.lower()
            like = 1 - edit_distance(a, b) / max(len(a), len(b), 1)
            if a == b:
                now = Link(s.name, t.name, 1.0, "exact")
            elif core(a) == core(b) or core(a) in core(b).split("_") or core(b) in core(a).split("_"):
                now = Link(s.name, t.name, 0.95, "core")
            elif like >= threshold:
                now = Link(s.name, t.name, round(like, 6), "similar")
            elif type_family(s.data_type) == type_family(t.data_type) != "other":
                now = Link(s.name, t.name, 0.5, "type")
            else:
                continue
            best = max(best, now, key=lambda x: x.confidence)
        out.append(best)
    return out


def mappings_of(links: Sequence[Link]) -> dict[str, str]:
    """The column mapping of the fields that are linked."""
    return {k.source: k.target for k in links if k.target is not None}


def auto_mappings(source: Sequence[Field], target: Sequence[Field], threshold: float = 0.5) -> dict[str, str]:
    """Each source field to the target field of its name, else to that of its type with the most similar name, if that
    is more similar than the threshold; a target may be taken twice."""
    names = {t.name for t in target}
    out = {}
    for s in source:
        if s.name in names:
            out[s.name] = s.name
            continue
        like = [(1 - edit_distance(s.name, t.name) / max(len(s.name), len(t.name), 1), t.name) for t in target if t.data_type.lower() == s.data_type.lower()]
        best = max(like, key=lambda x: x[0], default=(0.0, ""))
        if best[0] > threshold:
            out[s.name] = best[1]
    return out


def mapping_faults(mapping: dict[str, str], source_table: str, target_table: str) -> list[str]:
    """What keeps a mapping from use: names that are blank."""
    parts = [("source table", source_table), ("target table", target_table)]
    parts += [("source field", s) for s in mapping] + [("target field", t) for t in mapping.values()]
    return [f"the {what} is blank" for what, name in parts if not name.strip()]


# Kinds of stores.
KEY_VALUE_STORES = ("redis", "mongodb", "cassandra", "dynamodb", "taodb")
TIME_SERIES_STORES = ("influxdb", "timescaledb", "prometheus", "kdb+", "questdb")
STORES_WITHOUT_SQL = ("redis", "mongodb", "cassandra", "dynamodb")


def store_kind(db: str) -> str:
    """key_value, time_series or relational."""
    return "key_value" if db.lower() in KEY_VALUE_STORES else "time_series" if db.lower() in TIME_SERIES_STORES else "relational"


def supports_sql(db: str) -> bool:
    return db.lower() not in STORES_WITHOUT_SQL


@dataclass(frozen=True)
class Suggestion:
    """Advice for a conversion; no field where it is for the whole table."""

    kind: str
    field: str
    priority: str
    message: str


def suggestions(source: Sequence[Field], target: Sequence[Field], target_db: str, threshold: float = 0.6) -> list[Suggestion]:
    """What to look at when a table moves: fields linked by type alone, the shape of the store, fields without a target."""
    links = match_fields(source, target, threshold)
    out = [Suggestion("type_conversion", k.source, "medium", f"{k.source} goes to {k.target} by its type alone: see that values fit") for k in links if k.kind == "type"]
    if store_kind(target_db) == "key_value":
        out.append(Suggestion("structure", "", "high", "put several fields into one JSON value under a key made of the id"))
    if store_kind(target_db) == "time_series":
        out.append(Suggestion("structure", "", "high", "add a time column and partition by it"))
    return out + [Suggestion("missing_field", k.source, "high", f"{k.source} has no target field: map it by hand") for k in links if k.target is None]


def create_table(name: str, fields: Sequence[Field], dialect: str) -> str:
    """CREATE TABLE in a dialect."""
    from .builder import identifier

    lines = []
    for f in fields:
        kind = f.data_type + (f"({f.length})" if f.length and "(" not in f.data_type else "")
        line = f"  {identifier(f.name, dialect)} {kind}"
        if not f.nullable:
            line += " NOT NULL"
        if f.default is not None:
            line += f" DEFAULT {f.default}"
        if f.auto_increment and dialect in ("mysql", "mariadb", "tidb"):
            line += " AUTO_INCREMENT"
        lines.append(line)
    key = [identifier(f.name, dialect) for f in fields if f.primary_key]
    if key:
        lines.append(f"  PRIMARY KEY ({', '.join(key)})")
    return f"CREATE TABLE {identifier(name, dialect)} (\n" + ",\n".join(lines) + "\n)"


def empty_frame(spark: SparkSession, fields: Sequence[Field]) -> DataFrame:
    """An empty table with the Spark types of declared fields; write it to make the table."""
    return spark.createDataFrame([], ", ".join(f"`{f.name}` {spark_type(f.data_type)}{'' if f.nullable else ' NOT NULL'}" for f in fields))


def create_index(name: str, table: str, columns: Sequence[str], dialect: str, unique: bool = False) -> str:
    from .builder import identifier

    return f"CREATE {'UNIQUE ' if unique else ''}INDEX {identifier(name, dialect)} ON {identifier(table, dialect)} ({', '.join(identifier(c, dialect) for c in columns)})"


@dataclass(frozen=True)
class Conversion:
    """A converted table: its fields in the target dialect, how many lose something, links and DDL."""

    fields: tuple[Field, ...]
    lossy: tuple[str, ...]
    unmapped: tuple[str, ...]
    links: tuple[Link, ...]
    ddl: str


def convert_table(name: str, fields: Sequence[Field], source_db: str, target_db: str, target: Sequence[Field] | None = None, types: TypeTable | None = None, manual: dict[str, str] | None = None, target_version: tuple[int, ...] | None = None) -> Conversion:
    """Map a table's types to another dialect, link it to an existing target if there is one, and write DDL."""
    types = types or built_in_types()
    out, lossy, unmapped = [], [], []
    for f in fields:
        r = types.lookup(f.data_type, source_db, target_db)
        if r is None:
            unmapped.append(f.name)
            out.append(f)
            continue
        kind = version_type(r.target_type, target_db, target_version)
        out.append(replace(f, data_type=kind))
        if r.lossy:
            lossy.append(f.name)
    links = link_fields(fields, target if target is not None else out, manual)
    return Conversion(tuple(out), tuple(lossy), tuple(unmapped), tuple(links), create_table(name, out, target_db))


def parse_version(text: str) -> tuple[int, int, int]:
    """The first three numbers of a version, before any parenthesis."""
    n = [int(x) for x in re.findall(r"\d+", text.split("(")[0])[:3]]
    return tuple(n + [0] * (3 - len(n)))  # type: ignore[return-value]


# Versions taken where none is given.
DEFAULT_VERSIONS = {"mysql": (8, 0, 32), "mariadb": (8, 0, 32), "tidb": (8, 0, 32), "postgresql": (16, 2, 0), "sqlite": (3, 45, 0), "oracle": (21, 0, 0), "mssql": (16, 0, 0)}


def version_type(declared: str, db: str, version: tuple[int, ...] | None = None) -> str:
    """A type as a version of the database has it: MySQL 8 keeps microseconds, PostgreSQL 10 has identity columns
    for SERIAL, SQLite 3.38 has JSONB."""
    v = version or DEFAULT_VERSIONS.get(db, (0, 0, 0))
    upper = declared.upper()
    if db in ("mysql", "mariadb", "tidb") and v >= (8,) and upper == "DATETIME":
        return "DATETIME(6)"
    if db == "postgresql" and v >= (10,) and "SERIAL" in upper and "IDENTITY" not in upper:
        return f"{'BIGINT' if 'BIGSERIAL' in upper else 'SMALLINT' if 'SMALLSERIAL' in upper else 'INTEGER'} GENERATED BY DEFAULT AS IDENTITY"
    if db == "sqlite" and v >= (3, 38) and upper == "JSON":
        return "JSONB"
    return declared


def upgrade_type(declared: str, db: str, source: tuple[int, ...], target: tuple[int, ...]) -> str:
    """A type after an upgrade of its database; unchanged if the target is not later. MySQL 8 has BOOLEAN for TINYINT(1) too."""
    if tuple(source) >= tuple(target):
        return declared
    if db in ("mysql", "mariadb", "tidb") and source[0] < 8 <= target[0] and declared.upper() == "TINYINT(1)":
        return "BOOLEAN"
    return version_type(declared, db, target) if version_type(declared, db, source) == declared else declared


def compatible_type(declared: str, db: str, version: tuple[int, ...]) -> str:
    """A type that a version of the database has: as `version_type`; TINYINT(1) is BOOLEAN in MySQL 8, TEXT is VARCHAR
    before PostgreSQL 14."""
    if db in ("mysql", "mariadb", "tidb") and version >= (8,) and declared.upper() == "TINYINT(1)":
        return "BOOLEAN"
    if db == "postgresql" and version < (14,) and declared.upper() == "TEXT":
        return "VARCHAR"
    return version_type(declared, db, version)


# The versions before which statements get a note.
NOTED_BEFORE = {"mysql": (8,), "mariadb": (8,), "tidb": (8,), "postgresql": (12,), "sqlite": (3, 35)}


def compatible_statement(sql: str, db: str, version: tuple[int, ...]) -> str:
    """The statement, with a note before it where the version lacks newer features."""
    least = NOTED_BEFORE.get(db)
    if least is None or tuple(version) >= least:
        return sql
    return f"/* {db} before {'.'.join(map(str, least))}: parts may not be supported */\n{sql}"


def migrate_table(name: str, fields: Sequence[Field], source_db: str, target_db: str, source_version: str = "", target_version: str = "", manual: dict[str, str] | None = None) -> Conversion:
    """Bring a table to another database and version: types are upgraded within the source's database if only the
    version changes, else converted, and fitted to the target's version."""
    a = parse_version(source_version) if source_version else DEFAULT_VERSIONS[source_db]
    b = parse_version(target_version) if target_version else DEFAULT_VERSIONS[target_db]
    if source_db == target_db:
        fields = [replace(f, data_type=upgrade_type(f.data_type, source_db, a, b)) for f in fields]
    return convert_table(name, fields, source_db, target_db, manual=manual, target_version=b)


def direction(source_db: str, target_db: str, source_version: str = "", target_version: str = "") -> str:
    """same, version, database or both: what a migration changes, by database and major.minor."""
    a = parse_version(source_version) if source_version else DEFAULT_VERSIONS[source_db]
    b = parse_version(target_version) if target_version else DEFAULT_VERSIONS[target_db]
    return {(True, True): "same", (True, False): "version", (False, True): "database", (False, False): "both"}[source_db == target_db, a[:2] == b[:2]]


# Names of declared types by the Spark type that holds them.
SPARK_TYPES = {
    "tinyint": ("TINYINT",), "smallint": ("SMALLINT", "YEAR", "INT2"), "int": ("MEDIUMINT", "INT", "INTEGER", "SERIAL", "INT4"), "bigint": ("BIGINT", "BIGSERIAL", "INT8", "ROWID"),
    "float": ("FLOAT", "REAL", "BINARY_FLOAT"), "double": ("DOUBLE", "DOUBLE PRECISION", "BINARY_DOUBLE"), "decimal(19,2)": ("MONEY",), "date": ("DATE",),
    "timestamp_ntz": ("DATETIME",), "timestamp": ("TIMESTAMP", "TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE"),
    "binary": ("BLOB", "TINYBLOB", "MEDIUMBLOB", "LONGBLOB", "BYTEA", "BINARY", "VARBINARY", "RAW", "LONG RAW", "GEOMETRY"), "boolean": ("BOOLEAN", "BOOL", "BIT"),
}


def spark_type(declared: str) -> str:
    """The Spark type of a declared one, as DDL."""
    name, size = split_type(declared)
    if name in ("DECIMAL", "NUMERIC", "NUMBER"):
        return f"decimal{size or '(10,0)'}"
    if name == "TINYINT" and size == "(1)":
        return "boolean"
    return next((t for t, names in SPARK_TYPES.items() if name in names), "string")
