"""Merging shards: unions, joins, aggregates, top-N and pages over a relation split in parts.

A logical table is a list of shard DataFrames, or one DataFrame with a shard column. Results follow SQL;
where a caller needs the text-comparing variants of older tools they are options.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialize
from ..sources.snapshots import row_hash
from .ordering import number_in_groups

#: Rows of the left and of the right side in one cell of a many-to-many join, pairs of rows and rows in one of its tasks, on average.
CELL, PAIRS, ROWS = (4096, 4096), 1 << 25, 1 << 16
#: Right rows in one block of a cell. Parquet packs values by eights, 504 in a run: blocks of a third of that repeat byte by byte.
BLOCK = 168


def union_all(shards: Sequence[DataFrame], fields: Sequence[str] | None = None) -> DataFrame:
    """All rows of all shards; a column that some shard lacks is null there."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    return out.select(*fields) if fields else out


def union_distinct(shards: Sequence[DataFrame], fields: Sequence[str] | None = None) -> DataFrame:
    """Each different row of all shards once."""
    return union_all(shards, fields).distinct()


def distinct_by(shards: Sequence[DataFrame], key: Sequence[str], latest: str) -> DataFrame:
    """One row per key: that with the greatest `latest`, which should tell the rows of a key apart."""
    rows = union_all(shards)
    rest = F.struct(latest, *[c for c in rows.columns if c != latest and c not in key])
    best = rows.groupBy(*key).agg(F.max(rest).alias("_best"))
    return best.select(*[F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def tag_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """The same query's result from several sources, with the source's name in `_source`."""
    return union_all([df.withColumn("_source", F.lit(name)) for name, df in tables.items()])


def _merged(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, null_safe: bool = False, hint: str | None = None) -> DataFrame:
    """Joined rows. One key column stands for keys of one name, with the value of whichever side has the row. Keys of different names
    both stay where rows of the right side alone can come back, else the left one. Of other columns of one name the right
    one's value counts, where there is a right row."""
    names = {c: f"_right_{k}" for k, c in enumerate(right.columns)}
    other = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.lit(True).alias("_right"))
    other = other.hint(hint) if hint else other
    a, b = left[f"`{left_key}`"], F.col(names[right_key])
    on = a.eqNullSafe(b) if null_safe else a == b
    if how in ("left_semi", "left_anti"):
        return left.join(other, on, how)
    joined = left.join(other, on, how)
    keep = []
    for c in left.columns:
        mine = left[f"`{c}`"]
        if c == left_key == right_key:
            mine = F.coalesce(mine, b)
        elif c in names:
            mine = F.when(F.col("_right"), F.col(names[c])).otherwise(mine)
        keep.append(mine.alias(c))
    dropped = right_key if how in ("inner", "left", "left_outer", "leftouter") else None
    keep += [F.col(n).alias(c) for c, n in names.items() if c not in left.columns and c != dropped]
    return joined.select(*keep)


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join; every row that an outer join keeps has its key (see `_merged`). With `null_safe` null keys match each other.
    Strategy and skew are left to Spark."""
    return _merged(left, right, left_key, right_key, how, null_safe)


def many_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, condition: str | Column | None = None, null_safe: bool = False) -> DataFrame:
    """All columns of both sides where the keys are equal and the condition holds, for keys with very many rows on both sides. Columns of one name
    on both sides are an error.

    Pairs are many more than rows here, so tasks are cut by pairs: the rows of both sides are counted by key, and a key with very many pairs is a
    grid of cells. A row has one place on its own side, by a hash of all its columns, and is copied to each place of the other side, so each
    pair meets in one cell, in an equi-join of (key, cell) by sorting. Rows alike in all columns share a cell. The keys of grids reach all tasks: at
    most one in some thousand rows.

    With a condition the join tests the pairs itself. Without one the right rows of a cell are in blocks, and all left rows are paired with one block
    after the other, which costs no shuffle: in the result few right rows come round again and again, which files store in little room however
    many the right rows of a key are.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have the columns {sorted(clash)}")
    kind = left.select(f"`{left_key}`").union(right.select(f"`{right_key}`")).schema[0].dataType
    sides = [df.select("*", F.col(f"`{k}`").cast(kind).alias(n)) for df, k, n in ((left, left_key, "_a"), (right, right_key, "_b"))]
    if not null_safe:
        sides = [df.where(F.col(n).isNotNull()) for df, n in zip(sides, ("_a", "_b"))]
    same = F.col("_a").eqNullSafe(F.col("_b"))
    counts = [df.groupBy(n).agg(F.count("*").cast("double").alias(f"{n}_rows")) for df, n in zip(sides, ("_a", "_b"))]
    counted = materialize(counts[0].join(counts[1], same).select(F.col("_a").alias("_key"), "_a_rows", "_b_rows"))
    pairs, rows = counted.agg(F.coalesce(F.sum(F.col("_a_rows") * F.col("_b_rows")), F.lit(0.0)), F.coalesce(F.sum(F.col("_a_rows") + F.col("_b_rows")), F.lit(0.0))).first()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS + rows / ROWS))
    # The grid of each key that is near a cell's pairs or beyond its right rows, and the turns of a cell's left rows: one for each block there, on average.
    wide = [F.ceil(F.col(f"{n}_rows") / size).cast("int").alias(f"{n}_places") for n, size in zip(("_a", "_b"), CELL)]
    grid = counted.where((F.col("_a_rows") * F.col("_b_rows") > CELL[0] * CELL[1] / 8) | (F.col("_b_rows") > CELL[1])).select("_key", "_b_rows", *wide)
    grid = F.broadcast(grid.select("_key", "_a_places", "_b_places", F.ceil(F.col("_b_rows") / F.col("_b_places") / BLOCK).cast("int").alias("_turns")))
    cut = []
    for df, plain, n, other in ((sides[0], left, "_a", "_b"), (sides[1], right, "_b", "_a")):
        own = F.pmod(row_hash(plain.schema), F.coalesce(f"{n}_places", F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_places", F.lit(1)) - 1))
        placed = df.join(grid, F.col(n).eqNullSafe(F.col("_key")), "left").withColumns({"_own": own, "_other": copies})
        places = ("_own", "_other") if n == "_a" else ("_other", "_own")
        # Null fields of structs are equal. As the cell is the join's only key, and has one type on both sides, rows stay as they are dealt out here; doubles
        # would be dealt out anew, to give their zeros and NaN one form.
        key = F.when(F.col(n) == 0, "0").otherwise(F.col(n).cast("string")) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(n)
        cell = F.struct(key.alias("key"), *[F.coalesce(c, F.lit(0)).alias(x) for c, x in zip(places, "xy")], F.coalesce("_turns", F.lit(1)).alias("turns"))
        cut.append(placed.select(*[F.col(f"`{c}`") for c in plain.columns], cell.alias(f"{n}_cell")).repartition(tasks, f"{n}_cell"))
    on = F.col("_a_cell") == F.col("_b_cell")
    if condition is not None:
        on = on & (F.expr(condition) if isinstance(condition, str) else condition)
        return cut[0].join(cut[1].hint("merge"), on).select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])
    turns = cut[0].select("*", F.explode(F.sequence(F.lit(0), F.col("_a_cell.turns") - 1)).alias("_turn")).sortWithinPartitions("_a_cell", "_turn")
    # Always true, but Spark drops a sort below a join unless something above it depends on the order.
    turns = turns.withColumn("_turn", F.when(F.monotonically_increasing_id() >= 0, F.col("_turn")))
    number = F.row_number().over(Window.partitionBy("_b_cell").orderBy("_b_cell"))
    blocks = cut[1].select("_b_cell", F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_row"), F.floor((number - 1) / BLOCK).alias("_block"))
    blocks = blocks.groupBy("_b_cell", "_block").agg(F.collect_list("_row").alias("_rows"))
    # By a key of the join both sides would be dealt out anew, so the turn of a block is none.
    joined = turns.join(blocks.hint("merge"), on & (F.pmod("_block", F.col("_b_cell.turns")) - F.col("_turn") == 0))
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], F.inline("_rows"))


def lookup_join(probe: DataFrame, build: DataFrame, key: str, latest: str | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Inner join to at most one build row per key: the one with the greatest `latest`, if given.

    The build side is broadcast only when the optimizer knows it to be within `broadcast_bytes`; beyond
    that it is a shuffle join.
    """
    if latest:
        build = distinct_by([build], [key], latest)
    size = int(str(build._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return probe.join(F.broadcast(build) if size <= broadcast_bytes else build, key)


def merge_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join by sorting both sides."""
    return _merged(left, right, left_key, right_key, how, hint="merge")


def pairing_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Pair the rows of a key one to one, first with first in the given orders; rows left over and rows without a
    key go. No task sees all rows of a key, on either side."""
    a = number_in_groups(left, [key], [left_order], "_n")
    b = number_in_groups(right, [key], [right_order], "_n")
    return a.join(b, [key, "_n"]).drop("_n")


def join_on(left: DataFrame, right: DataFrame, condition: str | Column, how: str = "inner") -> DataFrame:
    """Join on any condition over both sides' columns."""
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, how)


def existing(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """The left rows whose key is on the right."""
    return left.join(right.select(*key), list(key), "left_semi")


def missing(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """The left rows whose key is not on the right."""
    return left.join(right.select(*key), list(key), "left_anti")


def aggregate(df: DataFrame, group_by: Sequence[str], **functions: tuple[str, str]) -> DataFrame:
    """Group and aggregate: name=(function, column). Functions: count, sum, avg, min, max, count_distinct.

    Sums and means are doubles and 0 over nothing; min and max over nothing are null.
    """
    made = []
    for name, (fn, column) in functions.items():
        if fn == "count":
            c = F.count("*") if column == "*" else F.count(column)
        elif fn in ("sum", "avg"):
            c = F.coalesce(getattr(F, fn)(F.col(column).cast("double")), F.lit(0.0))
        elif fn in ("min", "max", "count_distinct"):
            c = getattr(F, fn)(column)
        else:
            raise ValueError(f"unknown aggregate {fn}")
        made.append(c.alias(name))
    return df.groupBy(*group_by).agg(*made) if group_by else df.agg(*made)


def _order(keys: Sequence[tuple[str, bool]], text: bool = False) -> list[Column]:
    """Ascending keys have nulls last, descending ones first, as absent values sort after all others."""
    made = []
    for name, ascending in keys:
        c = F.col(name).cast("string") if text else F.col(name)
        made.append(c.asc_nulls_last() if ascending else c.desc_nulls_first())
    return made


def top_n(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int, text: bool = False) -> DataFrame:
    """The first n rows by (column, ascending) keys; with `text` values compare as text, so 10 is before 9.
    Each task keeps its own first n."""
    return df.orderBy(*_order(keys, text)).limit(n)


def sorted_merge(shards: Sequence[DataFrame], keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """All rows in the order of the keys."""
    return union_all(shards).orderBy(*_order(keys))


def page(df: DataFrame, keys: Sequence[tuple[str, bool]], offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit-1 in the order of the keys, over all shards together."""
    return df.orderBy(*_order(keys)).offset(offset).limit(limit)


def has_more(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """(total, has_more) for such a page."""
    return df.agg(F.count("*").alias("total")).select("total", (F.col("total") > offset + limit).alias("has_more"))
