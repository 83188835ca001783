"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def number_rows(df: DataFrame, *keys: str, name: str = "row_number") -> DataFrame:
    """Add gapless row numbers from 0 in the order of `keys`.

    Rows are range-partitioned and sorted by the keys and written out once with their partition and
    their place in it; a partition's first number is the count of those before it. Only one count
    a partition reaches the driver. Rows equal in all keys get some order among themselves, by their place in the
    input, so that no partition grows with them; give keys that leave equal only rows that are alike.
    """
    place = F.monotonically_increasing_id()
    dealt = df.withColumn("_tie", place).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    held = materialize(dealt.withColumn("_at", place))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("_part")).count().collect()
    firsts, total = [], 0
    for r in sorted(counts):
        firsts.append((r[0], total))
        total += r[1]
    first = df.sparkSession.createDataFrame(firsts, "_part long, _first long")
    numbered = held.withColumn("_part", part).join(F.broadcast(first), "_part")
    return numbered.withColumn(name, F.col("_first") + at).select(*df.columns, name)
