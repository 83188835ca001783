"""Best-fit packing of token sequences, planned on the histogram of lengths.

The plan knows only how many pieces have each length, at most `capacity` numbers, so its size
and time do not depend on the number of documents. Each piece then takes its slot by its rank
among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .tokens import encoder

CAPACITY = 2048
#: Pieces of one length are ranked in so many independent parts, or more where these would exceed so many rows, so
#: that a length that most pieces share is not ranked in one task.
RANK_PARTS, RANK_ROWS = 64, 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "plan_length long, lo long, hi long, first_sequence long, per_sequence long, base long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Encode each text, end it with `end_id` and cut what is longer than `capacity`.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), length and
    the CRC-32 of its ids. A null text is empty: one piece with the end id alone. Repeated rows are cut each, a null id stays, a
    very long text is many pieces and needs memory in proportion; an empty table gives an empty one; other columns are left out.
    """
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            rows = ([], [], [], [], [])
            flat, at = enc.encode(batch.column("text"))
            raw = memoryview(flat.tobytes())
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                n = b - a + 1  # with the end id
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(raw[4 * (a + start) : 4 * min(a + start + length, b)])
                    crc = zlib.crc32(end, crc) if start + length == n else crc
                    for col, v in zip(rows, (doc, k, start, length, crc)):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Sequences with the same room are handled as one group, so a step places many pieces. Gives
    rows (length, lo, hi, first_sequence, per_sequence, base): the pieces of this length with rank
    lo <= rank < hi go, `per_sequence` to each, into the sequences from first_sequence on, at
    offset base + length * (place in the sequence).
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
    out, opened = [], 0
    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        left, rank = histogram[length], 0
        for room in range(length, capacity + 1):
            per = room // length
            while left and (room == capacity or rooms[room]):
                if room == capacity:
                    start, many = opened, -(-left // per)
                    opened += many
                else:
                    start, many = rooms[room].pop()
                used = min(many, -(-left // per))
                placed = min(left, used * per)
                out.append((length, rank, rank + placed, start, per, capacity - room))
                whole, rest = divmod(placed, per)
                if whole:
                    rooms[room - per * length].append((start, whole))
                if rest:
                    rooms[room - rest * length].append((start + whole, 1))
                if used < many:
                    rooms[room].append((start + used, many - used))
                rank, left = rank + placed, left - placed
            if not left:
                break
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, spread: str = "doc_id") -> DataFrame:
    """Give each piece its sequence_id and its offset there.

    `pieces` must have doc_id, piece and length and be materialised, as it is read three times. Equal
    rows are interchangeable; an empty table gives an empty table. Pieces of one length are ranked in
    parts (see RANK_PARTS), dealt by a hash of the column `spread`, which should tell rows apart. The
    histogram, at most capacity counts, and one count a part reach the driver; plan and counts are broadcast.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    shares = spark.createDataFrame([(n, max(RANK_PARTS, -(-c // RANK_ROWS))) for n, c in histogram.items()], "length long, _parts long")
    parted = pieces.join(F.broadcast(shares), "length").withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts")))
    before: list[tuple[int, int, int]] = []
    seen: dict[int, int] = defaultdict(int)
    for r in sorted(parted.groupBy("length", "_part").count().collect()):
        before.append((r["length"], r["_part"], seen[r["length"]]))
        seen[r["length"]] += r["count"]
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity), PLAN)
    offsets = spark.createDataFrame(before, "length long, _part long, _before long")
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", spread)
    ranked = (
        parted.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(offsets), ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    at = F.col("_rank") - F.col("lo")
    slot = (F.col("length") == F.col("plan_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    return ranked.join(F.broadcast(plan), slot).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence")).cast("long")).alias("sequence_id"),
        (F.col("base") + F.pmod(at, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces of at most `capacity` ids, packed into sequences.

    Edge cases: a null or empty text is one piece with the end id; repeated rows are packed each;
    a null doc_id is kept; a very long text is many pieces; columns other than doc_id and text are
    ignored whatever their names.
    """
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("_place", F.monotonically_increasing_id())
    return pack(materialize(pieces), capacity, "_place").drop("_place")
