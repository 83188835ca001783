"""Token ids in fixed-width bit-packed files.

A dataset is a folder of Parquet parts, so that Spark commits it as a whole on any store. Each row
is one packed block of consecutive documents in ascending doc_id order:

    part, block       place in the order: all rows sorted by these are the corpus
    first_id          ids in the part before this block
    bits              width of an id, the least that holds the vocabulary
    doc_ids           the documents of the block
    ends              where each document's ids end in the block; the first begins at 0
    payload           the ids, `bits` each, least significant bit first, padded to whole bytes

An id's bits lie at k * bits, so any run of ids is read without those before it; within a block the
ids are packed GRAIN at a time, each grain starting on a whole byte, which numpy unpacks at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .tokens import encoder, vocabulary_size

#: Ids that start on a whole byte together; a multiple of 8.
GRAIN = 1024
#: A block is closed once it holds this many ids (a longer document is a block of its own).
BLOCK_IDS = 32_768
SCHEMA = "part int, block int, first_id long, bits int, doc_ids array<long>, ends array<long>, payload binary"


def id_bits(vocabulary: int) -> int:
    """The least width that holds every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, least significant bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 64 * GRAIN):
        some = ids[at : at + 64 * GRAIN].view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(some, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes())
    return b"".join(out)


def unpack_ids(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 of a packed block, read without the others."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    grain = start // 8 * 8  # 8 ids end on a whole byte whatever their width
    raw = np.frombuffer(payload, np.uint8)[grain * bits // 8 : -(-stop * bits // 8)]
    flat = np.unpackbits(raw, bitorder="little")[(start - grain) * bits : (stop - grain) * bits].reshape(-1, bits)
    wide = np.zeros((len(flat), 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, order: str = "doc_id") -> DataFrame:
    """(doc_id, tie, ids) of each row: the ids of its whole text and `end_id`, in as few whole bytes each as
    hold the vocabulary, and a hash of the text."""
    width = 2 if id_bits(vocabulary_size(tokenizer)) <= 16 else 4

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            flat, at = enc.encode(batch.column("text"))
            n = len(at) - 1
            out = np.full(len(flat) + n, end_id, f"<u{width}")
            out[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(at))] = flat
            ends = (width * (at + np.arange(n + 1))).astype(np.int64)
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), ids], ["doc_id", "tie", "ids"])

    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    slim = docs.select(F.col(order).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    return slim.mapInArrow(run, "doc_id long, tie long, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, order: str = "doc_id") -> None:
    """Encode each whole text, end it with `end_id`, and write the ids in ascending `order`.

    Texts are encoded where they are read; their ids, not they, are range-partitioned and sorted, and
    packed where they then lie. A block holds about BLOCK_IDS ids, a longer document is one block, so a very
    long text needs memory for itself alone. Null and empty texts are the end id alone; null ids come first;
    rows with one id stand together, ordered by a hash of their texts; rows alike in both are dealt by their
    place in the input, so no partition grows with them. An empty table gives a folder without rows. Columns
    other than `order` and text are ignored whatever their names.
    """
    bits = id_bits(vocabulary_size(tokenizer))
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        ids_of: list[int | None] = []
        block, before, inside = 0, 0, 0

        def close():
            nonlocal block, before, inside
            ids = np.frombuffer(b"".join(held), kind)
            ends = np.cumsum([len(h) // ids.itemsize for h in held])
            row = {"part": part, "block": block, "first_id": before, "bits": bits, "doc_ids": ids_of, "ends": ends, "payload": pack_ids(ids, bits)}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))
            block, before, inside = block + 1, before + inside, 0
            held.clear()
            ids_of.clear()
            return out

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_numpy(zero_copy_only=False).tolist()):
                held.append(ids)
                ids_of.append(doc)
                inside += len(ids) // int(kind[-1])
                if inside >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    # Written out, as range partitioning reads its input twice.
    held = materialize(encoded(docs, tokenizer, end_id, order).withColumn("place", F.monotonically_increasing_id()), compression="zstd")
    keys = ("doc_id", "tie", "place")
    held.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids").mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    start counts the ids of all documents before it. One total a part reaches the driver. Rows come as they were written: a null or
    empty text is its end id alone, repeated rows are repeated, a null id comes first and stays null; files of an empty table give an empty one.
    Memory is a block of ids, or one longer text's.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.max(F.col("first_id") + F.element_at("ends", -1)).alias("n")).collect()
    firsts, total = [], 0
    for r in sorted(totals):
        firsts.append((r["part"], total))
        total += r["n"]
    first = spark.createDataFrame(firsts, "part int, _first long")

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("first_id", "_first", "bits", "doc_ids", "ends", "payload")]
            for first_id, base, bits, doc_ids, ends, payload in zip(*cols):
                starts = [0, *ends[:-1]]
                raw = memoryview(unpack_ids(payload, bits, 0, ends[-1]).tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                at = np.array(starts, np.int64) + base + first_id
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(at), pa.array(np.array(ends) - np.array(starts)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    bound_batches(spark)
    return blocks.join(F.broadcast(first), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
