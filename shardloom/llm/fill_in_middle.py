"""Fill-in-the-middle documents: a prefix, a middle and a suffix, cut at units and put in another order."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: A unit is a word with the white space before it, or white space at the text's end. Some unit matches wherever the last one
#: ended, and its white space is read at most twice, so a text is read in linear time.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first digits of the sha256 of `seed:doc_id`. A null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def count_units(text: str) -> int:
    """First pass: the number of units; one match is held at a time."""
    return sum(1 for _ in UNIT.finditer(text))


def cut_places(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first `low` and the first `high` units end (low <= high), in code points. One lazy iterator of
    matches is advanced to the lower rank and from there to the higher; no list of units is made."""
    units: Iterator[re.Match] = UNIT.finditer(text)
    first = next(islice(units, low - 1, None)).end() if low else 0
    return first, next(islice(units, high - low - 1, None)).end() if high > low else first


def transform(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_places(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of `docs`.

    Of 100 documents about `rate` are cut into three parts at two drawn ranks of their n units; of these `spm_rate` in 100 have
    the suffix first (spm), the others the prefix (psm). What a document gets depends on its id and text alone, so rows
    alike give rows alike, in any order and after any loss of tasks. A null text counts as empty; empty texts, and
    texts that hold one of the three marks, stay plain, with null parts. A null doc_id draws as an empty one. Memory is a text and
    its output, at most one Arrow batch (see `bound_batches`) or one longer text. Other columns are left out, whatever
    their names; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            made = [transform(t.as_py() or "", i, seed, rate, spm_rate) for i, t in zip(ids, texts)]
            n, form, prefix, middle, output = zip(*made) if made else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone, by built-ins.

    No cut text holds a mark, and a mark can't arise across a seam, as it has its only `<` in front: the first
    place of each is that of the mark.
    """

    def between(start: str, end: str) -> Column:
        rest = F.substr(output, F.locate(start, output) + len(start))
        return F.substring_index(rest, end, 1)

    middle = F.substr(output, F.locate(MIDDLE, output) + F.lit(len(MIDDLE)))
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
