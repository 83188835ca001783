"""Ranked lexical search: the best documents of each item, by integer impacts and thresholds seeded from stored ones."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize

TOP = 50
#: Bytes of items' terms that one slice of the items may have: what tasks and the driver hold of them.
SLICE_BYTES = 16_000_000
#: Cells of one table of scores (documents of a part of a batch x items), of 8 bytes.
CELLS = 1 << 21
#: Fixed: separators become spaces, A-Z lower case; every byte above 7F is part of a term.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in order: maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


class Terms:
    """The terms of one slice of the items as numbers, and the items of each term. Bounded by SLICE_BYTES."""

    def __init__(self, pairs: list[tuple[int, bytes]], items: int) -> None:
        self.number = {t: k for k, t in enumerate(sorted({t for _, t in pairs}))}
        at = np.array([[self.number[t], i] for i, t in pairs], np.int64).reshape(-1, 2)
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        self.term, self.item, self.items = at[:, 0], at[:, 1], items

    def __len__(self) -> int:
        return len(self.number)


def _postings(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document with a term its length, and of those of its terms that are among `terms` the
    numbers and counts."""
    number = terms.number

    def run(batches):
        for batch in batches:
            ids, lengths, which, times = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    found, count = np.unique(np.fromiter((x for x in map(number.get, words) if x is not None), np.int32), return_counts=True)
                    ids.append(k)
                    lengths.append(len(words))
                    which.append(found)
                    times.append(count)
            ends = np.cumsum([0, *map(len, which)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))) for x, t in ((which, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, df: int) -> int:
    """A term's weight in a corpus of so many documents with a term, df of which hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Impacts:
    """What a task needs to turn a batch of postings into impacts: the weight of each term, N and L."""

    def __init__(self, weights: np.ndarray, documents: int, total: int) -> None:
        self.weights, self.documents, self.total = weights, documents, total

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, impact) of each posting of the batch."""
        lists = batch.column("terms")
        per_row = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), per_row)
        term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        m = 50 + (50 * batch.column("n").to_numpy() * self.documents) // self.total
        return row, term, self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))


def _stored(postings: DataFrame, impacts: Impacts, terms: Terms, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The kth greatest impact of each term (0 where fewer documents hold it) and its greatest. Tasks keep k values a term."""

    def run(batches):
        held_t, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, term, value = impacts.of(batch)
            t, v = np.concatenate([held_t, term]), np.concatenate([held_v, value])
            order = np.lexsort((-v, t))
            first = np.flatnonzero(np.diff(t[order], prepend=-1))
            rank = np.arange(len(t)) - np.repeat(first, np.diff([*first, len(t)]))
            held_t, held_v = t[order][rank < k], v[order][rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(held_t.astype(np.int64)), pa.array(held_v)], ["term", "impact"])

    found = postings.mapInArrow(run, "term long, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    rows = found.withColumn("place", place).where(F.col("place") <= k).groupBy("term").agg(F.max("impact").alias("top"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth"))
    top, kth = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for r in rows.collect():
        top[r["term"]], kth[r["term"]] = r["top"], r["kth"] or 0
    return kth, top


class Plan:
    """For each item its threshold, and which of its terms can lift a document to it.

    An item's terms are sorted by their greatest impact. The longest tail of them whose greatest impacts sum to less
    than the threshold is not essential: a document with terms of the tail alone stays below the threshold, which k
    documents reach, so it can't be among the first k, not even by a tie.
    """

    def __init__(self, terms: Terms, top: np.ndarray, least: np.ndarray) -> None:
        self.items, self.least, self.terms, self.top = terms.items, least, terms, top
        order = np.lexsort((top[terms.term], terms.item))
        item, term = terms.item[order], terms.term[order]
        bound = np.cumsum(top[term])
        first = np.flatnonzero(np.diff(item, prepend=-1))
        before = np.repeat(np.where(first > 0, bound[first - 1], 0) if len(first) else first, np.diff([*first, len(item)]))
        tail = bound - before < least[item]
        #: The sum of the greatest impacts of each item's tail.
        self.tail_bound = np.zeros(self.items, np.int64)
        np.add.at(self.tail_bound, item[tail], top[term[tail]])
        self.parts = []
        for chosen in (~tail, tail):
            t, i = term[chosen], item[chosen]
            by = np.argsort(t, kind="stable")
            self.parts.append((i[by], np.searchsorted(t[by], np.arange(len(top) + 1))))

    def raised(self, least: np.ndarray) -> Plan:
        """The plan of higher thresholds."""
        return Plan(self.terms, self.top, np.maximum(self.least, least)) if (least > self.least).any() else self

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int):
        """Yield (row, item, score) of all candidates among `rows` documents, with their exact scores.

        Postings of essential terms make partial scores; where these and the bound of the tail reach the threshold the tail's
        postings are added. No score below its threshold is yielded.
        """
        step = max(1, CELLS // max(1, self.items))
        for lo in range(0, rows, step):
            a, b = np.searchsorted(row, (lo, lo + step))
            held = np.zeros((min(step, rows - lo), self.items), np.int64)
            self._add(held, 0, row[a:b] - lo, term[a:b], impact[a:b])
            open_ = (held > 0) & (held + self.tail_bound >= self.least)
            live = open_.any(1)[row[a:b] - lo]
            self._add(held, 1, (row[a:b] - lo)[live], term[a:b][live], impact[a:b][live])
            r, i = np.nonzero(open_ & (held >= np.maximum(self.least, 1)))
            yield r + lo, i, held[r, i]

    def _add(self, held: np.ndarray, part: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray, most: int = 4_000_000) -> None:
        items, at = self.parts[part]
        times = at[term + 1] - at[term]
        flat = held.reshape(-1)
        cut = np.flatnonzero(np.diff(np.cumsum(times) // most, prepend=0))
        for some in np.split(np.arange(len(row)), cut):
            n = times[some]
            which = np.repeat(some, n)
            item = items[at[term[which]] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            np.add.at(flat, row[which] * self.items + item, impact[which])


def _candidates(postings: DataFrame, impacts: Impacts, plan: Plan, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of each item that can be among its first k.

    Once a task holds k documents of an item, the score of the last is a bound of the item's kth too: thresholds rise with
    each batch.
    """

    def run(batches):
        now = plan
        item, doc, none, score = (np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            ids = batch.column("doc_id")
            null = np.asarray(ids.is_null())
            plain = ids.fill_null(0).to_numpy()
            for r, i, s in now.scores(*impacts.of(batch), batch.num_rows):
                item, doc, none, score = (np.concatenate(p) for p in ((item, i), (doc, plain[r]), (none, null[r]), (score, s)))
                order = np.lexsort((doc, none, -score, item))
                first = np.flatnonzero(np.diff(item[order], prepend=-1))
                rank = np.arange(len(item)) - np.repeat(first, np.diff([*first, len(item)]))
                item, doc, none, score = (x[order][rank < k] for x in (item, doc, none, score))
            least = np.zeros(plan.items, np.int64)
            if len(item):
                last = np.append(np.flatnonzero(np.diff(item)), len(item) - 1)
                full = np.diff(last, prepend=-1) == k
                least[item[last[full]]] = score[last[full]]
            now = now.raised(least)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=none.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending doc_id.

    The score is an integer sum of impacts over the item's different terms. One pass over the texts writes the postings of the
    items' terms; they give the corpus counts and document frequencies, and for each term its kth and its greatest impact. An
    item's kth score is at least the greatest of its terms' kth impacts: this seeds its threshold. Then each task makes candidates
    from essential terms alone (see `Plan`), bounds them, scores the rest exactly, keeps its own k best of each item and
    raises the thresholds by them. What is shuffled is k rows an item and task.

    Items are taken in slices of at most SLICE_BYTES of terms (a longer one is a slice of its own), each over all documents, so that neither the driver nor a
    task ever holds more of them. Null texts have no terms; an item without a term, or whose terms no document has with a positive
    weight, has no rows. Rows of one item_id are one item with the terms of all of them, and a null item_id is an id.
    Repeated documents count and are ranked each; a null doc_id comes last among equal scores. Empty tables give an empty one;
    other columns are left out. A very long text needs memory in proportion.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    known = materialize(_item_terms(items))
    size = known.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    slices, made = max(1, math.ceil(size / SLICE_BYTES)), []
    for part in range(slices):
        found = known.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part).collect()
        if found:
            made.append(_rank_slice(docs, [(r[0], bytes(r[1])) for r in found], k, kind))
    return reduce(DataFrame.union, made) if made else spark.createDataFrame([], schema)


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            which = np.repeat(np.arange(batch.num_rows), list(map(len, found))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, term binary")
    return rows.distinct()


def _rank_slice(docs: DataFrame, found: list, k: int, kind) -> DataFrame:
    spark = docs.sparkSession
    ids = list(dict.fromkeys(i for i, _ in found))
    at = {i: n for n, i in enumerate(ids)}
    terms = Terms([(at[i], t) for i, t in found], len(ids))
    postings = materialize(_postings(docs, terms))
    documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(len(terms), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r[0]] = weight(documents, r[1])
    impacts = Impacts(weights, documents, total)
    kth, top = _stored(postings, impacts, terms, k)
    least = np.zeros(len(ids), np.int64)
    np.maximum.at(least, terms.item, kth[terms.term])
    best = materialize(_ranked(_candidates(postings, impacts, Plan(terms, top, least), k), k))
    name = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind.simpleString()}")
    return best.join(name, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
