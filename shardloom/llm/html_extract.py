"""Main text of web pages: templates are deduced from tokens that occur alike on the pages of a host, and what fills their
slots is extracted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .html_pages import ARTICLE, MAIN, TITLE, Page

#: A token is of a template if it is on so many pages of its host, and on this share of them.
LEAST_PAGES, SHARE = 3, 0.3
#: Templates are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20
#: Step and multipliers of the mixing function are fixed values (SplitMix64).
_STEP, _MUL1, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TOKENS = "site long, key long, support long, total long, vector_a long, vector_b long, place long"
TEMPLATE = "array<array<long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def _with_site(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, site): site is a hash of the host in the url; a url without one has an empty host."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(host).alias("site"))


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(site, key, support, total, vector_a, vector_b, place): for each token of each site the pages that hold it, its
    occurrences, its occurrence vector and the sum of its first places.

    The vector of (page, occurrences) pairs is told by two sums of 31-bit hashes of the pairs, which tasks add up before the
    shuffle: tokens with equal vectors have equal sums, and no list of pages is ever held, however many a site has.
    """

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            source, site = batch.column("html").to_pylist(), batch.column("site").to_numpy()
            keys, marks = [np.array(Page(t or "").keys, np.int64) for t in source], np.array([xxh64_intdigest(t or "") for t in source], np.uint64)
            sizes = list(map(len, keys))
            page, place = np.repeat(np.arange(len(keys)), sizes), np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
            key = np.concatenate([np.zeros(0, np.int64), *keys])
            order = np.lexsort((place, key, page))
            page, key, place = page[order], key[order], place[order]
            first = np.flatnonzero((np.diff(page, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0) | (np.arange(len(key)) == 0))
            times = np.diff([*first, len(key)])
            h = _mixed(marks[page[first]] + times.astype(np.uint64) * _STEP)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(site[page[first]]), pa.array(key[first]), pa.array(np.ones(len(first), np.int64)), pa.array(times.astype(np.int64)),
                    pa.array((h >> np.uint64(33)).astype(np.int64)), pa.array((h & np.uint64(2**31 - 1)).astype(np.int64)), pa.array(place[first]),
                ],
                ["site", "key", "support", "total", "vector_a", "vector_b", "place"],
            )

    rows = pages.select("site", "html").mapInArrow(run, TOKENS)
    return rows.groupBy("site", "key").agg(*[F.sum(c).alias(c) for c in ("support", "total", "vector_a", "vector_b", "place")])


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(site, class, tokens): tokens of a site with one occurrence vector, two or more of them, in the order of their mean first
    places, on enough pages of the site. Class 0 is on the most pages, then that with the most tokens."""
    vectors = occurrence_vectors(pages).where(F.col("support") >= LEAST_PAGES)
    same = ["site", "support", "total", "vector_a", "vector_b"]
    # Tokens of a class are on the same pages, so a class is never longer than a page.
    classes = vectors.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("held")).where(F.size("held") >= 2)
    # Only the urls are read for this; few classes of a site are left to be joined, however many pages it has.
    counts = pages.groupBy("site").agg(F.count("*").alias("pages"))
    kept = classes.join(counts, "site").where(F.col("support") >= SHARE * F.col("pages"))
    ranked = F.struct((-F.col("support")).alias("a"), (-F.size("held")).alias("b"), "held")
    listed = kept.groupBy("site").agg(F.array_sort(F.collect_list(ranked)).alias("classes"))
    return listed.select("site", F.posexplode(F.transform("classes", lambda c: F.transform(c["held"], lambda t: t["key"]))).alias("class", "tokens"))


def _templates(classes: DataFrame) -> DataFrame:
    """(site, template): the token keys of each class, by class."""
    return classes.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "tokens"))), lambda c: c["tokens"]).alias("template"))


class Template:
    """The classes of one site, ready to be laid on a page."""

    def __init__(self, classes: list[list[int]] | None) -> None:
        self.sizes = [len(c) for c in classes or ()]
        self.place = {k: (c, i) for c, keys in enumerate(classes or ()) for i, k in enumerate(keys)}

    def lay(self, keys: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """For each token its slot, as (class, tokens of the instance before it) of the innermost open instance, and (-2, -2) if
        it is of the template; and the classes that do not fit.

        An instance of a class is its tokens in order; instances nest whole into one slot of another. Where two classes cross, that
        on fewer pages is at fault.
        """
        slots, bad = [], set()
        stack: list[list[int]] = []
        for key in keys:
            at = self.place.get(key)
            if at is None:
                slots.append((stack[-1][0], stack[-1][1]) if stack else (-1, -1))
                continue
            slots.append((-2, -2))
            c, i = at
            while stack and stack[-1][0] > c and any(s[0] == c for s in stack):
                bad.add(stack.pop()[0])
            if stack and stack[-1][0] == c and stack[-1][1] == i:
                stack[-1][1] += 1
                if i + 1 == self.sizes[c]:
                    stack.pop()
            elif i == 0 and not (stack and stack[-1][0] == c):
                stack.append([c, 1])
            else:
                bad.add(c)
        return slots, bad | {c for c, _ in stack}


def _each_template(batch):
    """(page's place in the batch, Template) of each row; a site's template is built once a batch."""
    site, column, built = batch.column("site").to_pylist(), batch.column("template"), {}
    for k, s in enumerate(site):
        if s not in built:
            built[s] = Template(column[k].as_py())
        yield k, built[s]


def _beside(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """The pages with their site's template. It is broadcast if all are small, else joined; Spark then splits a site with many pages."""
    size = templates.agg(F.sum(F.aggregate("template", F.lit(0).cast("long"), lambda n, c: n + F.size(c) * 8 + 16))).first()[0] or 0
    return pages.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, "site", "left")


def valid_classes(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes whose tokens are in one order and whose instances nest, on every page of their site."""

    def run(batches):
        for batch in batches:
            bad = set()
            source, site = batch.column("html"), batch.column("site").to_pylist()
            for k, template in _each_template(batch):
                if template.sizes:
                    bad |= {(site[k], c) for c in template.lay(Page(source[k].as_py() or "").keys)[1]}
            s, c = zip(*sorted(bad)) if bad else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(c, pa.int32())], ["site", "class"])

    faults = _beside(pages.select("site", "html"), materialize(_templates(classes))).mapInArrow(run, "site long, class int").distinct()
    return classes.join(faults, ["site", "class"], "left_anti")


def main_blocks(page: Page, template: Template) -> list[str]:
    """The blocks of the page's article, in order.

    Within an article element, or else within main, all blocks are the article's. Elsewhere the blocks of the template go; of the
    others those in the slot with the most text that is no link stay, with those that share its element, and a first heading. Without a template
    the element with the most text, a paragraph's counting half for the element one further out, takes the slot's place.
    """
    blocks = page.blocks
    for inside in (ARTICLE, MAIN):
        chosen = [b[1] for b in blocks if b[3] & inside]
        if chosen:
            return chosen
    if not blocks:
        return []
    slots = template.lay(page.keys)[0]
    data = [b for b in blocks if slots[b[0]] != (-2, -2)] or blocks
    weigh = lambda b: max(0, len(b[1]) - 2 * b[2])
    slot_weight: dict = {}
    for b in data:
        slot_weight[slots[b[0]]] = slot_weight.get(slots[b[0]], 0) + weigh(b)
    if template.sizes and len(slot_weight) > 1:
        best = max(slot_weight, key=slot_weight.get)
        nodes = {b[4] for b in data if slots[b[0]] == best and weigh(b)}
        return [b[1] for b in data if slots[b[0]] == best or b[4] in nodes or b[3] & TITLE]
    score: dict[int, float] = {}
    for b in data:
        score[b[4]] = score.get(b[4], 0) + weigh(b)
        up = page.parents[b[4]]
        if up >= 0:
            score[up] = score.get(up, 0) + weigh(b) / 2
    best = max(score, key=score.get)
    below = [n == best for n in range(len(page.parents))]
    for n in range(best + 1, len(page.parents)):
        below[n] = below[page.parents[n]] if page.parents[n] >= 0 else False
    return [b[1] for b in data if below[b[4]] or b[3] & TITLE]


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of `pages`: the main text, its blocks joined by newlines, empty if there is none.

    Three passes read the pages: one for the occurrence vectors, by which tokens of a host are grouped into equivalence classes;
    one that drops classes whose tokens change order or whose instances cross; one that lays the template so found on each page and
    extracts (see `main_blocks`). A host on fewer than LEAST_PAGES pages has no template; a token must be on SHARE of its
    host's pages. A host with any number of pages is spread over all tasks: only sums and templates meet by host.

    Character references are decoded, white space within a block (`br` counts as such) becomes one space. A null
    html is an empty page; a null url, or one without a host, is of an empty host. Repeated rows are repeated; a very
    long page needs memory in proportion. Other columns are left out; an empty table gives an empty one.
    """
    bound_batches(pages.sparkSession)
    pages = _with_site(pages)
    classes = materialize(equivalence_classes(pages))
    valid = materialize(_templates(valid_classes(pages, classes)))

    def run(batches):
        for batch in batches:
            source = batch.column("html")
            made = ["\n".join(main_blocks(Page(source[k].as_py() or ""), template)) for k, template in _each_template(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string())], ["page_id", "url", "text"])

    return _beside(pages, valid).select("page_id", "url", "html", "site", "template").mapInArrow(run, "page_id long, url string, text string")
