"""SimHash near-duplicates by a self-join of the binary trie of fingerprints."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, marked, materialize, release_since, texts_of
from .components import connected_components

SHINGLE_WORDS = 5
BUDGET = 3
SIMILARITY = 0.8
#: Two trie nodes are compared in one task once they hold this many fingerprints together.
NODE_PAIR = 8192
STEP_BITS = 2
#: Rows of whole node pairs that a task walks at a time.
WALKED = 1 << 16

#: Wide fingerprints decide which pairs of a group of candidates have their sets compared: words of 64 bits, and bits.
WIDE_WORDS, WIDE_BITS = 8, 512
#: These differ in at most the bits expected at the limit and so many deviations; a pair right there is missed by
#: this with a chance of 0.6 %.
DEVIATIONS = 2.5
#: Slack on the last comparison, far below the distance of two possible values.
SLACK = 1e-9
#: Shared shingles that are counted together as bits, and bytes of them gathered at a time.
BIT_COLUMNS, GATHER_BYTES = 1 << 16, 1 << 24
#: Step and multipliers of the mixing function are fixed values (SplitMix64).
MIX_STEP = 0x9E3779B97F4A7C15
#: Candidates share all BAND_ROWS min-hashes of one band at least; a pair right at the limit shares no band with chance MISS at most.
BAND_ROWS, MISS = 4, 0.02
#: Fingerprints of one crowded node that a task compares with as many others.
TILE = 4096
#: Bits in the table of sets and shared shingles of one task, at most.
TABLE_BITS = 1 << 28


def shingle_hashes(text: str, shingle_words: int) -> np.ndarray:
    """Hashes of the text's word shingles, one for each place, as big-endian 64-bit numbers.

    Words are maximal runs without ASCII white space, A-Z lower-cased, nothing else changed. A text
    with fewer words has its whole sequence as the only shingle; one with none has none.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    return np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, stops)), ">u8", n)


def _majority(hashes: np.ndarray) -> bytes:
    """For each of the 64 bits, whether more than half of the big-endian hashes have it, as 8 bytes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprint(text: str, shingle_words: int) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    return int.from_bytes(_majority(shingle_hashes(text, shingle_words)), "big")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """512-bit SimHash of the *set* of shingles: each hash is mixed into WIDE_WORDS words."""
    plain = np.unique(hashes).astype(np.uint64)
    return b"".join(_majority(_mixed(plain + np.uint64(MIX_STEP * (k + 1) % 2**64)).astype(">u8")) for k in range(WIDE_WORDS))


def bands_of(similarity: float) -> int:
    """The number of bands for that cosine: sets of cosine c have a Jaccard similarity of c^2 at least, which is the chance that they
    share a min-hash. It does not depend on the number of documents."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity ** (2 * BAND_ROWS)))


def band_keys(hashes: np.ndarray, bands: int, most: int = 1 << 18) -> np.ndarray:
    """One 64-bit number for each band: BAND_ROWS min-hashes of the *set* of shingles together. No number of a text without any."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = np.arange(1, bands * BAND_ROWS + 1, dtype=np.uint64)
    # Odd multipliers and shifts, mixed from the place of each min-hash.
    a, b = _mixed(k * np.uint64(MIX_STEP)) | np.uint64(1), _mixed(~k * np.uint64(MIX_STEP))
    least = np.full(len(k), 2**64 - 1, np.uint64)
    x = _mixed(hashes.astype(np.uint64))
    step = max(1, most // len(k))
    for at in range(0, len(x), step):
        np.minimum(least, ((x[at : at + step, None] * a + b) >> np.uint64(16)).min(0), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, BAND_ROWS).T:
        key = _mixed(key * np.uint64(MIX_STEP) + row)
    return key


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bands: int = 0) -> DataFrame:
    """(doc_id, tie, fp[, wide, bands, size]): the fingerprint of each whole text as a signed 64-bit number and a hash of the
    text, which tells apart rows of one id; with `bands` the 512-bit fingerprint and so many band keys as binary, and the number of
    shingles."""

    def run(batches):
        for batch in batches:
            prints, wides, keys, sizes = [], [], [], []
            for text in texts_of(batch):
                h = shingle_hashes(text, shingle_words)
                prints.append(int.from_bytes(_majority(h), "big"))
                if bands:
                    wides.append(wide_fingerprint(h))
                    keys.append(band_keys(h, bands).tobytes())
                    sizes.append(len(h))
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array(np.array(prints, np.uint64).view(np.int64))]
            if bands:
                columns += [pa.array(wides, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "fp", "wide", "bands", "size"][: len(columns)])

    bound_batches(docs.sparkSession)
    schema = "doc_id long, tie long, fp long" + ", wide binary, bands binary, size long" * bool(bands)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _tie(text).alias("tie")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(cid, shingles): of the rows that `wanted` (ROW_KEYS, cid) names, the distinct shingles, sorted, as the upper 32
    bits of their hashes. Of rows alike in id and text one counts."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle_words).astype(np.uint64) >> np.uint64(32)).astype("<u4").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), *_row_keys(F.col("doc_id").cast("long"), _tie(text)))
    return rows.join(small_side(wanted), ROW_KEYS).select("cid", "text").mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])


def _tie(text):
    """A hash of a text; that of a null text is 0."""
    return F.coalesce(F.when(text.isNotNull(), F.xxhash64(text)), F.lit(0).cast("long"))


# --- inside a task: two sorted arrays of fingerprints, as sub-tries ---


def _splits(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the ones of `bit` begin in each range, whose values agree above that bit."""
    zeros = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1) == 0)))
    return lo + zeros[hi] - zeros[lo]


def trie_pairs(a: np.ndarray, b: np.ndarray, top: int, budget: int, same: bool, leaf: int = 64, spent: int = 0, ranges: tuple | None = None):
    """Yield index pairs (i, j) with popcount(a[i] ^ b[j]) <= budget, a and b sorted uint64. With `ranges`, two arrays of starts and ends in a,
    which is b, each of them is walked for itself.

    The tries of both arrays are walked together from bit `top` - 1 down. Each frontier row is a
    pair of nodes, as index ranges, with the bits in which their paths differ; it goes as soon as
    these exceed the budget. Pairs of small nodes are compared outright. With `same` (a is b) each
    unordered pair comes once, i < j.
    """
    al, ah, bl, bh = (np.array([x]) for x in (0, len(a), 0, len(b))) if ranges is None else (*ranges, *ranges)
    used = np.full(len(al), spent)
    twin = np.full(len(al), same)
    for bit in range(top - 1, -2, -1):
        small = ((ah - al) * (bh - bl) <= leaf) if bit >= 0 else np.ones(len(al), bool)
        if small.any():
            yield from _compare(a, b, *(x[small] for x in (al, ah, bl, bh, twin)), budget)
        al, ah, bl, bh, used, twin = (x[~small] for x in (al, ah, bl, bh, used, twin))
        if not len(al):
            return
        am, bm = _splits(a, al, ah, bit), _splits(b, bl, bh, bit)
        parts = [
            (al, am, bl, bm, used, twin),
            (am, ah, bm, bh, used, twin),
            (al, am, bm, bh, used + 1, np.zeros_like(twin)),
            (am, ah, bl, bm, used + 1, np.zeros_like(twin)),
        ]
        keep = [(p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget) for p in parts]
        keep[3] &= ~twin  # a node paired with itself: its mixed children come once
        al, ah, bl, bh, used, twin = (np.concatenate([p[k][m] for p, m in zip(parts, keep)]) for k in range(6))


def _compare(a, b, al, ah, bl, bh, twin, budget, most: int = 2_000_000):
    """All index pairs of the given range pairs within the budget, in slices of about `most`."""
    sizes = (ah - al) * (bh - bl)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0))
    for rows in np.split(np.arange(len(sizes)), cut):
        n = sizes[rows]
        if not n.sum():
            continue
        which = np.repeat(rows, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (bh - bl)[which]
        i, j = al[which] + k // width, bl[which] + k % width
        near = (np.bitwise_count(a[i] ^ b[j]) <= budget) & (~twin[which] | (i < j))
        if near.any():
            yield i[near], j[near]


def forest(pairs, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """Root of each of n items after joining the index pairs; the root is the group's least index.
    With `root`, groups joined before are joined on."""
    root = np.arange(n) if root is None else root
    for i, j in pairs:
        while True:
            i, j = root[i], root[j]
            live = i != j
            if not live.any():
                break
            i, j = i[live], j[live]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root = root[root]
    return root


def _turned(fps: np.ndarray, by: int) -> np.ndarray:
    """Bits moved round to the left, as uint64."""
    return fps if not by % 64 else (fps << np.uint64(by % 64)) | (fps >> np.uint64(64 - by % 64))


PAIR = ("turn", "bits", "a", "b")


def _linked(batches, budget: int):
    """Rows (turn, bits, a, b, fp), sorted by them: star links of each node pair's forest, in the fingerprints' own order of bits.

    Small pairs are walked together, up to WALKED rows at a time; a pair's rows are never split.
    """
    held: list[pa.RecordBatch] = []
    waiting = 0

    def walk(rows: pa.Table):
        turn, bits, na, nb = (rows[c].to_numpy() for c in PAIR)
        fps = rows["fp"].to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in (turn, bits, na, nb)], axis=0)) + 1
        starts, ends = np.array([0, *edge]), np.array([*edge, len(fps)])
        src, dst = [], []

        def keep(values, root, by):
            far = np.flatnonzero(root != np.arange(len(root)))
            src.append(_turned(values[far], 64 - by))
            dst.append(_turned(values[root[far]], 64 - by))

        kinds = turn[starts] * 64 + bits[starts]
        own = na[starts] == nb[starts]
        for kind in np.unique(kinds[own]).tolist():
            # All nodes of one depth that meet themselves, in one walk.
            some = own & (kinds == kind)
            lo, hi = int(starts[some][0]), int(ends[some][-1])
            values = fps[lo:hi]
            ranges = starts[some] - lo, ends[some] - lo
            keep(values, forest(trie_pairs(values, values, 64 - kind % 64, budget, True, ranges=ranges), len(values)), kind // 64)
        for k in np.flatnonzero(~own).tolist():
            values = np.unique(fps[starts[k] : ends[k]])
            depth, x, y = int(bits[starts[k]]), int(na[starts[k]]), int(nb[starts[k]])
            cut = int(((values >> np.uint64(64 - depth)).astype(np.int64) == x).sum())  # x < y: the fingerprints of x come first
            pairs = ((i, j + cut) for i, j in trie_pairs(values[:cut], values[cut:], 64 - depth, budget, False, spent=(x ^ y).bit_count()))
            keep(values, forest(pairs, len(values)), int(turn[starts[k]]))
        made = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (src, dst)]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in made], ["src", "dst"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(c)[0].as_py() for c in PAIR)
        cols = [batch.column(c).to_numpy() for c in PAIR]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        if waiting >= WALKED and (first != last or len(edge)):
            cut = 0 if first != last else int(edge[0])
            yield walk(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, waiting, batch = [], 0, batch.slice(cut)
        held.append(batch)
        waiting += batch.num_rows
        last = tuple(int(c[-1]) for c in cols)
    if waiting:
        yield walk(pa.Table.from_batches(held))


def trie_self_join(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Star links (src, dst) that join exactly the fingerprints within `budget` bits of each other.

    `classes` has one row per distinct fingerprint, column fp, materialised. The 64 bits fall into budget + 1 blocks. Two fingerprints
    within the budget differ in no bit of some block, so each block in turn is put first, and the trie of that order is joined with itself
    with no error allowed in the block and the whole budget below it: a node meets itself alone there. That sends a fingerprint to budget + 1
    nodes, whatever their number. A pair of nodes that holds at most NODE_PAIR fingerprints goes to a task, any other is replaced by
    the pairs of its children, STEP_BITS deeper, that differ in at most `budget` bits, so no task grows with a crowded node. Within a task the
    walk goes on bit by bit. Links of one task are reduced to its forest, which keeps every connection.
    """
    spark = classes.sparkSession
    edges = [round(64 * k / (budget + 1)) for k in range(budget + 2)]
    turned = None
    for start, end in zip(edges, edges[1:]):
        fp = F.col("fp") if not start else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start))
        part = classes.select(F.lit(start).alias("turn"), F.lit(end - start).alias("block"), fp.alias("fp"))
        turned = part if turned is None else turned.union(part)
    block = {start: end - start for start, end in zip(edges, edges[1:])}
    node_at = lambda deeper: F.expr(f"shiftrightunsigned(fp, {64 - deeper} - block)")
    ready: list[tuple[int, DataFrame]] = []
    active, deeper = None, 0
    while True:
        nodes = turned.groupBy("turn", node_at(deeper).alias("node")).agg(F.count("*").alias("n"))
        if active is None:
            pairs = materialize(nodes.where("n > 1").select("turn", F.col("node").alias("a"), F.col("node").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb")))
        else:
            # Only children of crowded nodes are counted.
            crowded = active.select("turn", F.col("a").alias("up")).union(active.select("turn", F.col("b").alias("up"))).distinct()
            nodes = nodes.withColumn("up", F.shiftright("node", STEP_BITS)).join(crowded, ["turn", "up"], "left_semi")
            nodes = materialize(nodes.select("turn", "node", "n"))
            ends = F.array(*[F.lit(m).cast("long") for m in range(1 << STEP_BITS)])
            near = (
                active.withColumn("x", F.explode(ends)).withColumn("y", F.explode(ends))
                .select("turn", (F.shiftleft("a", STEP_BITS) + F.col("x")).alias("a"), (F.shiftleft("b", STEP_BITS) + F.col("y")).alias("b"))
                .where((F.col("a") <= F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= budget))
            )
            left = nodes.select("turn", F.col("node").alias("a"), F.col("n").alias("na"))
            right = nodes.select("turn", F.col("node").alias("b"), F.col("n").alias("nb"))
            pairs = materialize(near.join(left, ["turn", "a"]).join(right, ["turn", "b"]).where("a <> b or na > 1").select("turn", "a", "b", "na", "nb"))
        total = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        crowded = (total > NODE_PAIR) & F.lit(deeper + STEP_BITS + max(block.values()) < 64)
        ready.append((deeper, pairs.where(~crowded)))
        active = pairs.where(crowded).select("turn", "a", "b")
        if active.limit(1).count() == 0:
            break
        deeper += STEP_BITS

    sent = None
    for deeper, pairs in ready:
        both = pairs.select("turn", F.col("a").alias("node"), "a", "b").union(pairs.where("a <> b").select("turn", F.col("b").alias("node"), "a", "b"))
        placed = turned.select("turn", (F.col("block") + deeper).alias("bits"), node_at(deeper).alias("node"), "fp")
        rows = placed.join(both, ["turn", "node"]).select(*PAIR, "fp")
        sent = rows if sent is None else sent.union(rows)
    bound_batches(spark)
    dealt = sent.repartition(*PAIR).sortWithinPartitions(*PAIR, "fp")
    return dealt.mapInArrow(lambda batches: _linked(batches, budget), "src long, dst long")


# --- links by similarity: bands, wide fingerprints, sets of shingles ---


def wide_budget(similarity: float) -> int:
    """Differing bits of WIDE_BITS up to which two sets of shingles are a candidate pair for that similarity.

    Sets of cosine c differ in each bit with chance p = acos(c) / pi; the budget is the mean and DEVIATIONS deviations.
    """
    p = math.acos(similarity) / math.pi
    return int(WIDE_BITS * p + DEVIATIONS * math.sqrt(WIDE_BITS * p * (1 - p)))


def wide_pairs(a: np.ndarray, b: np.ndarray, budget: int, same: bool, rows: int = 256):
    """Yield index pairs of two arrays of wide fingerprints within the budget, i < j with `same`.

    Differing bits are summed word by word: over so many words that unrelated pairs are beyond the budget for all pairs
    of a slice, from there only for pairs still within it.
    """
    first = next((k for k in range(1, WIDE_WORDS) if 32 * k - 16 * math.sqrt(k) > budget), WIDE_WORDS)
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        used = np.zeros((len(part), len(b)), np.uint16)
        for k in range(first):
            used += np.bitwise_count(part[:, None, k] ^ b[None, :, k])
        i, j = np.nonzero(used <= budget)
        if same:
            i, j = (x[at + i < j] for x in (i, j))
        total = used[i, j].astype(np.int64)
        for k in range(first, WIDE_WORDS):
            total += np.bitwise_count(part[i, k] ^ b[j, k])
            near = total <= budget
            i, j, total = i[near], j[near], total[near]
        if len(i):
            yield at + i, j


def similar_pairs(pairs, sets: list[np.ndarray], similarity: float):
    """Yield of the index pairs those whose sets have that cosine or more, not joined by earlier ones: the number of
    shared elements over the root of the product of the sizes.

    Only elements in two sets or more can be shared: these are columns of bits, counted together.
    """
    sizes = np.array([len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    of = np.repeat(np.arange(len(sets)), sizes)
    use = times[column] > 1
    of, column = of[use], shared[column[use]]
    blocks = []
    for at in range(0, int((times > 1).sum()), BIT_COLUMNS):
        here = (column >= at) & (column < at + BIT_COLUMNS)
        wide = min(BIT_COLUMNS, int((times > 1).sum()) - at)
        bits = np.zeros((len(sets), -(-wide // 64) * 8), np.uint8)
        c = column[here] - at
        np.bitwise_or.at(bits, (of[here], c >> 3), (1 << (c & 7)).astype(np.uint8))
        blocks.append(bits.view(np.uint64))
    root = np.arange(len(sets))
    for i, j in pairs:
        rows = max(1, GATHER_BYTES // (8 * max([b.shape[1] for b in blocks], default=1)))
        for at in range(0, len(i), rows):
            p, q = i[at : at + rows], j[at : at + rows]
            least = np.minimum(sizes[p], sizes[q])
            open_ = (root[p] != root[q]) & (least >= similarity**2 * np.maximum(sizes[p], sizes[q]) - SLACK)
            p, q = p[open_], q[open_]
            common = sum((np.bitwise_count(b[p] & b[q]).sum(1, dtype=np.int64) for b in blocks), np.zeros(len(p), np.int64))
            near = common >= similarity * np.sqrt(sizes[p] * sizes[q]) - SLACK
            if near.any():
                p, q = p[near], q[near]
                root = forest([(p, q)], len(sets), root)
                yield p, q


GROUP = ("node", "a", "b")


def _by_group(batches, close):
    """Apply `close(key, table)` to the rows of each group; rows come grouped by GROUP."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in GROUP]
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *edge], [*edge, batch.num_rows]):
            if lo == hi:
                continue
            now = tuple(int(c[lo]) for c in cols)
            if now != key:
                if held:
                    yield close(key, pa.Table.from_batches(held))
                key, held = now, []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield close(key, pa.Table.from_batches(held))


def _tiled(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows of each node, dealt to (a, b): one for those that fit a task; a node in `crowded` is cut into so many parts, and each
    part goes to its pairs with all parts."""
    rows = rows.join(crowded, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = rows.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")}).drop("other", "parts")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _crowded(rows: DataFrame) -> DataFrame:
    """(node, parts) of the nodes that are too much for one task: by fingerprints, or by the bits of the table of their sets. A
    shared shingle is in two sets at least, so two parts of n sets with e shingles in all make a table of at most n e / 2 bits."""
    n = F.count("*")
    parts = F.greatest(F.ceil(n / TILE), F.ceil(F.sqrt(2.0 * n * F.sum("size") / TABLE_BITS)))
    return materialize(rows.groupBy("node").agg(parts.cast("long").alias("parts")).where("parts > 1"))


def _pairs_of(key, table: pa.Table, budget: int):
    """The table by part and cid, and the index pairs within the budget: of one part, or of one part with the other."""
    table = table.sort_by([("part", "ascending"), ("cid", "ascending")])
    words = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
    part = table["part"].to_numpy()
    if key[1] == key[2]:
        return table, wide_pairs(words, words, budget, True)
    cut = int((part == key[1]).sum())
    return table, ((i, j + cut) for i, j in wide_pairs(words[:cut], words[cut:], budget, False))


def _stars(root: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A link from each item that is no root to its root."""
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["src", "dst"])


def band_links(classes: DataFrame) -> DataFrame:
    """Star links (src, dst) between the cid of classes that share a band: to the least cid of each. No pair is listed: a band that very
    many classes share gives one link a class."""

    def run(batches):
        for batch in batches:
            held = batch.column("bands").to_pylist()
            times = np.array([len(k) // 8 for k in held], np.int64)
            keys = np.frombuffer(b"".join(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("cid").to_numpy(), times))], ["key", "cid"])

    rows = classes.select("cid", "bands").mapInArrow(run, "key long, cid long")
    # Written out, so that the join with a band of very many classes reads two plain shuffles.
    shared = materialize(rows.groupBy("key").agg(F.min("cid").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"))
    return rows.join(shared, "key").where("cid <> least").select(F.col("cid").alias("src"), F.col("least").alias("dst"))


def similar_links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Star links (src, dst) that join the fp of exactly those classes found whose sets have that cosine or more.

    `classes` has the distinct pairs of columns fp and wide, with their band keys, number of shingles and an id cid, materialised; `sets_of` gives
    (cid, shingles) of those of its rows that it is handed. Classes that share a band are candidates; these join to groups. Only classes in a
    group of two or more have their sets made, which go to their group. There the differing bits of wide fingerprints add up
    word by word for all pairs, and the sets of pairs within the budget are compared. A group of more than TILE fingerprints, or whose sets
    would make too large a table of bits (TABLE_BITS), is cut into parts, and all pairs of its parts are compared in separate tasks: no
    task grows with it, no pair in it is left out, and no list of pairs is kept.
    """
    budget = wide_budget(similarity)

    def similar(key, table):
        table, pairs = _pairs_of(key, table, budget)
        shingles = [np.frombuffer(x, "<u4") for x in table["shingles"].to_pylist()]
        return _stars(forest(similar_pairs(pairs, shingles, similarity), len(table)), table["fp"].to_numpy())

    bound_batches(classes.sparkSession)
    grouped = connected_components(band_links(classes)).select(F.col("node").alias("cid"), F.col("component").alias("node"))
    held = materialize(classes.drop("bands").join(grouped, "cid"))
    rows = held.select("node", "cid", "fp", "wide").join(sets_of(held), "cid")
    return _tiled(rows, _crowded(held)).mapInArrow(lambda batches: _by_group(batches, similar), "src long, dst long")


def _grouped(docs: DataFrame, shingle_words: int, budget: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, fp) of each row, and (fp, root, first) of each fingerprint: the root of its component and
    its first row by doc_id, nulls last, and tie."""
    prints = materialize(fingerprints(docs, shingle_words, 0 if similarity is None else bands_of(similarity)))
    mark = marked()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("first")
    classes = materialize(prints.groupBy("fp").agg(first))
    links = trie_self_join(classes, budget)
    if similarity is not None:
        # Texts of one fingerprint may differ in the wide one, and each of these has links of its own.
        keys = _row_keys(F.col("first.doc_id"), F.col("first.tie"))
        wide = materialize(prints.groupBy("fp", "wide").agg(first, F.max("size").alias("size"), F.max("bands").alias("bands")).select("fp", "wide", "size", "bands", *keys, F.monotonically_increasing_id().alias("cid")))
        links = links.union(similar_links(wide, lambda held: shingle_sets(docs, held.select(*ROW_KEYS, "cid"), shingle_words), similarity))
    comp = connected_components(links)
    rooted = classes.join(comp, classes.fp == comp.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted)
    release_since(mark)
    return prints, rooted


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, budget: int = BUDGET, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id): documents joined by links of fingerprints `budget` bits apart or less.

    With `similarity`, documents whose sets of shingles have that cosine or more, the measure that bits of a SimHash
    estimate, are linked too: min-hashes find the candidates (a pair right at the limit shares no band with chance MISS at most), their
    shingles decide. A Jaccard similarity s is a cosine of 2 s / (1 + s) or more, so pairs
    with a Jaccard similarity of 0.8 are well within a cosine of 0.8.

    component_id is the smallest doc_id reachable, its own where nothing is near. Texts without a
    word have fingerprint 0 and link like any other, a null text among them. Equal fingerprints are
    one class, so copies are never paired; every wide fingerprint of a class is compared. A null doc_id is returned and joins its class, but can't
    name it; a class of null ids only has a null component_id. Repeated rows come back repeated; different texts
    of one id are in the components of each. A very long text needs memory in proportion; an empty table gives
    an empty one; columns other than doc_id and text are left out.
    """
    prints, rooted = _grouped(docs, shingle_words, budget, similarity)
    # Written out, so that the join reads two plain shuffles and Spark can split a large component.
    least = materialize(rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id")))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, budget: int = BUDGET, similarity: float | None = SIMILARITY) -> DataFrame:
    """One row of `docs` for each group of near-duplicates: that with the smallest doc_id, all columns as they were.

    Rows without a doc_id come last, and ties are settled by a hash of the text, so different texts that share
    an id, or have none, stay as long as they are in different groups. Of rows alike in id and text one stays, any.
    Null and empty texts are one group. Columns may have any name. An empty table gives an empty one.
    """
    prints, rooted = _grouped(docs, shingle_words, budget, similarity)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(*_row_keys(F.col("first.doc_id"), F.col("first.tie"))).distinct()
    # What goes is found by keys alone: rows of no representative, and all but one of rows that are alike.
    rows = prints.select(*_row_keys(F.col("doc_id"), F.col("tie")))
    counted = rows.groupBy(*ROW_KEYS).agg(F.count("*").alias("n")).join(kept.withColumn("_kept", F.lit(True)), ROW_KEYS, "left")
    marked_ = materialize(counted.where("_kept is null or n > 1").select(*ROW_KEYS, F.col("_kept").isNull().alias("_gone")))
    named = docs.toDF(*[f"_in_{k}" for k in range(len(docs.columns))])
    at = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    named = named.select("*", *_row_keys(F.col(at["doc_id"]).cast("long"), _tie(F.col(at["text"]).cast("string"))))
    out = lambda df: df.select(*[F.col(at[c]).alias(c) for c in docs.columns])
    once = out(named.join(small_side(marked_), ROW_KEYS, "left_anti"))
    alike = marked_.where("not _gone")
    if alike.limit(1).count() == 0:
        return once
    return once.unionAll(out(named.join(small_side(alike), ROW_KEYS, "left_semi").dropDuplicates(ROW_KEYS)))


def small_side(keys: DataFrame) -> DataFrame:
    """A table of keys for a join with documents: broadcast if it has at most BROADCAST_ROWS rows, else as Spark sees fit, which then shuffles
    the documents' texts once. The table must be materialised."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: About 32 MB of keys.
BROADCAST_ROWS = 1_000_000
#: A row by its doc_id and the hash of its text, none of them null, so that a join and a grouping by them share one shuffle.
ROW_KEYS = ["_no_id", "_id", "_tie"]


def _row_keys(doc_id, tie) -> list:
    return [doc_id.isNull().alias("_no_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"), tie.alias("_tie")]
