"""Near-duplicate vectors by tiled comparison in PCA order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize
from .components import connected_components
from .simhash import forest

THRESHOLD = 0.9
#: Vectors in a block are at most about this many, and hold this many bytes; a tile compares two blocks.
BLOCK, BLOCK_BYTES = 8192, 32_000_000
#: Blocks are boxes in the leading LEAD axes, cut in the gaps or at the medians of a sample of at most about SAMPLE vectors; there are at
#: most LEAVES boxes of a dimension, and a fuller one is several blocks. Sample and boxes only decide what is compared
#: with what first: no pair is lost by them.
LEAD, SAMPLE, LEAVES = 16, 50_000, 4096
#: Rows of one block multiplied with the other block at a time.
STRIP = 512
#: Dimensions added in one step.
STEP = 16
#: Slack on bounds, far above rounding in double precision; what it lets through is tested exactly.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim, k1, k2): the rows of use for cosine, with 128 bits of hashes that tell their vectors apart. v is an array of
    floats if the vectors are, else of doubles; all arithmetic is in doubles.

    Null, empty and zero vectors and those with null or non-finite components are left out, as are null ids.
    """
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    each = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    kept = each.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    return kept.withColumns({"dim": F.size("v"), "k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})


#: A class of equal vectors. Ids with several vectors (`several`) have a class of their own for each, told by the id.
CLASS_KEYS = ["k1", "k2", "several", "own"]


def equal_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, keys) of each id and vector, and (class, keys, v, dim, n, first) of each class of equal vectors: how many ids
    it has and the least of them. Both written out."""
    rows = usable(vectors)
    members = materialize(rows.select("vec_id", "k1", "k2").distinct())
    many = materialize(members.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").select("vec_id", F.lit(True).alias("several")))
    if many.limit(1).count():
        rows, members = (d.join(many, "vec_id", "left") for d in (rows, members))
        rows, members = (d.withColumn("several", F.coalesce("several", F.lit(False))) for d in (rows, members))
    else:
        rows, members = (d.withColumn("several", F.lit(False)) for d in (rows, members))
    rows, members = (d.withColumn("own", F.when(F.col("several"), F.col("vec_id")).otherwise(0)) for d in (rows, members))
    members = materialize(members)
    one = rows.groupBy(*CLASS_KEYS).agg(F.first("v").alias("v"), F.first("dim").alias("dim"))
    sizes = members.groupBy(*CLASS_KEYS).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return members, materialize(one.join(sizes, CLASS_KEYS).withColumn("class", F.monotonically_increasing_id()))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension in use, the principal axes of its unit vectors, by falling variance.

    Each task sums outer products, a few tasks sum these, one for each dimension sums theirs, and the driver gets one matrix of
    dim x dim numbers as bytes, whatever the number of vectors. Equal vectors count once.
    """
    schema = "dim int, slot int, m binary"

    def rows(total: dict[int, np.ndarray], slot: int):
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([slot], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["dim", "slot", "m"])

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = _unit(_matrix(batch.filter(pa.array(dims == d)).column("v"), d))
                total[d] = total.get(d, 0) + x.T @ x
        yield from rows(total, TaskContext.get().partitionId() % 16)

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, m in zip(batch.column("dim").to_pylist(), batch.column("m").to_pylist()):
                total[d] = total.get(d, 0) + np.frombuffer(m)
        yield from rows(total, 0)

    parts = vectors.select("dim", "v").mapInArrow(products, schema)
    found: dict[int, np.ndarray] = {}
    for r in parts.repartition(16, "slot").mapInArrow(sums, schema).repartition("dim").mapInArrow(sums, schema).toLocalIterator():
        found[r["dim"]] = np.frombuffer(r["m"]).reshape(r["dim"], r["dim"])
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in found.items()}


def leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Of unit rows, the coordinates on the leading axes and, last, the length of what is left."""
    r = x @ axes[:, :LEAD]
    return np.column_stack([r, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", r, r)))])


def _cut(values: np.ndarray) -> float:
    """Where to cut a node: in its widest gap, if that is wide and leaves a twentieth on each side, else at the median."""
    v = np.sort(values)
    margin = max(1, len(v) // 20)
    gaps = np.diff(v[margin - 1 : len(v) - margin + 1])
    if len(gaps) and gaps.max() > 0.1 * (v[-1] - v[0]):
        k = margin - 1 + int(gaps.argmax())
        return float(v[k] + v[k + 1]) / 2
    return float(np.median(v))


def median_tree(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the axis and the cut of each of its nodes, on the axis of widest spread."""
    out, groups = [], [points]
    for _ in range(depth):
        axis = np.array([int(np.ptp(g, 0).argmax()) if len(g) else 0 for g in groups])
        cut = np.array([_cut(g[:, k]) if len(g) else 0.0 for g, k in zip(groups, axis)])
        out.append((axis, cut))
        groups = [h for g, k, c in zip(groups, axis, cut) for h in (g[g[:, k] <= c], g[g[:, k] > c])]
    return out


def leaf_of(points: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf that each point falls into."""
    node = np.zeros(len(points), np.int64)
    for axis, cut in tree:
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > cut[node])
    return node


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Yield index pairs of rows of unit matrices a and b with cosine >= threshold (i < j if `same`).

    Both are turned to the axes. The product over the leading dimensions plus the product of the
    suffix norms bounds the cosine from above (Cauchy-Schwarz); this bound is one matrix product with
    the suffix norm as a further column. Pairs that may still reach the threshold get STEP more
    dimensions and a new bound, until they are settled; the last test is the cosine itself.
    """
    ra, rb = a @ axes, b @ axes
    d = a.shape[1]
    steps = [*range(STEP, d, STEP), d]

    def suffix(r: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", r[:, k:], r[:, k:]))

    sa, sb = ([suffix(r, k) for k in steps] for r in (ra, rb))
    head_b = np.column_stack([rb[:, : steps[0]], sb[0]]).T
    for at in range(0, len(a), STRIP):
        head_a = np.column_stack([ra[at : at + STRIP, : steps[0]], sa[0][at : at + STRIP]])
        lo = at if same else 0
        i, j = np.nonzero(head_a @ head_b[:, lo:] >= threshold - SLACK)
        i, j = i + at, j + lo
        if same:
            i, j = i[i < j], j[i < j]
        for piece in range(0, len(i), 1_000_000):
            p, q = i[piece : piece + 1_000_000], j[piece : piece + 1_000_000]
            dot, done = np.einsum("ij,ij->i", ra[p, : steps[0]], rb[q, : steps[0]]), steps[0]
            for n, k in enumerate(steps[1:], 1):
                dot = dot + np.einsum("ij,ij->i", ra[p, done:k], rb[q, done:k])
                live = dot + sa[n][p] * sb[n][q] >= threshold - SLACK
                p, q, dot, done = p[live], q[live], dot[live], k
            sure = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
            if sure.any():
                yield p[sure], q[sure]


def _tile(axes: dict[int, np.ndarray], threshold: float):
    names = ["class", "links", "root"]

    def run(key, table):
        dim, ti, tj = (k.as_py() for k in key)
        blocks = table.column("block").to_numpy()
        in_a = blocks == ti
        order = np.concatenate([np.flatnonzero(in_a), np.flatnonzero(~in_a)])
        cut = int(in_a.sum())
        ids, n, several, own = (table.column(c).to_numpy()[order] for c in ("class", "n", "several", "own"))
        x = _unit(_matrix(table.column("v"), dim))[order]
        links = np.zeros(len(ids), np.int64)
        shift = 0 if ti == tj else cut

        def pairs():
            for i, j in close_pairs(x[:cut], x if ti == tj else x[cut:], axes[dim], threshold, ti == tj):
                j = j + shift
                others = ~several[i] | ~several[j] | (own[i] != own[j])
                i, j = i[others], j[others]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                yield i, j

        root = forest(pairs(), len(ids)) if len(x) > cut or ti == tj else np.arange(len(ids))
        hit = links > 0
        return pa.Table.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names)

    return run


#: What of a class goes to its tiles.
HELD = ["class", "v", "n", "several", "own"]


def block_pairs(fine: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> tuple[DataFrame, DataFrame]:
    """The classes with their block, and (dim, ti, tj) of the block pairs that may hold a close pair.

    Blocks are leaves of a tree of cuts. Two boxes have at least the distance of their intervals on the
    leading axes and of what is left, and unit vectors of cosine c have the squared distance 2 - 2 c.
    """
    spark = fine.sparkSession
    sizes = {r["dim"]: r["count"] for r in fine.groupBy("dim").count().collect()}
    rows = {d: max(1, min(BLOCK, BLOCK_BYTES // (8 * d))) for d in sizes}
    depth = {d: min(LEAVES, -(-n // rows[d])).bit_length() - 1 for d, n in sizes.items()}
    trees: dict[int, list] = {d: [] for d in sizes}
    cut = [d for d in sizes if depth[d]]
    if all(n <= rows[d] for d, n in sizes.items()):
        # One block a dimension: it is compared with itself.
        zero = F.lit(0).cast("long")
        return fine.select("dim", zero.alias("block"), *HELD), fine.select("dim", zero.alias("ti"), zero.alias("tj")).distinct()
    if cut:
        share = F.lit(0.0)
        for d in cut:
            share = F.when(F.col("dim") == d, F.lit(min(1.0, SAMPLE / len(cut) / sizes[d]))).otherwise(share)
        draw = F.pmod(F.xxhash64("class", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

        def points(batches):
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    got = leading(_unit(_matrix(batch.filter(pa.array(dims == d)).column("v"), d)), axes[d])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), d, np.int32)), pa.array(list(got), pa.list_(pa.float64()))], ["dim", "at"])

        drawn = fine.where(draw < share).select("dim", "v").mapInArrow(points, "dim int, at array<double>").toArrow()
        dims, at = drawn["dim"].to_numpy(), drawn["at"].to_pylist()
        trees |= {d: median_tree(np.array([at[k] for k in np.flatnonzero(dims == d)]).reshape(-1, min(LEAD, d) + 1), depth[d]) for d in cut}

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            for d in np.unique(dims).tolist():
                if trees[d]:
                    here = dims == d
                    leaf[here] = leaf_of(leading(_unit(_matrix(batch.filter(pa.array(here)).column("v"), d)), axes[d]), trees[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def boxes(batches):
        low: dict[tuple, np.ndarray] = {}
        high: dict[tuple, np.ndarray] = {}
        many: dict[tuple, int] = {}
        for batch in batches:
            dims, leaf = batch.column("dim").to_numpy(), batch.column("leaf").to_numpy()
            for d in np.unique(dims).tolist():
                here = dims == d
                p, of = leading(_unit(_matrix(batch.filter(pa.array(here)).column("v"), d)), axes[d]), leaf[here]
                for k in np.unique(of).tolist():
                    some = p[of == k]
                    lo, hi = some.min(0), some.max(0)
                    low[d, k], high[d, k] = np.minimum(low.get((d, k), lo), lo), np.maximum(high.get((d, k), hi), hi)
                    many[d, k] = many.get((d, k), 0) + len(some)
        for (d, k), n in many.items():
            count = len(low[d, k])
            cols = [pa.array(np.full(count, d, np.int32)), pa.array(np.full(count, k)), pa.array(np.arange(count, dtype=np.int32)), pa.array(low[d, k]), pa.array(high[d, k]), pa.array(np.full(count, n))]
            yield pa.RecordBatch.from_arrays(cols, ["dim", "leaf", "axis", "lo", "hi", "n"])

    fine = fine.select(*HELD, "dim")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fine.schema)
    placed = materialize(fine.mapInArrow(place, f"{kinds}, leaf long"))
    parts = placed.select("dim", "leaf", "v").mapInArrow(boxes, "dim int, leaf long, axis int, lo double, hi double, n long")
    stats = parts.groupBy("dim", "leaf", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).orderBy("dim", "leaf", "axis").toArrow()
    held: dict[int, tuple] = {}
    dims = stats["dim"].to_numpy()
    for d in sizes:
        leaf, lo, hi, n = (stats[c].to_numpy()[dims == d].reshape(-1, LEAD + 1 if d >= LEAD else d + 1) for c in ("leaf", "lo", "hi", "n"))
        held[d] = leaf[:, 0], lo, hi, -(-n[:, 0] // rows[d])

    def near(batches):
        for batch in batches:
            for d, k in zip(batch.column("dim").to_pylist(), batch.column("leaf").to_pylist()):
                leaf, lo, hi, n = held[d]
                at = int(np.searchsorted(leaf, k))
                gap = np.maximum(0, np.maximum(lo - hi[at], lo[at] - hi))
                close = np.flatnonzero((np.einsum("ij,ij->i", gap, gap) <= 2 - 2 * threshold + SLACK) & (leaf >= k))
                cols = [pa.array(np.full(len(close), v)) for v in (k, n[at])] + [pa.array(leaf[close]), pa.array(n[close])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(close), d, np.int32)), *cols], ["dim", "a", "na", "b", "nb"])

    leaves = spark.createDataFrame([(d, int(k)) for d, h in held.items() for k in h[0]], "dim int, leaf long").repartition(32)
    pairs = leaves.mapInArrow(near, "dim int, a long, na long, b long, nb long")
    # A leaf of n parts is n blocks.
    pairs = pairs.withColumn("p", F.explode(F.expr("sequence(0L, na - 1)"))).withColumn("q", F.explode(F.expr("sequence(0L, nb - 1)")))
    block = lambda leaf, part: F.col(leaf) * (1 << 31) + F.col(part)
    pairs = pairs.select("dim", block("a", "p").alias("ti"), block("b", "q").alias("tj")).where("ti <= tj")
    counts = spark.createDataFrame([(d, int(k), int(n)) for d, h in held.items() for k, n in zip(h[0], h[3])], "dim int, leaf long, parts long")
    own = placed.join(F.broadcast(counts), ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    return own.select("dim", block("leaf", "part").alias("block"), *HELD), pairs


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each id of `vectors`.

    Equal vectors are one class, which is compared once however many ids it has: these link with each other, and with all ids of the
    classes that theirs links with. All classes of one dimension are compared with each other, in tiles of two blocks, but for pairs of
    blocks that are too far from each other (see `block_pairs`): only the others' rows are sent.
    A tile returns each linked class's number of links in it and the root of its forest, not pairs.
    component_id is the smallest vec_id reachable, its own where it has no links. Ids whose vectors
    can't be used link with nothing. Rows alike in id and vector are one; an id with different vectors has the links
    of each, counted each, none among themselves (its vectors are in no class with others', so copies among such ids are compared
    one by one). A null id comes back once, with no links, a null component and
    kept false. An empty table gives an empty one; other columns are left out.
    """
    bound_batches(vectors.sparkSession)
    members, fine = equal_vectors(vectors)
    axes = principal_axes(fine)
    everyone = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    own, pairs = block_pairs(fine, axes, threshold)
    ends = pairs.select("dim", F.col("ti").alias("block"), "ti", "tj").union(pairs.where("ti < tj").select("dim", F.col("tj").alias("block"), "ti", "tj"))
    tiled = own.join(ends, ["dim", "block"]).select("dim", "ti", "tj", "block", *HELD)
    found = materialize(tiled.groupBy("dim", "ti", "tj").applyInArrow(_tile(axes, threshold), "class long, links long, root long"))
    # The classes of an id with several vectors are reached through it.
    apart = fine.where("several").select("own", "class")
    bound = apart.join(apart.groupBy("own").agg(F.min("class").alias("root")), "own").select("class", "root")
    comp = connected_components(found.select("class", "root").union(bound), "class", "root")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = fine.drop("v").join(links, "class", "left").join(comp.withColumnRenamed("node", "class"), "class", "left")
    known = materialize(known.select(*CLASS_KEYS, "first", F.coalesce("component", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written out, so that the joins with a class or a component of very many ids read plain shuffles.
    named = materialize(known.join(materialize(least), "root").drop("root", "first"))
    of_id = materialize(members.join(named, CLASS_KEYS).groupBy("vec_id").agg(F.sum("links").alias("n_links"), F.min("component_id").alias("component_id")))
    out = everyone.join(of_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
