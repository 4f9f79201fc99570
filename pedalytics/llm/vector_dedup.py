"""Near-duplicate vectors: tiled comparison in PCA order with suffix-norm bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.common import materialize
from pedalytics.llm.components import components

BLOCK = 1024  # rows compared with rows at a time
DENSE = 0.02  # share of a block's pairs beyond which the rest is one matrix product
SLACK = 1e-9  # bounds are loosened by this much, far above rounding
SPREAD = 16  # tiles at least, for tables of so many times LEAST vectors
LEAST = 512
TILE_BYTES = 16 << 20  # vectors of a tile
LEAVES = 512  # regions of the leading axes at most
LEAF_SAMPLE = 32  # vectors of the sample that cuts the regions, for each of them


def usable(vector: Column) -> Column:
    """True for vectors with components, all finite, not all zero."""
    ok = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Columns: axes of the unit vectors' second moments, largest share first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            u = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["i", "m"])

    sums = vectors.select("v").mapInArrow(run, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).collect()
    moment = np.zeros(dims * dims)
    for r in sums:
        moment[r["i"]] = r["m"]
    _, axes = np.linalg.eigh(moment.reshape(dims, dims))
    return np.ascontiguousarray(axes[:, ::-1])


def _suffix_norms(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    tail = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.column_stack([tail[:, c] if c < x.shape[1] else np.zeros(len(x)) for c in cuts]))


def block_pairs(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, cuts: list[int],
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks (in axis order) whose products may reach the threshold.

    The leading cuts[0] dimensions are one product.  A pair stays while its
    partial sum plus the product of the suffix norms reaches the threshold;
    further dimensions are added for such pairs only.
    """
    partial = x[:, :cuts[0]] @ y[:, :cuts[0]].T
    i, j = np.nonzero(partial + nx[:, 0, None] * ny[None, :, 0] >= threshold - SLACK)
    if len(i) > DENSE * partial.size:
        partial += x[:, cuts[0]:] @ y[:, cuts[0]:].T
        return np.nonzero(partial >= threshold - SLACK)
    total = partial[i, j]
    for k in range(1, len(cuts)):
        if not len(i):
            break
        part = slice(cuts[k - 1], cuts[k])
        total = total + np.einsum("ij,ij->i", x[i, part], y[j, part])
        stay = total + nx[i, k] * ny[j, k] >= threshold - SLACK
        i, j, total = i[stay], j[stay], total[stay]
    return i, j


def _join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give all nodes connected by the pairs (u, v) or by equal labels the smallest label."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _compare(tiles: pd.DataFrame, axes: np.ndarray, cuts: list[int], threshold: float) -> pd.DataFrame:
    """Link counts and a spanning forest of the links between two tiles (or inside one)."""
    dims = len(axes)
    ids = [np.frombuffer(b, np.int64) for b in tiles["ids"]]
    counts = [np.frombuffer(b, np.int64) for b in tiles["counts"]]
    unit = [_unit(np.frombuffer(b, np.float64).reshape(-1, dims)) for b in tiles["vectors"]]
    turned = [u @ axes for u in unit]
    norms = [_suffix_norms(t, cuts) for t in turned]
    same = len(tiles) == 1
    other = 0 if same else 1
    shift = 0 if same else len(ids[0])
    node = ids[0] if same else np.concatenate(ids)
    degree, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for p in range(0, len(ids[0]), BLOCK):
        for q in range(p if same else 0, len(ids[other]), BLOCK):
            a, b = slice(p, p + BLOCK), slice(q, q + BLOCK)
            i, j = block_pairs(turned[0][a], turned[other][b], norms[0][a], norms[other][b], cuts, threshold)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            i, j = i + p, j + q
            for at in range(0, len(i), 1 << 16):  # exact cosines of the given vectors
                u, v = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                hit = np.einsum("ij,ij->i", unit[0][u], unit[other][v]) >= threshold
                u, v = u[hit], v[hit]
                np.add.at(degree, u, counts[other][v])
                np.add.at(degree, v + shift, counts[0][u])
                _join_labels(label, u, v + shift)
    linked, away = np.flatnonzero(degree), np.flatnonzero(label != np.arange(len(node)))
    return pd.DataFrame({
        "a": np.concatenate([node[linked], node[away]]),
        "b": pd.array([None] * len(linked) + node[label[away]].tolist(), "Int64"),
        "n": np.concatenate([degree[linked], np.zeros(len(away), np.int64)])})


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                 tile_rows: int = 32_768, lead: int = 16) -> DataFrame:
    """Per row the vectors linked to it by cosine >= ``threshold`` and its component.

    Equal vectors form a class and are compared once.  Regions of the leading
    principal axes, cut at medians of a sample, are dealt into tiles of about
    ``tile_rows`` (16 MB at most, a sixteenth of a small table).  Tiles of
    regions whose boxes are too far apart for a link never meet; every other
    pair of tiles is one task's group of two rows, so a task's memory is two
    tiles and each tile travels once for every tile near it.  Inside, vectors are
    turned to principal axes (largest share first); blocks are multiplied in
    the leading ``lead`` dimensions and pairs are dropped as soon as partial
    product plus suffix norms cannot reach the threshold.  What stays is
    decided by the cosine of the given vectors in double precision.  A task
    returns link counts and a spanning forest of its links, never pairs.

    Returns ``vec_id, n_links, component_id, kept``.  Null, empty and zero
    vectors and those with null or non-finite components link with nothing
    and are kept; vectors of different lengths never link; rows that repeat
    an id or a vector each count; an empty table gives an empty result.
    """
    src = materialize(df.select(F.col(id_col).cast("long").alias("vec_id"),
                                F.col(vector_col).cast("array<double>").alias("v")), "vectors")
    good = src.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    classes = materialize(good.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("c"))
                          .withColumn("dims", F.size("v")), "classes")
    found = None
    for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect():
        part = _links(classes.filter(F.col("dims") == r["dims"]), r["dims"], r["n"], threshold, tile_rows, lead)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(found, "tile-links")
    degree = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("degree"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = classes.join(degree, classes.class_id == degree.a, "left").drop("a") \
        .join(roots, F.col("class_id") == roots.node, "left") \
        .select(F.col("v").alias("cv"), "c", F.coalesce("degree", F.lit(0)).alias("degree"),
                F.coalesce("root", "class_id").alias("root"))
    named = materialize(named, "named")
    out = src.join(named, (src.v == named.cv) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("degree") + F.col("c") - 1, F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


class Regions:
    """Boxes of the leading axes with about as many vectors each, cut at medians of a sample."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.below = [-1], [0.0], [-1]  # a node's children: below, below + 1
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        while heap and len(self.axis) // 2 + 1 < leaves:
            _, node, rows = heapq.heappop(heap)
            x = sample[rows]
            axis = int(np.argmax(x.var(axis=0))) if len(rows) else 0
            cut = float(np.median(x[:, axis])) if len(rows) else 0.0
            left = x[:, axis] < cut if len(rows) else np.zeros(0, bool)
            if not left.any():  # one place; its tiles are told apart by hash
                continue
            self.axis[node], self.cut[node], self.below[node] = axis, cut, len(self.axis)
            for part in (rows[left], rows[~left]):
                heapq.heappush(heap, (-len(part), len(self.axis), part))
                self.axis.append(-1)
                self.cut.append(0.0)
                self.below.append(-1)
        self.axis, self.cut, self.below = np.array(self.axis), np.array(self.cut), np.array(self.below)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The region (a node without children) of each row."""
        node, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            live = live[self.axis[node[live]] >= 0]
            at = node[live]
            node[live] = self.below[at] + (x[live, self.axis[at]] >= self.cut[at])
        return node


def _turned(batch: pa.RecordBatch, axes: np.ndarray) -> np.ndarray:
    return _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(axes))) @ axes


def _near_regions(low: np.ndarray, high: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each box the boxes that some pair of unit vectors with a product of ``threshold`` can reach."""
    most = 2 - 2 * threshold + SLACK  # squared distance of such a pair
    found = []
    for a, b in zip(low, high, strict=True):
        gap = np.maximum(np.maximum(a - high, low - b), 0)
        found.append(np.flatnonzero((gap * gap).sum(axis=1) <= most))
    return found


def _links(classes: DataFrame, dims: int, n: int, threshold: float, tile_rows: int, lead: int) -> DataFrame:
    """Rows (a, null, links of a) and (a, b, 0) for edges of spanning forests, over all pairs of tiles that can link."""
    spark = classes.sparkSession
    axes = principal_axes(classes, dims)
    cuts = sorted({min(c, dims) for c in range(lead, dims + lead, lead)})
    tile_rows = max(1, min(tile_rows, TILE_BYTES // (8 * dims), max(LEAST, -(-n // SPREAD))))
    leaves = min(-(-n // tile_rows), LEAVES)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(_turned(batch, axes)[:, :lead])
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], ["x"])

    rate = min(1.0, leaves * LEAF_SAMPLE / n)  # the sample only says where tiles are cut
    sample = classes.filter(F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1 << 30)) < int(rate * (1 << 30))) \
        .select("v").mapInArrow(leading, "x binary").orderBy("x").toArrow().column("x").to_pylist()
    regions = Regions(np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), min(lead, dims)), leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = regions.of(_turned(batch, axes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), *[batch.column(c) for c in ("class_id", "c", "v")]], ["leaf", "class_id", "c", "v"])

    placed = materialize(classes.select("class_id", "c", "v").mapInArrow(
        place, "leaf long, class_id long, c long, v array<double>"), "placed")

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, leaf = _turned(batch, axes), batch.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            names, starts, sizes = np.unique(leaf[order], return_index=True, return_counts=True)
            if len(names):
                low, high = (f.reduceat(x[order], starts) for f in (np.minimum, np.maximum))
                spot = np.arange(dims)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(names, dims)), pa.array(np.tile(spot, len(names))), pa.array(low.ravel()),
                    pa.array(high.ravel()), pa.array(np.repeat(sizes, dims))], ["leaf", "i", "low", "high", "n"])

    boxes = placed.select("leaf", "v").mapInArrow(box, "leaf long, i long, low double, high double, n long") \
        .groupBy("leaf", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")) \
        .toPandas().sort_values(["leaf", "i"])
    names = boxes["leaf"].to_numpy()[::dims]
    low, high = (boxes[c].to_numpy().reshape(-1, dims) for c in ("low", "high"))
    parts = -(-boxes["n"].to_numpy()[::dims] // tile_rows)  # a region that is too large is dealt by hash
    first = np.cumsum(parts) - parts
    near = spark.createDataFrame(
        [(leaf, f, p, [(a, b) for a, b in zip(first[m].tolist(), (first + parts - 1)[m].tolist(), strict=True)])
         for leaf, f, p, m in zip(names.tolist(), first.tolist(), parts.tolist(), _near_regions(low, high, threshold),
                                  strict=True)],
        "leaf long, first long, parts long, mates array<struct<start: long, last: long>>")

    def tile(rows: pa.Table) -> pa.Table:
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "leaf": rows.column("leaf").slice(0, 1), "tile": rows.column("tile").slice(0, 1),
            "ids": pa.array([rows.column("class_id").to_numpy().tobytes()]),
            "counts": pa.array([rows.column("c").to_numpy().tobytes()]), "vectors": pa.array([v.tobytes()])})

    dealt = placed.join(F.broadcast(near.select("leaf", "first", "parts")), "leaf").select(
        "leaf", (F.col("first") + F.pmod(F.xxhash64("class_id"), F.col("parts"))).alias("tile"), "class_id", "c", "v")
    packed = materialize(dealt.groupBy("tile").applyInArrow(
        tile, "leaf long, tile long, ids binary, counts binary, vectors binary"), "tiles")
    met = packed.join(F.broadcast(near.select("leaf", "mates")), "leaf") \
        .select("tile", "ids", "counts", "vectors", F.explode("mates").alias("m")) \
        .select("tile", "ids", "counts", "vectors", F.explode(F.sequence("m.start", "m.last")).alias("mate"))

    def compare(rows):
        return _compare(rows.sort_values("tile"), axes, cuts, threshold)

    return met.groupBy(F.least("tile", "mate").alias("px"), F.greatest("tile", "mate").alias("py")).applyInPandas(
        compare, "a long, b long, n long")
