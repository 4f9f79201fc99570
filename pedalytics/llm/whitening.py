"""Whitening of embeddings: exact sums, centred covariance, spectral components, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.common import materialize
from pedalytics.llm.qdwh import eigen

HALF = 20              # bits of the lower half of a long sum
LARGEST = float(2**52)  # grid values stay within this
FLOOR = 1e-11          # components below this share of the trace are rounding, not directions
LONG = 1 << 63


def finite(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    ok = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def grid(vector: Column, scale: int, shift: int) -> Column:
    """Whole numbers floor(scale * c) + shift of a vector's components."""
    bounded = lambda c: F.least(F.greatest(c * scale, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, lambda c: F.floor(bounded(c)).cast("long") + shift)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row places, matrix) for each vector length of a batch."""
    column = batch.column("x")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for dims in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dims)
        yield dims, at, flat[(ends[at] - dims)[:, None] + np.arange(dims)]


def _sums(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per vector length the number of vectors and the exact sums of their components (Python integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dims, at, x in _by_length(batch):
                own = found.setdefault(dims, [0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)])
                own[0] += len(at)
                own[1] += (x >> HALF).sum(axis=0)
                own[2] += (x & ((1 << HALF) - 1)).sum(axis=0)
        for dims, (n, high, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, dims)), pa.array(np.arange(dims)),
                                              pa.array(np.full(dims, n)), pa.array(high), pa.array(low)],
                                             ["dims", "i", "n", "high", "low"])

    out: dict[int, tuple[int, np.ndarray]] = {}
    rows = vectors.mapInArrow(run, "dims long, i long, n long, high long, low long").groupBy("dims", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low"))
    for r in rows.collect():
        n, total = out.setdefault(r["dims"], (r["n"], np.zeros(r["dims"], object)))
        total[r["i"]] = (int(r["high"]) << HALF) + r["low"]
    return out


class Centre:
    """A mean as whole part and rest, so that differences of large whole numbers lose no digits."""

    def __init__(self, n: int, total: np.ndarray):
        self.n = n
        self.total = np.array([int(t) % (1 << 64) for t in total], np.uint64).astype(np.int64)  # wraps
        self.whole = np.array([int(t) // n for t in total], np.int64)
        self.rest = np.array([int(t) % n / n for t in total])

    def apart(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - S)^2 per row; null where it needs more than 64 bits."""
        y = self.n * x - self.total  # arithmetic modulo 2^64 is exact for results that fit
        exact = (y * y).sum(axis=1)
        guess = (self.n * self.apart(x)) ** 2
        near = guess.sum(axis=1) / LONG
        if (near < 0.99).all():
            return exact.tolist()
        return [int(e) if g < 0.99 else self._wide(row) if g < 1.01 else None for e, g, row in zip(exact, near, x, strict=True)]

    def _wide(self, row: np.ndarray) -> int | None:
        rests = [round(r * self.n) for r in self.rest.tolist()]
        value = sum((self.n * (int(v) - int(w)) - r) ** 2 for v, w, r in zip(row, self.whole, rests, strict=True))
        return value if value < LONG else None


def _moments(vectors: DataFrame, turned) -> dict[int, np.ndarray]:
    """Per vector length the summed products of ``turned(dims, x)``'s columns, one more column of ones among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, x in _by_length(batch):
                y = turned(dims, x)
                if y is not None:
                    y = np.column_stack([y, np.ones(len(y))])
                    found[dims] = found.get(dims, 0.0) + y.T @ y
        for dims, m in found.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims)), pa.array(i), pa.array(j), pa.array(m[i, j])],
                                             ["dims", "i", "j", "m"])

    rows = vectors.mapInArrow(run, "dims long, i long, j long, m double").groupBy("dims", "i", "j").agg(F.sum("m").alias("m"))
    cells: dict[int, list] = {}
    for r in rows.collect():
        cells.setdefault(r["dims"], []).append((r["i"], r["j"], r["m"]))
    out = {}
    for dims, own in cells.items():
        size = 1 + max(j for _, j, _ in own)
        out[dims] = np.zeros((size, size))
        for i, j, m in own:
            out[dims][i, j] = out[dims][j, i] = m
    return out


def _covariance(moment: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) from products with a column of ones; what is left of the mean is taken off."""
    n, left = moment[-1, -1], moment[:-1, -1]
    return moment[:-1, :-1] / n - np.outer(left / n, left / n)


def whiten(df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector along the leading components of the distinct vectors.

    Components are put on a grid of whole numbers, x = floor(scale * c) +
    shift.  The fit list holds each distinct x once (equal vectors are
    combined before the shuffle).  One pass takes its exact sums, one the
    products of the centred values; the driver then holds one matrix of
    dims x dims and splits its spectrum by polar decompositions (``qdwh``).
    A third pass measures the whitened fit list's covariance against the
    identity.  The broadcast projection (dims x components) turns all rows.

    Returns per row and component ``vec_id, component`` (from 1, falling
    eigenvalue), ``n, deviation`` (exact; null where it exceeds 64 bits),
    ``whitened, explained, identity_error``.  Rows whose vector is null or
    holds null or non-finite components are dropped; scaled components beyond
    2^52 count as 2^52.  Vectors of another length are fitted among
    themselves.  A direction with less than 1e-11 of the variance (fewer
    distinct vectors than dimensions, or a single vector) is no component; an
    empty vector has none.  Null and repeated ids are rows like others; an
    empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .filter(finite(F.col("v")) & (F.size("v") > 0)).select("vec_id", grid(F.col("v"), scale, shift).alias("x"))
    fit = materialize(rows.select("x").distinct(), "fit-list")
    centres = {dims: Centre(n, total) for dims, (n, total) in _sums(fit).items()}
    moments = _moments(fit, lambda dims, x: centres[dims].apart(x))
    turns, explained = {}, {}
    for dims, moment in moments.items():
        covariance = _covariance(moment)
        values, vectors = eigen(covariance)
        trace = float(np.trace(covariance))
        k = int((values[:components] > FLOOR * trace).sum()) if trace > 0 else 0
        if k:
            turns[dims], explained[dims] = vectors[:, :k] / np.sqrt(values[:k]), values[:k] / trace
    errors = {dims: float(np.abs(_covariance(m) - np.eye(len(m) - 1)).max()) for dims, m in _moments(
        fit, lambda dims, x: centres[dims].apart(x) @ turns[dims] if dims in turns else None).items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x in _by_length(batch):
                if dims not in turns:
                    continue
                centre, turn = centres[dims], turns[dims]
                k, m = turn.shape[1], len(at)
                every = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)).take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(every)),
                    pa.array((centre.apart(x) @ turn).ravel()), pa.array(np.tile(explained[dims], m)),
                    pa.array(np.full(m * k, errors[dims]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, "
                                    "explained double, identity_error double")
