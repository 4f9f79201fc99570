"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.common import learned_rows, materialize
from pedalytics.llm.textnum import Words, slices

FEATURES = ("bytes", "words", "upper", "digits", "stops", "shouts", "symbols", "lines", "high_bytes", "word_mean",
            "word_spread", "fresh_words", "fresh_lines", "fresh_pairs", "symbol_words", "upper_words", "top_word",
            "long_words")
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 sentence mark, 4 loud mark, 5 other symbol, 6 line end
_CLASS[65:91], _CLASS[48:58] = 1, 2
for _chars, _kind in ((b".,;:'\"()-", 3), (b"!?", 4), (b"#$%&*+/<=>@[\\]^_`{|}~", 5), (b"\n", 6)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = 7


def _per_text(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive places (empty runs give 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[places[1:]] - total[places[:-1]]


def _distinct(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct keys and the most frequent key's count."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(k)))
    most = np.zeros(texts)
    np.maximum.at(most, o[begin], runs)
    return np.bincount(o[begin], minlength=texts).astype(float), most


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text: logarithms of sizes and of odds of shares, so that classes are near normal."""
    texts, n = len(offsets) - 1, np.diff(offsets).astype(float)
    kinds = _CLASS[raw]
    share = {k: _per_text(kinds == k, offsets) for k in range(1, 8)}
    words = Words(raw, offsets)
    count = np.diff(words.first).astype(float)
    owner = np.repeat(np.arange(texts), np.diff(words.first))
    size = (words.stop - words.start).astype(float)
    of = {k: np.concatenate([[0], np.cumsum(kinds == k)]) for k in (1, 5)}
    inside = {k: (of[k][words.stop] - of[k][words.start]) for k in of}
    h = words.hash
    fresh, most = _distinct(h, owner, texts)
    pair = h[:-1] * np.uint64(3) + h[1:] if len(h) else h
    same = owner[:-1] == owner[1:] if len(h) else owner.astype(bool)
    fresh_pairs, _ = _distinct(pair[same], owner[:-1][same] if len(h) else owner, texts)
    # a line's hash: sum of its words' hashes with odd multipliers by place
    line_no = np.concatenate([[0], np.cumsum(kinds == 6)])[words.start]
    if len(h):
        starts = np.flatnonzero(np.append(True, (line_no[1:] != line_no[:-1]) | (owner[1:] != owner[:-1])))
        place = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)
        lines = np.add.reduceat(h * (place * np.uint64(2) + np.uint64(1)), starts)
        line_owner = owner[starts]
    else:
        lines, line_owner = h, owner
    fresh_lines, _ = _distinct(lines, line_owner, texts)
    line_count = np.bincount(line_owner, minlength=texts).astype(float)
    mean = _per_text(size, words.first) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(_per_text(size * size, words.first) / np.maximum(count, 1) - mean * mean, 0))

    def odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))

    return np.column_stack([
        np.log1p(n), np.log1p(count), *[odds(share[k], n) for k in range(1, 8)], np.log1p(mean), np.log1p(spread),
        odds(fresh, count), odds(fresh_lines, line_count), odds(fresh_pairs, np.maximum(count - 1, 0)),
        odds(_per_text(inside[5] > 0, words.first), count),
        odds(_per_text(inside[1] == size, words.first), count), odds(most, count),
        odds(_per_text(size > 12, words.first), count)])


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the FEATURES vector ``x`` of each row's whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, offsets in slices(batch.column("text")):
                x = statistics(raw, offsets)
                lists = pa.ListArray.from_arrays(np.arange(end - row + 1, dtype=np.int32) * len(FEATURES), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), lists], ["doc_id", "x"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log-density constants for classes 0 and 1."""

    mean: np.ndarray
    whiten: np.ndarray
    const: np.ndarray
    slope: float
    shift: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = [(x - self.mean[c]) @ self.whiten[c].T for c in (0, 1)]
        return (self.const[1] - 0.5 * (z[1] ** 2).sum(1)) - (self.const[0] - 0.5 * (z[0] ** 2).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -40, 40)))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        shrink: float = 0.1, ridge: float = 0.05, calibration_rows: int = 20_000) -> Discriminant:
    """Fit on the labelled rows of ``stats``.

    Counts, sums and cross products of each class are one grouped aggregate
    of all labelled rows.  A class's covariance is drawn by ``shrink`` towards
    the pooled one and by ``ridge`` towards its diagonal.  A line fitted to
    the log-density differences of about ``calibration_rows`` labelled rows
    (all, if there are fewer; chosen by id hash) turns them into probabilities.  Null labels,
    labels other than 0 and 1 and ids without text are left out; where a class
    has no row, all scores equal the other class's share.
    """
    d = len(FEATURES)
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.col(label_col)).cast("int").alias("y"))
    rows = stats.join(marks, "doc_id").select("doc_id", "x", "y")
    sums = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
        *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]).collect()
    by = {r["y"]: r for r in sums}
    n = np.array([float(by[c]["n"]) if c in by else 0.0 for c in (0, 1)])
    mean, cov = np.zeros((2, d)), np.tile(np.eye(d), (2, 1, 1))
    for c, r in by.items():
        mean[c] = [r[f"s{i}"] / r["n"] for i in range(d)]
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] / r["n"] for j in range(d)] for i in range(d)])
        cov[c] = second - np.outer(mean[c], mean[c])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / max(n.sum(), 1)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
    whiten, const = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        weight = (n[c] / (n[c] + d)) * (1 - shrink)
        shrunk = (1 - ridge) * (weight * cov[c] + (1 - weight) * pooled) + ridge * scale
        low = np.linalg.cholesky(shrunk)
        whiten[c] = np.linalg.inv(low)
        const[c] = -np.log(np.diag(low)).sum()
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    model = Discriminant(mean, whiten, const, 1.0, prior)
    if not n.all():
        model.slope = 0.0
        return model
    share = min(1.0, calibration_rows / n.sum())
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.difference(_matrix(batch))), batch.column("y")], ["q", "y"])

    sample = chosen.mapInArrow(run, "q double, y int").toPandas()
    q, y = sample["q"].to_numpy(), sample["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return model
    model.slope, model.shift = _logistic(q, y, prior)
    return model


def _logistic(q: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope >= 0 and shift of the logistic line through (q, y), by damped Newton steps."""
    spread = max(float(q.std()), 1e-9)
    a = np.column_stack([q / spread, np.ones(len(q))])
    w = np.array([1.0, prior])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3, a.T @ (p - y) + 1e-3 * w)
        w = w - step / max(1.0, np.abs(step).max())
    return max(float(w[0]), 0.0) / spread, float(w[1])


def keep_quality(df: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "quality", modulus: int = 4, **options) -> DataFrame:
    """The rows of ``df`` whose text scores ``least`` or more, all columns unchanged.

    Learns as ``score_quality`` does; then every row is scored where it is
    read, so no text is shuffled and repeated or null ids do not matter.
    """
    stats = materialize(document_statistics(df, id_col, text_col), "statistics")
    model = fit(stats.filter(learned_rows(F.col("doc_id"), modulus)), labels, label_col, id_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(statistics(raw, offsets)) >= least
                    for _, _, raw, offsets in slices(batch.column(text_col))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return df.mapInArrow(run, df.schema)


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", modulus: int = 4, **options) -> DataFrame:
    """``doc_id, held_out, score`` for every row of ``df``; learns where crc32(id) mod ``modulus`` is not 2.

    Null and empty texts are scored by their (zero) statistics, repeated rows
    each, and an empty table gives an empty result.
    """
    stats = materialize(document_statistics(df, id_col, text_col), "statistics")
    learned = learned_rows(F.col("doc_id"), modulus)
    model = fit(stats.filter(learned), labels, label_col, id_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(model.score(_matrix(batch)))],
                ["doc_id", "held_out", "score"])

    return stats.select("doc_id", (~learned).alias("held_out"), "x").mapInArrow(
        run, "doc_id long, held_out boolean, score double")
