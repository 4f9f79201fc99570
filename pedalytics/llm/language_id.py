"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedalytics.llm.common import learned_rows
from pedalytics.llm.textnum import fmix, slices

ORDER = 4
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_BITS = np.uint64(16)
_BLANK = 32
_TABLES: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    """For every code point its lower-case letter as a 16-bit symbol, or the blank for other characters."""
    if "symbols" not in _TABLES:
        out = np.full(0x110000, _BLANK, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = min(ord(c.lower()[0]), 0xFFFF)
        _TABLES["symbols"] = out
    return _TABLES["symbols"]


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams of every symbol of every text, and the place of each text's first one.

    Letters are lower-cased, runs of other characters are one blank, and each
    text is read after ORDER - 1 blanks.
    """
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    sym = _symbols()[points]
    letter = sym != _BLANK
    follows = np.zeros(len(sym), bool)
    follows[1:] = letter[:-1]
    heads = chars[:-1][chars[:-1] < len(sym)]
    follows[heads] = False
    keep = letter | follows
    owner = np.repeat(np.arange(len(chars) - 1), np.diff(chars))[keep]
    pad = ORDER - 1
    line = np.full(int(keep.sum()) + pad * (len(chars) - 1), _BLANK, np.uint64)
    at = np.arange(len(owner)) + pad * (owner + 1)
    line[at] = sym[keep]
    key = np.zeros(len(at), np.uint64)
    for back in range(pad, -1, -1):
        key = (key << _BITS) | line[at - back]
    first = np.searchsorted(owner, np.arange(len(chars)))
    return key, first


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


@dataclass
class KneserNey:
    """One language: per order a sorted array of gram hashes with weights, and one of context hashes."""

    gram: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    context: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = 1.0

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> "KneserNey":
        """From the packed grams of highest order; lower orders use counts of distinct predecessors."""
        model, levels = cls(), []
        for order in range(ORDER, 0, -1):
            levels.append((order, keys, counts))
            keys, counts = np.unique(keys & _mask(order - 1), return_counts=True)
        model.floor = 1.0 / (len(np.unique(levels[-1][1])) + 1)
        for order, grams_, seen in reversed(levels):
            once, twice = int((seen == 1).sum()), int((seen == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, place, types = np.unique(grams_ >> _BITS, return_inverse=True, return_counts=True)
            total = np.bincount(place, weights=seen)
            h, c = fmix(grams_), fmix(contexts + np.uint64(order))
            by, cby = np.argsort(h), np.argsort(c)
            model.gram.append(h[by])
            model.weight.append(((np.maximum(seen - discount, 0)) / total[place])[by])
            model.context.append(c[cby])
            model.backoff.append((discount * types / total)[cby])
        return model

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.floor)
        for order in range(1, ORDER + 1):
            part = keys & _mask(order)
            known, weight = _look_up(self.context[order - 1], self.backoff[order - 1],
                                     fmix((part >> _BITS) + np.uint64(order)))
            _, own = _look_up(self.gram[order - 1], self.weight[order - 1], fmix(part))
            p = np.where(known, own + weight * p, p)
        return np.log(p)


def _look_up(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    hit = hashes[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


@dataclass
class Identifier:
    names: list[str]
    models: list[KneserNey]
    line: tuple[float, float] = (1.0, 0.0)  # slope and shift over the log of the margin in nats
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))  # cross-entropy above which a text is rejected

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per symbol under each model (nats), and the number of symbols."""
        keys, first = grams(raw, offsets)
        texts = len(offsets) - 1
        out = np.zeros((texts, len(self.names)))
        if len(keys) and self.names:
            distinct, place = np.unique(keys, return_inverse=True)
            for k, model in enumerate(self.models):
                total = np.concatenate([[0], np.cumsum(model.log_probability(distinct)[place])])
                out[:, k] = -(total[first[1:]] - total[first[:-1]])
        n = np.diff(first)
        return out / np.maximum(n, 1)[:, None], n

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: none), probability that it is right, and whether the text is rejected."""
        if not self.names:
            return np.full(len(n), -1), np.zeros(len(n)), np.ones(len(n), bool)
        best = np.argmin(entropy, axis=1)
        low = entropy[np.arange(len(n)), best]
        score = 1 / (1 + np.exp(-np.clip(self.line[0] * _margin(entropy, n) + self.line[1], -30, 30)))
        rejected = (low > self.limits[best]) | (score < 0.5)
        nothing = n == 0
        return np.where(nothing, -1, best), np.where(nothing, 0.0, score), rejected | nothing


def _margin(entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log of the nats between the best and the second-best model over the whole text."""
    if entropy.shape[1] < 2:
        return np.full(len(n), 5.0)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return np.log1p((two[:, 1] - two[:, 0]) * n)


def learn(docs: DataFrame, sample_rows: int = 500) -> Identifier:
    """Fit on at most ``sample_rows`` rows of each language, chosen by id hashes.

    ``docs``: doc_id, text, lang.  A third of the sampled rows, by hash, sets
    the score line and the rejection limits; the others are counted.
    """
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # about three times the sample is ranked, however many rows a language has
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (
        r["lang"], min(1.0, 3 * sample_rows / r["c"]))]), F.col("lang")) if sizes else F.lit(1.0)
    order = F.xxhash64("doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    # at most sample_rows * MAX_LANGUAGES ids
    sample = docs.select("doc_id", "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)) \
        .withColumn("k", rank).filter(F.col("k") <= sample_rows) \
        .select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang"), (F.col("k") % 3 == 0).alias("check"))
    rows = docs.join(F.broadcast(sample), (docs.doc_id == sample.s_id) & (docs.lang == sample.s_lang)) \
        .select("text", "lang", "check")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, end, raw, offsets in slices(batch.column("text")):
                keys, first = grams(raw, offsets)
                owner = np.repeat(langs[row:end], np.diff(first))
                for name in sorted(set(langs[row:end])):
                    k, c = np.unique(keys[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)],
                        ["lang", "key", "c"])

    table = rows.filter(~F.col("check")).mapInArrow(count, "lang string, key long, c long") \
        .groupBy("lang", "key").agg(F.sum("c").alias("c")).toPandas()
    names = sorted(table["lang"].unique())
    models = []
    for name in names:
        own = table[table["lang"] == name].sort_values("key")
        models.append(KneserNey.fit(own["key"].to_numpy().view(np.uint64), own["c"].to_numpy(float)))
    found = Identifier(names, models)
    return _calibrate(found, rows.filter("check")) if names else found


def _calibrate(found: Identifier, rows: DataFrame) -> Identifier:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, offsets in slices(batch.column("text")):
                e, n = found.entropies(raw, offsets)
                low = e.min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(row, end - row), pa.array(e.argmin(axis=1)), pa.array(low),
                     pa.array(_margin(e, n)), pa.array(n)], ["lang", "best", "low", "margin", "n"])

    seen = rows.mapInArrow(run, "lang string, best long, low double, margin double, n long").filter("n > 0").toPandas()
    right = (np.array(found.names, object)[seen["best"].to_numpy(int)] == seen["lang"]).to_numpy(float)
    m = seen["margin"].to_numpy()
    # ridge-damped logistic fit, starting from a line through (0, one in as many languages)
    w = np.array([1.0, -np.log(max(len(found.names) - 1, 1))])
    a = np.column_stack([m, np.ones(len(m))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 0.05
        w = w + np.clip(np.linalg.solve(hess, a.T @ (right - p) - 0.05 * (w - [1.0, 0.0])), -1, 1)
    found.line = (max(float(w[0]), 0.05), float(w[1]))
    limits = np.full(len(found.names), np.inf)
    for k in range(len(found.names)):
        own = seen["low"][(seen["best"] == k) & (right > 0)]
        if len(own):
            limits[k] = float(own.max()) * 1.1
    found.limits = limits
    return found


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             modulus: int = 4, sample_rows: int = 500) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` for every row's whole text.

    Learns from rows with a language whose crc32(id) mod ``modulus`` is not 2.
    The language of lowest cross-entropy per symbol wins; the score is the
    calibrated chance that it is right; ``rejected`` marks texts that fit no
    model well or are as likely another.  Null texts and texts without letters
    are ``und`` with score 0.  Without any learned language all rows are
    ``und``; repeated rows are returned each; no rows give no rows.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    F.col(lang_col).cast("string").alias("lang"))
    learned = learned_rows(F.col("doc_id"), modulus)
    found = learn(src.filter(learned & F.col("lang").isNotNull() & F.col("text").isNotNull()), sample_rows)
    names = np.array([*found.names, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, raw, offsets in slices(batch.column("text")):
                e, n = found.entropies(raw, offsets)
                best, score, rejected = found.decide(e, n)
                low = e.min(axis=1) if found.names else np.zeros(len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("held_out").slice(row, end - row),
                     pa.array(names[best], pa.string()), pa.array(score), pa.array(low), pa.array(rejected)],
                    ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return src.select("doc_id", (~learned).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
