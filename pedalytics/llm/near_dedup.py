"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.common import materialize
from pedalytics.llm.components import components
from pedalytics.llm.textnum import Words, fmix, slices

ROWS, BANDS = 5, 24
HASHES = ROWS * BANDS
STEP = 20  # signature places compared at a time
_RNG = np.random.default_rng(90210)
_MULTIPLY = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words."""
    words = Words(raw, offsets)
    h = words.hash
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        rolled = fmix(rolled * _PLACE[0] + h[i:len(h) - width + 1 + i] + _PLACE[1]) if len(rolled) else rolled
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - begin >= width:
            yield np.unique(rolled[begin:end - width + 1])
        elif end > begin:
            whole = np.array([end - begin], np.uint64)
            for w in h[begin:end]:
                whole = fmix(whole * _PLACE[1] + w + _PLACE[0])
            yield whole
        else:
            yield h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits each) of a set's multiply-add hashes."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at:at + 2048, None] * _MULTIPLY + _ADD
        least = np.minimum(least, part.min(axis=0) >> np.uint64(32))
    return least.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ROWS signature places; the band's number goes into it."""
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = fmix(key * _PLACE[0] + parts[:, i] + _PLACE[1])
    return key.view(np.int64)


def matches_needed(threshold: Fraction, miss: float) -> list[int]:
    """For STEP, 2*STEP .. HASHES compared places the fewest matches that keep a pair.

    With a uniform prior, m matches of n make the similarity Beta(m+1, n-m+1).
    A pair is dropped where the chance that it reaches the threshold is below ``miss``.
    """
    t, out = float(threshold), []
    for n in range(STEP, HASHES + 1, STEP):
        def chance(m: int, n: int = n) -> float:
            return sum(comb(n + 1, j) * t ** j * (1 - t) ** (n + 1 - j) for j in range(m + 1))
        out.append(next((m for m in range(n + 1) if chance(m) >= miss), n))
    return out


def _sets(df: DataFrame, width: int, with_signature: bool) -> DataFrame:
    """Per row of (doc_id, text): size and 128-bit digest of the set, signature and band keys — or digest and set."""
    schema = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>" if with_signature \
        else "digest binary, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, end, raw, offsets in slices(batch.column("text")):
                sets = list(shingle_sets(raw, offsets, width))
                own = ids.slice(row, end - row)
                digests = pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary())
                if not with_signature:
                    yield pa.RecordBatch.from_arrays(
                        [digests, pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])
                    continue
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    own, pa.array([len(s) for s in sets], pa.int64()), digests,
                    pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
                    pa.array([None if s is None else band_keys(s).tolist() for s in sigs], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "digest", "sig", "bands"])

    return df.mapInArrow(run, schema)


def _fixed(column: pa.Array, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _survivors(a: np.ndarray, b: np.ndarray, needed: list[int]) -> np.ndarray:
    """Rows of two signature matrices that stay after comparing them batch by batch."""
    left, found = np.arange(len(a)), np.zeros(len(a), int)
    for k, least in enumerate(needed):
        part = slice(k * STEP, (k + 1) * STEP)
        found[left] += (a[left, part] == b[left, part]).sum(1)
        left = left[found[left] >= least]
    return left


def _prune(pairs: DataFrame, needed: list[int]) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.array(_fixed(batch.column(c), np.uint32)) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).take(pa.array(_survivors(a, b, needed)))

    return pairs.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b, xa, xb) whose full sets reach the threshold."""
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(q * common >= p * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), miss: float = 1e-4,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the size of its shingle set and the component of its near duplicates.

    Texts are lower-cased (A-Z) and cut into words; a set holds the distinct
    shingles of ``words`` words, a shorter text is one shingle, a text without
    words (or null) has none and links with nothing.  Documents of one set
    form a class.  Classes whose signatures agree in one of 24 bands of 5
    places are candidates.  A candidate pair's signatures are compared in
    batches of 20 places; it is dropped where the posterior chance of reaching
    ``threshold`` is below ``miss``.  What stays is confirmed on the full sets.

    A bucket never meets itself in full.  First each member meets the bucket's
    hub, the member that shares most buckets with others.  Then documents that
    are not yet in their hub's component meet the hub's other documents, in
    blocks: all links between components are found, and links inside one are
    not needed.

    Returns ``doc_id, n_shingles, component_id, kept``.  Rows are told apart
    by their sets, not by id: rows of one id with unlike texts are different
    documents.  Rows with a null id link like others, give a component no
    name (it is null where no row has an id) and are never kept; equal rows
    are each returned; an empty table gives an empty result.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialize(_sets(src, words, True), "signatures")
    # a class is a set and stands in for its rows; its number is fixed once the table is stored
    classes = materialize(
        base.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("doc_id", F.monotonically_increasing_id()), "classes")
    reps = classes.select("doc_id", "sig", "bands")

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    members = materialize(rows.join(shared, "key"), "members")
    # of each bucket the member that meets most others, over all its buckets
    weight = materialize(members.groupBy("doc_id").agg((-F.sum("c")).alias("w")), "weights")
    hubs = materialize(members.join(weight, "doc_id").groupBy("key").agg(F.min(F.struct("w", "doc_id")).alias("m"))
                       .select("key", F.col("m.doc_id").alias("a")), "hubs")
    stars = materialize(members.join(hubs, "key").filter("a <> doc_id")
                        .select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    sets = _needed_sets(src, classes.select("digest", "id", "doc_id").join(weight.select("doc_id"), "doc_id", "left_semi"),
                        words)
    needed = matches_needed(threshold, miss)

    sigs = reps.select("doc_id", "sig")
    full = stars.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a") \
        .join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    left = materialize(_prune(full.select("a", "b", "sa", "sb"), needed), "star-candidates")
    full = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a") \
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
    links = materialize(_confirm(full.select("a", "b", "xa", "xb"), threshold), "star-links")
    found = materialize(components(links), "components")
    more = materialize(_cross_links(stars, found, sigs, sets, needed, threshold), "cross-links")
    final = found if more.isEmpty() else materialize(components(links.unionByName(more)), "all-components")

    least = final.join(classes.select(F.col("doc_id").alias("node"), "id"), "node") \
        .groupBy("root").agg(F.min("id").alias("least"))
    roots = materialize(classes.join(final, classes.doc_id == final.node, "left").select("digest", "id", "root"), "roots")
    named = roots.join(materialize(least, "least-ids"), "root", "left").select(
        "digest", F.coalesce("least", "id").alias("component"))
    out = base.join(materialize(named, "named"), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _needed_sets(src: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """``doc_id`` (class number) and ``shingles`` of the classes (digest, id, doc_id) that share a bucket with another."""
    ids = classes.select(F.col("id").alias("_id")).distinct()
    texts = src.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    full = _sets(texts, words, False).dropDuplicates(["digest"])
    return materialize(full.join(classes.select("digest", "doc_id"), "digest").select("doc_id", "shingles"), "sets")


def _cross_links(stars: DataFrame, found: DataFrame, sigs: DataFrame, sets: DataFrame, needed: list[int],
                 threshold: Fraction, block_bytes: int = 8 << 20) -> DataFrame:
    """Links between different components among the documents that met one hub.

    Only documents outside the hub's component have anything left to find.
    They meet the hub's other documents in blocks of about ``block_bytes`` of
    shingle sets; a block's pairs are pruned, confirmed and reduced to one
    link per document and component where they are made.
    """
    root = found.select(F.col("node").alias("b"), "root")
    hub_root = found.select(F.col("node").alias("a"), F.col("root").alias("hub_root"))
    of = stars.join(root, "b", "left").join(hub_root, "a", "left").select(
        "a", "b", F.coalesce("root", "b").alias("root"), F.coalesce("hub_root", "a").alias("hub_root"))
    sizes = sets.select(F.col("doc_id").alias("b"), (F.octet_length("shingles") + 512).alias("bytes"))
    of = materialize(of.join(sizes, "b"), "met")
    open_hubs = of.groupBy("a").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("bytes").alias("bytes")).filter("lo <> hi") \
        .select("a", F.ceil(F.col("bytes") / block_bytes).cast("long").alias("blocks"))
    met = of.join(materialize(open_hubs, "open-hubs"), "a") \
        .withColumn("own", F.pmod(F.xxhash64("b"), "blocks")) \
        .withColumn("all", F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asks = met.filter("root <> hub_root").select("a", "b", "root", F.lit(True).alias("asks"),
                                                 F.col("own").alias("i"), F.explode("all").alias("j"))
    told = met.select("a", "b", "root", F.lit(False).alias("asks"), F.explode("all").alias("i"),
                      F.col("own").alias("j"))
    both = asks.unionByName(told).join(sigs.withColumnRenamed("doc_id", "b"), "b") \
        .join(sets.withColumnRenamed("doc_id", "b"), "b")

    def links(rows):
        return _block_links(rows, needed, threshold)

    return both.groupBy("a", "i", "j").applyInPandas(links, "a long, b long").distinct()


def _block_links(rows: pd.DataFrame, needed: list[int], threshold: Fraction) -> pd.DataFrame:
    asks, told = rows[rows["asks"]], rows[~rows["asks"]]
    out: list[tuple[int, int]] = []
    if len(asks) and len(told):
        sig = np.array([np.frombuffer(x, np.uint32) for x in told["sig"]])
        shingles = [np.frombuffer(x, np.uint64) for x in told["shingles"]]
        size = np.array([len(x) for x in shingles])
        first = np.concatenate([[0], np.cumsum(size)])
        known, place = np.unique(np.concatenate(shingles), return_inverse=True)
        ids, roots = told["b"].to_numpy(), told["root"].to_numpy()
        p, q = threshold.numerator, threshold.denominator
        for x, x_root, x_sig, x_set in zip(asks["b"], asks["root"], asks["sig"], asks["shingles"], strict=True):
            others = np.flatnonzero(roots != x_root)
            own = np.frombuffer(x_set, np.uint64)
            others = others[(q * np.minimum(size[others], len(own)) >= p * np.maximum(size[others], len(own)))]
            mine = np.broadcast_to(np.frombuffer(x_sig, np.uint32), (len(others), HASHES))
            others = others[_survivors(sig[others], mine, needed)]
            if not len(others):
                continue
            mark = np.zeros(len(known) + 1, np.int32)
            mark[np.searchsorted(known, own[np.isin(own, known, assume_unique=True)])] = 1
            common = np.array([mark[place[first[k]:first[k + 1]]].sum() for k in others])
            linked = others[q * common >= p * (size[others] + len(own) - common)]
            _, one = np.unique(roots[linked], return_index=True)
            out += [(min(x, int(ids[k])), max(x, int(ids[k]))) for k in linked[one]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, all columns unchanged.

    Rows are told apart by numbers of their own, not by id: rows of one id
    with unlike texts are different documents, and rows without an id are
    documents as well.  Of a group the row with the smallest id stays (null
    ids last), of equal ids the first row; texts without words always stay.
    """
    numbered = materialize(df.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("record")),
                           "numbered", codec="zstd")
    texts = numbered.select("uid", F.col("record").getField(text_col).alias("text"))
    groups = near_groups(texts, id_col="uid", text_col="text", **options).select(F.col("doc_id").alias("uid"), "component_id")
    groups = materialize(groups, "near-groups")
    # groups of two rows or more, without all others
    large = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("component_id")
    members = materialize(groups.join(large, "component_id", "left_semi"), "near-members")
    ids = numbered.select("uid", F.col("record").getField(id_col).cast("long").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "uid")
    stays = members.join(ids, "uid").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.uid").alias("uid"))
    gone = members.join(stays, "uid", "left_anti").select("uid")
    return numbered.join(gone, "uid", "left_anti").select("record.*")
