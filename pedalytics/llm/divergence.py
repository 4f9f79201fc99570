"""How far the sources of a language differ in their words: exact counts, pair sums and telling terms."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalytics.llm.common import materialize, shared_root
from pedalytics.llm.textnum import hashes
from pedalytics.llm.textnum import slices as slices_of

# what separates terms: every ASCII character that is no letter; only A-Z are lower-cased
_APART = np.zeros(256, bool)
_APART[:128] = [not chr(c).isalpha() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

TAG = "\x00"             # between language and term; no term holds it
SCALE = 1_000_000_000    # shares are whole numbers of this
MOST_SLOTS = 2_000_000   # terms in one vectorizer's dictionary
PROBE = 64               # of so many equal parts of the terms, one is counted to find the dictionary's size
SOURCE_BLOCK = 512       # sources that meet as many others in one task
RUN_BYTES = 8 << 20      # text whose terms are looked up at a time
CACHE_BYTES = 1 << 19    # text that is cut into terms at a time
BUCKET_ROWS = 200_000    # (source, term) counts of one task
HELD_CELLS = 1 << 20     # sums of a group and term that a task holds before it hands them on
SENT_CELLS = 1 << 16     # of them, put out as rows at a time
BLOCK = 1 << 12          # slots whose sums travel together


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of bounded size with the bytes and offsets of their texts."""
    for batch in batches:
        for row, end, raw, offsets in slices_of(batch.column("text"), RUN_BYTES):
            yield batch.slice(row, end - row), raw, offsets


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Text number and term (A-Z lower-cased) of all terms of consecutive texts."""
    inside = ~_APART[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])  # a term ends where its text does
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    ends = np.cumsum(np.flatnonzero(last) + 1 - start)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)),
                                             pa.py_buffer(_LOWER[raw[inside]]))
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets))), words


def _runs_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])


def summed(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``cells``, ascending, and the sums of their ``values``."""
    order = np.argsort(cells)
    cells = cells[order]
    heads = _runs_of(cells)
    return cells[heads], np.add.reduceat(values[order], heads) if len(heads) else values


def _tagged(batch: pa.RecordBatch, row: np.ndarray, words: pa.Array) -> pa.Array:
    lang = batch.column("lang").cast(pa.large_string()).take(pa.array(row))
    return pc.binary_join_element_wise(lang, words, pa.scalar(TAG, pa.large_string()))


def _cut(raw: np.ndarray, offsets: np.ndarray, slices: int, k: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """First row, row after that and term of all terms (of slice ``k`` by hash), for whole documents at a time."""
    at = 0
    while at + 1 < len(offsets):  # small runs stay in the processor's caches
        end = max(int(np.searchsorted(offsets, offsets[at] + CACHE_BYTES, "right")) - 1, at + 1)
        row, words = terms(raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        if slices > 1 and len(words):
            places = np.frombuffer(words.buffers()[1], np.int64)
            own = hashes(np.frombuffer(words.buffers()[2], np.uint8), places[:-1], places[1:]) % np.uint64(slices) == k
            row, words = row[own], words.filter(pa.array(own))
        yield at, row, words
        at = end


def tagged_terms(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, slices: int = 1, k: int = 0
                 ) -> tuple[np.ndarray, pa.Array]:
    """Row and term, tagged by the row's language, of all terms (of slice ``k`` by hash) of a run of documents."""
    rows, found = [np.zeros(0, np.int64)], [pa.array([], pa.large_string())]
    for at, row, words in _cut(raw, offsets, slices, k):
        rows.append(row + at)
        found.append(words)
    row = np.concatenate(rows)
    return row, _tagged(batch, row, pa.concat_arrays(found))


def document_terms(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, slices: int = 1, k: int = 0
                   ) -> tuple[np.ndarray, pa.Array]:
    """Row (ascending) and tagged term of each different term of each document."""
    rows, found = [np.zeros(0, np.int64)], [pa.array([], pa.large_string())]
    for at, row, words in _cut(raw, offsets, slices, k):
        if not len(words):
            continue
        told = words.dictionary_encode()
        cells = np.sort(row * len(told.dictionary) + told.indices.to_numpy())
        row, code = np.divmod(cells[_runs_of(cells)], len(told.dictionary))
        rows.append(row + at)
        found.append(told.dictionary.take(pa.array(code)))
    row = np.concatenate(rows)
    return row, _tagged(batch, row, pa.concat_arrays(found))


def share(count: Column, total: Column, size: Column, smooth: int) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * size)), exact; 0 where ``size`` is 0."""
    top = (count + smooth).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(smooth).cast("long") * size).cast("decimal(28,0)")
    return F.when(size > 0, F.call_function("div", top, F.when(size > 0, below)) + 1).otherwise(0).cast("long")


def _slices(docs: DataFrame, min_df: int, most_slots: int) -> int:
    """Number of equal parts of the terms so that a part's dictionary holds about ``most_slots`` at most.

    Counts the occurrences of one part in PROBE of the terms; a term with
    fewer than ``min_df`` of them stands in fewer documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in runs(batches):
            found = tagged_terms(batch, raw, offsets, PROBE)[1].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["key", "c"])

    often = docs.select("lang", "text").mapInArrow(run, "key string, c long").groupBy("key").agg(
        F.sum("c").alias("c")).filter(F.col("c") >= min_df).count()
    return -(-often * PROBE // most_slots) or 1


def _fit(docs: DataFrame, min_df: int, slices: int, k: int) -> DataFrame:
    """``pos, key`` of the vocabulary (tagged terms) of slice ``k``, read back from the stored model.

    Document frequencies alone decide what is kept, so the vectorizer meets
    each term of a document once.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets in runs(batches):
            row, tagged = document_terms(batch, raw, offsets, slices, k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tagged.cast(pa.string()))],
                                             ["terms"])

    # so that a vocabulary is never empty; the tag alone is no term
    never = spark.range(min_df).select(F.array(F.lit(TAG)).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=2**31 - 1) \
        .fit(docs.select("lang", "text").mapInArrow(run, "terms array<string>").unionByName(never))
    path = f"{shared_root(spark)}/llm-vocabulary-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("pos", "key")).filter(F.col("key") != TAG)


def _packed(groups: dict[tuple[str, str], int], cells: np.ndarray, sums: np.ndarray, blocks: int) -> pa.RecordBatch:
    """``lang, source, block, at, c``: the sums of each group's blocks of slots as bytes."""
    heads = _runs_of(cells // BLOCK)
    of, block = np.divmod(cells[heads] // BLOCK, blocks)
    lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(of)) for i in (0, 1))
    ends = np.append(heads, len(cells))
    at, c = (pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
             for v in ((cells % BLOCK).astype(np.uint16), sums))
    return pa.RecordBatch.from_arrays([lang, source, pa.array(block), at, c], ["lang", "source", "block", "at", "c"])


def group_cells(batches: Iterator[pa.RecordBatch], words: pa.Array, slices: int = 1, k: int = 0) -> Iterator[pa.RecordBatch]:
    """A task's documents as sparse vectors over a vocabulary, summed by group.

    Sums are held over runs and batches and handed on once, or as often as
    more than half of HELD_CELLS remain after adding up.
    """
    blocks = -(-len(words) // BLOCK) or 1
    groups: dict[tuple[str, str], int] = {}
    nothing = np.zeros((2, 0), np.int64)
    waiting, size = [nothing], 0
    for batch, raw, offsets in runs(batches):
        # one sparse vector per document: its slots and their counts
        row, tagged = tagged_terms(batch, raw, offsets, slices, k)
        slot = pc.index_in(tagged, words)
        known = slot.is_valid().to_numpy(zero_copy_only=False)
        entries = np.sort(row[known] * len(words) + slot.drop_null().to_numpy())
        heads = _runs_of(entries)
        row, slot = np.divmod(entries[heads], max(len(words), 1))
        counts = np.diff(np.append(heads, len(entries)))
        lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        names, group = np.unique(group, return_inverse=True)
        pairs = zip(lang.dictionary.take(pa.array(names // len(source.dictionary))).to_pylist(),
                    source.dictionary.take(pa.array(names % len(source.dictionary))).to_pylist(), strict=True)
        own = np.array([groups.setdefault(pair, len(groups)) for pair in pairs], np.int64)
        waiting.append(summed(own[group[row]] * (blocks * BLOCK) + slot, counts))
        size += len(waiting[-1][0])
        if size > HELD_CELLS:
            held = summed(*np.concatenate(waiting, 1))
            waiting, size = [held], len(held[0])
            if size > HELD_CELLS // 2:
                yield _packed(groups, *held, blocks)
                groups, waiting, size = {}, [nothing], 0
    yield _packed(groups, *summed(*np.concatenate(waiting, 1)), blocks)


def added_cells(batches: Iterator[pa.RecordBatch], positions: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``lang, source, pos, c``: packed sums of several tasks, added up."""
    keys: dict[tuple[str, str, int], int] = {}
    waiting, size, least = [np.zeros((2, 0), np.int64)], 0, HELD_CELLS
    for batch in batches:
        for lang, source, block, at, c in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            first = keys.setdefault((lang, source, block), len(keys)) * BLOCK
            waiting.append((np.frombuffer(at, np.uint16).astype(np.int64) + first, np.frombuffer(c, np.int64)))
            size += len(waiting[-1][0])
            if size > least:
                waiting = [summed(*np.concatenate(waiting, 1))]
                size = len(waiting[0][0])
                least = max(HELD_CELLS, 2 * size)
    cells, sums = summed(*np.concatenate(waiting, 1))
    lang, source = (pa.array([key[i] for key in keys], pa.string()) for i in (0, 1))
    block = np.array([key[2] for key in keys], np.int64)
    for begin in range(0, len(cells), SENT_CELLS):
        of, at = np.divmod(cells[begin:begin + SENT_CELLS], BLOCK)
        yield pa.RecordBatch.from_arrays([
            lang.take(pa.array(of)), source.take(pa.array(of)), pa.array(positions[block[of] * BLOCK + at], pa.int64()),
            pa.array(sums[begin:begin + SENT_CELLS])], ["lang", "source", "pos", "c"])


def _group_sums(docs: DataFrame, vocabulary: DataFrame, slices: int, k: int) -> DataFrame:
    """``lang, source, pos, c``: the documents' sparse vectors over a vocabulary, summed by group.

    A task's sums travel as one row for a group and block of slots.
    """
    context = docs.sparkSession.sparkContext
    told = vocabulary.toArrow()
    words = context.broadcast(told.column("key").combine_chunks().cast(pa.large_string()))
    positions = context.broadcast(told.column("pos").to_numpy())
    return docs.mapInArrow(lambda batches: group_cells(batches, words.value, slices, k),
                           "lang string, source string, block long, at binary, c binary") \
        .repartition("lang", "source", "block") \
        .mapInArrow(lambda batches: added_cells(batches, positions.value), "lang string, source string, pos long, c long")


def group_counts(docs: DataFrame, min_df: int = 30, most_slots: int = MOST_SLOTS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of each kept term in each (lang, source), and the kept terms of each lang.

    A document's terms carry its language as a tag, so one ``CountVectorizer``
    (``minDF``, largest integer as ``vocabSize``) finds the vocabularies of all
    languages in one pass, with a document frequency for each language.  Its
    dictionary goes through the driver and to all executors; a count of one
    part in 64 of the terms tells its size beforehand, and beyond
    ``most_slots`` the terms are cut by hash into slices with a vectorizer
    each.  Documents become sparse count vectors over the vocabulary in Arrow
    batches (the model's own transform takes three times as long) and are
    summed by group over a task's batches, before the shuffle.

    Returns ``lang, source, slot, c`` (c > 0) and ``lang, term, slot``.
    """
    slices = _slices(docs, min_df, most_slots)
    counts, words = [], []
    for k in range(slices):
        vocabulary = _fit(docs, min_df, slices, k)
        slot = (F.col("pos").cast("long") * slices + k).alias("slot")
        term = F.substring_index("key", TAG, -1)
        words.append(vocabulary.select(F.left("key", F.length("key") - F.length(term) - 1).alias("lang"),
                                       term.alias("term"), slot))
        counts.append(_group_sums(docs, vocabulary, slices, k).select("lang", "source", slot, "c"))
    return (materialize(reduce(DataFrame.unionByName, counts), "group-counts"),
            materialize(reduce(DataFrame.unionByName, words), "terms"))


def _groups(docs: DataFrame, counts: DataFrame, words: DataFrame, smooth: int) -> DataFrame:
    """One row per occurring (lang, source): N, V, the share of an absent term, its block and place in the block."""
    size = words.groupBy(F.col("lang").alias("v_lang")).agg(F.count(F.lit(1)).alias("size"))
    total = counts.groupBy(F.col("lang").alias("n_lang"), F.col("source").alias("n_source")).agg(F.sum("c").alias("total"))
    rows = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"))
    rows = rows.join(size, F.col("lang") == F.col("v_lang"), "left") \
        .join(total, (F.col("lang") == F.col("n_lang")) & (F.col("source") == F.col("n_source")), "left") \
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return rows.select("*", number.cast("long").alias("number"), share(
        F.lit(0), F.col("total"), F.col("size"), smooth).alias("absent"))


def _in_blocks(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row once for every pair of source blocks its source is in (``low`` <= ``high``)."""
    blocks = groups.groupBy("lang").agg((F.max("number") / SOURCE_BLOCK).cast("long").alias("last"))
    own = F.floor(F.col("number") / SOURCE_BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    return rows.join(blocks, "lang").select("*", own.alias("own"), other.alias("other")) \
        .select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _unordered(lang: str, low: int, high: int, sums: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
    """Pairs (a < b by number) of two blocks of sources with their sums."""
    if low == high:
        seen = np.triu(seen, 1)
    a, b = np.nonzero(seen)
    return pd.DataFrame({"lang": lang, "a": a + low * SOURCE_BLOCK, "b": b + high * SOURCE_BLOCK, "value": sums[a, b]})


def _places(rows: pd.DataFrame, low: int, high: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    first, second = rows[rows["own"] == low], rows[rows["own"] == high]
    return (first.assign(at=first["number"] - low * SOURCE_BLOCK), second.assign(at=second["number"] - high * SOURCE_BLOCK))


def _apart(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over all terms as if no term occurred in both sources of a pair.

    V * |a0 - b0| and, for each term of one of them, what its share adds to
    that; a source's shares come as sorted values with their numbers of terms,
    so a sum of distances to b0 follows from cumulative sums.
    """
    lang, low, high = str(key[0]), int(key[1]), int(key[2])
    first, second = _places(rows, low, high)
    sums = np.zeros((SOURCE_BLOCK, SOURCE_BLOCK), np.int64)
    seen = np.zeros(sums.shape, bool)

    def added(x: pd.DataFrame, y: pd.DataFrame, out: np.ndarray) -> None:
        y_at, y0 = y["at"].to_numpy(), y["absent"].to_numpy()
        for at, x0, shares, numbers in zip(x["at"], x["absent"], x["shares"], x["numbers"], strict=True):
            if shares is None or not len(shares):
                continue
            p, n = np.asarray(shares, np.int64), np.asarray(numbers, np.int64)
            below = np.searchsorted(p, y0)
            count = np.concatenate([[0], np.cumsum(n)])
            total = np.concatenate([[0], np.cumsum(p * n)])
            far = y0 * count[below] - total[below] + (total[-1] - total[below]) - y0 * (count[-1] - count[below])
            out[at, y_at] += far - count[-1] * np.abs(y0 - x0)

    if len(first) and len(second):
        x, y = first["at"].to_numpy(), second["at"].to_numpy()
        seen[np.ix_(x, y)] = True
        sums[np.ix_(x, y)] = int(first["size"].iloc[0]) * np.abs(
            first["absent"].to_numpy()[:, None] - second["absent"].to_numpy()[None, :])
        added(first, second, sums)
        added(second, first, sums.T)
    return _unordered(lang, low, high, sums, seen)


def _together(key, rows: pd.DataFrame) -> pd.DataFrame:
    """What terms that occur in both sources of a pair change in its sum, over a bucket of terms."""
    lang, low, high = str(key[0]), int(key[1]), int(key[2])
    first, second = _places(rows, low, high)
    sums = np.zeros((SOURCE_BLOCK, SOURCE_BLOCK), np.int64)
    seen = np.zeros(sums.shape, bool)

    def by_slot(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
        part = part.sort_values("slot")
        slots, starts = np.unique(part["slot"].to_numpy(), return_index=True)
        return slots, np.append(starts, len(part)), *(part[c].to_numpy() for c in ("at", "p", "absent"))

    slots, start, at, p, p0 = by_slot(first)
    same, start_b, at_b, q, q0 = by_slot(second)
    _, i, j = np.intersect1d(slots, same, assume_unique=True, return_indices=True)
    for k, m in zip(i.tolist(), j.tolist(), strict=True):
        x, y = slice(start[k], start[k + 1]), slice(start_b[m], start_b[m + 1])
        a, a0, b, b0 = p[x, None], p0[x, None], q[None, y], q0[None, y]
        where = np.ix_(at[x], at_b[y])
        sums[where] += np.abs(a - b) - np.abs(a - b0) - np.abs(a0 - b) + np.abs(a0 - b0)
        seen[where] = True
    return _unordered(lang, low, high, sums, seen)


def pair_sums(counts: DataFrame, groups: DataFrame, smooth: int) -> DataFrame:
    """``lang, source, item, value``: for each ordered pair of a lang's sources the sum of |p - q| over its kept terms.

    Sparse: a pair's sum is taken as if the two had no term in common (from
    each source's numbers of terms by share) and then corrected by the terms
    that both hold.  Blocks of 512 sources meet in tasks of bounded size; sums
    leave a task, pairs of rows do not.
    """
    rows = counts.join(groups, ["lang", "source"]).select(
        "lang", "number", "slot", "absent", share(F.col("c"), F.col("total"), F.col("size"), smooth).alias("p"))
    rows = materialize(rows, "shares")
    by_share = rows.groupBy("lang", "number", "p").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("lang", "number").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("h")) \
        .select(F.col("lang").alias("h_lang"), F.col("number").alias("h_number"), F.col("h.p").alias("shares"),
                F.col("h.n").alias("numbers"))
    own = groups.join(by_share, (F.col("lang") == F.col("h_lang")) & (F.col("number") == F.col("h_number")), "left") \
        .select("lang", "number", "size", "absent", "shares", "numbers")
    schema = "lang string, a long, b long, value long"
    apart = _in_blocks(own, groups).groupBy("lang", "low", "high").applyInPandas(_apart, schema)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("slot"), F.lit(buckets))
    shared = _in_blocks(rows, groups).withColumn("bucket", bucket) \
        .groupBy("lang", "low", "high", "bucket").applyInPandas(_together, schema)
    sums = apart.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "number", "source")
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("number"), F.col("b").alias("with")),
                                                 F.struct(F.col("b").alias("number"), F.col("a").alias("with")))).alias("s"),
                       "value").select("lang", "s.number", "s.with", "value")
    return both.join(names, ["lang", "number"]).join(
        names.select("lang", F.col("number").alias("with"), F.col("source").alias("item")), ["lang", "with"]) \
        .select("lang", "source", "item", "value")


def telling_terms(counts: DataFrame, words: DataFrame, groups: DataFrame, smooth: int) -> DataFrame:
    """``lang, source, item, value``: terms that a group holds with a larger share than its whole language."""
    of_lang = counts.groupBy("slot").agg(F.sum("c").alias("all"))
    lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("size").alias("lang_size"))
    whole = words.join(of_lang, "slot").join(lang, "lang").select(
        "slot", "term", share(F.col("all"), F.col("lang_total"), F.col("lang_size"), smooth).alias("q"))
    own = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "slot", share(F.col("c"), F.col("total"), F.col("size"), smooth).alias("p"))
    return own.join(whole, "slot").filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit_sources(df: DataFrame, min_df: int = 30, smooth: int = 5, top: int = 50, text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source", most_slots: int = MOST_SLOTS) -> DataFrame:
    """Divergence of the sources of each language, from exact term counts.

    Each language keeps the terms that stand in at least ``min_df`` of its
    documents.  Of every occurring (lang, source) and of each language a term
    has the smoothed share p (whole billionths).  Part ``pair`` gives for each
    other source of the language the sum of the shares' differences over all
    kept terms; part ``term`` the group's ``top`` terms whose share exceeds
    the language's.  Ranks run by falling value, then item in UTF-8 order.

    Returns ``lang, source, part, item, value, rank``.  Null text, language
    and source are empty strings; a text without terms still makes its group
    occur; a language without kept terms has pairs of value 0; repeated rows
    are documents of their own; an empty table gives an empty result.
    """
    docs = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (
        (text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts, words = group_counts(docs, min_df, most_slots)
    groups = materialize(_groups(docs, counts, words, smooth), "source-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pair_sums(counts, groups, smooth).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    told = telling_terms(counts, words, groups, smooth) \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).filter(F.col("rank") <= top)
    return pairs.unionByName(told)
