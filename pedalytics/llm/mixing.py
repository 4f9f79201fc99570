"""Mixing sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pedalytics.llm.common import SPACE_CLASS, materialize
from pedalytics.llm.permutation import with_permuted

WEIGHTS = (5, 2, 1)
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS,
                   share: Fraction = Fraction(3, 2), limit: int = 2) -> list[dict]:
    """Targets in words: ``share`` of all sizes dealt by weight, none above ``limit`` times its size.

    Sources are in code point order, null last, and the weights repeat.  What
    a source at its limit leaves over is dealt again to the others by weight.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    rows = [{"source": s, "size": sizes[s], "weight": weights[i % len(weights)]} for i, s in enumerate(names)]
    left, open_rows = share * sum(r["size"] for r in rows), list(range(len(rows)))
    while open_rows:
        unit = left / sum(rows[i]["weight"] for i in open_rows)
        full = {i for i in open_rows if unit * rows[i]["weight"] > limit * rows[i]["size"]}
        for i in full or open_rows:
            rows[i]["target"] = Fraction(limit * rows[i]["size"]) if full else unit * rows[i]["weight"]
        left -= sum(rows[i]["target"] for i in full)
        open_rows = [i for i in open_rows if i not in full] if full else []
    return rows


def mix_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              block_words: int = 64, shard_blocks: int = 4096, seed: int = 29,
              buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Mix all documents: returns (documents with sizes and targets, spans that the mix takes).

    A source's documents, in a hashed order, form one run of words that is cut
    into blocks of ``block_words``.  The output is a row of slots, cut into
    shards of ``shard_blocks``.  Every slot draws its source by weight (the
    counts of a shard are multinomial).  A source drawn more often than its
    target asks hands its last draws to sources drawn too seldom, so totals
    meet the targets to within a block.  The k-th slot of a source with n
    blocks takes block perm(k mod n) of epoch k div n, with a keyed
    permutation for each source and epoch; the last slot takes only the words
    still missing.  Slots and documents meet in a join on (source, block).

    Documents: ``doc_id, source, size, source_size, target`` and more, one row
    per input row.  Spans: ``doc_id, source, shard, slot, epoch, first, length`` —
    words ``first`` to ``first + length - 1`` (from 0) of a document.  Null or
    empty texts have size 0 and give no span; a null source is a source of
    its own; repeated rows are documents of their own; no rows give no spans.
    The driver holds one row of totals for each source, and slots draw theirs
    from an alias table; above 10,000 sources such tables are not broadcast by rule.
    """
    spark = df.sparkSession
    sized = materialize(_sizes(df, id_col, text_col, source_col), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("s")).collect()
    rows = source_targets({r["source"]: r["s"] for r in totals})
    for i, r in enumerate(rows):
        words, n = round(r["target"]), math.ceil(r["size"] / block_words)
        epochs = words // r["size"] if r["size"] else 0
        rest = words - epochs * r["size"]
        r |= {"i": i, "blocks": n, "epochs": epochs, "rest": rest,
              "quota": epochs * n + math.ceil(rest / block_words), "t": float(r["target"])}
    info = _table(spark, [{k: v for k, v in r.items() if k != "target"} for r in rows],
                  "i:int,source:string,size:long,blocks:long,epochs:long,rest:long,quota:long,t:double")
    docs = (sized.join(info.select("i", F.col("source").alias("_s"), F.col("size").alias("source_size"),
                                   F.col("t").alias("target")),
                       sized.source.eqNullSafe(F.col("_s"))).drop("_s"))

    # each document's first word in its source's run: sums by bucket, then inside the bucket
    docs = docs.withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = docs.groupBy("i", "b").agg(F.sum("size").alias("c")).select(
        "i", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("i", "b").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(
        docs.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ahead, ["i", "b"]).withColumn("start", F.col("ahead") + F.col("in_bucket"))
        .select("doc_id", "tie", "copy", "source", "size", "source_size", "target", "i", "start"), "runs")
    pieces = runs.filter("size > 0").select(
        "doc_id", "source", "i", "start", (F.col("start") + F.col("size")).alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / block_words),
                             F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))

    slots = _slots(spark, rows, info, block_words, shard_blocks, seed)
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("end"), F.col("block") * block_words + F.col("words"))
    spans = pieces.join(slots, ["i", "block"]).withColumn("length", hi - lo).filter("length > 0").select(
        "i", "start", "doc_id", "source", "shard", "slot", "epoch", (lo - F.col("start")).alias("first"), "length")
    return runs, spans


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per row its word count, ``tie`` (hash of id, text and source) and ``copy`` (number among equal rows).

    Words are counted where the text is read; only the counts are shuffled.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                     F.xxhash64(id_col, text_col, source_col).alias("tie"), word_count(F.col(text_col)).alias("size"))
    same = Window.partitionBy("doc_id", "tie").orderBy("source", "size")
    return rows.withColumn("copy", F.row_number().over(same))


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """Rows about sources as a table: broadcast up to BROADCAST_SOURCES, beyond that stored and left to the planner."""
    out = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return out.select("r.*").hint("broadcast") if len(rows) <= BROADCAST_SOURCES else materialize(out.select("r.*"), "sources")


def alias_table(quotas: list[int]) -> list[dict]:
    """Cells to draw source i with chance quota / total: cell j gives j below ``below`` (of total), else ``other``."""
    total, n = sum(quotas), len(quotas)
    mass, cells = [q * n for q in quotas], [{"j": j, "below": total, "other": j} for j in range(n)]
    short, rich = [j for j in range(n) if mass[j] < total], [j for j in range(n) if mass[j] >= total]
    while short:
        j, giver = short.pop(), rich[-1]
        cells[j] |= {"below": mass[j], "other": giver}
        mass[giver] -= total - mass[j]
        if mass[giver] < total:
            short.append(rich.pop())
    return cells


def _slots(spark, rows: list[dict], info: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """The output's slots: shard, slot, source index, epoch, block and the words it takes."""
    total = sum(r["quota"] for r in rows)
    cells = _table(spark, alias_table([r["quota"] for r in rows]) if total else [], "j:int,below:long,other:int")
    # one hash picks the cell, another one which of the cell's two sources
    drawn = spark.range(total).select(
        F.floor(F.col("id") / shard_blocks).cast("long").alias("shard"),
        (F.col("id") % shard_blocks).alias("slot"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(len(rows), 1))).cast("int").alias("j"),
        F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(total, 1))).alias("u")) \
        .join(cells, "j").select("shard", "slot", F.when(F.col("u") < F.col("below"), F.col("j"))
                                 .otherwise(F.col("other")).alias("drawn"))
    # rank of a slot among its source's slots: counts by shard, then inside the shard
    counts = drawn.groupBy("drawn", "shard").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("drawn").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("drawn", "shard", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("drawn", "shard").orderBy("slot")
    ranked = drawn.withColumn("k", F.row_number().over(inside) - 1).join(ahead, ["drawn", "shard"]) \
        .withColumn("k", F.col("k") + F.col("ahead")).drop("ahead")
    # draws beyond a source's quota go, in order, to the sources that got too few
    got = {r["drawn"]: r["c"] for r in drawn.groupBy("drawn").agg(F.count(F.lit(1)).alias("c")).collect()}
    over, gaps, gap_end = 0, [], 0
    quotas = []
    for r in rows:
        n = got.get(r["i"], 0)
        quotas.append({"drawn": r["i"], "quota": r["quota"], "over_before": over})
        over += max(0, n - r["quota"])
        if n < r["quota"]:
            gaps.append({"to": r["i"], "lo": gap_end, "hi": gap_end + r["quota"] - n, "shift": n - gap_end})
            gap_end += r["quota"] - n
    gaps = _table(spark, gaps, "to:int,lo:long,hi:long,shift:long").select(
        F.explode(F.sequence("lo", F.col("hi") - 1)).alias("extra"), "to", "shift")
    moved = ranked.join(_table(spark, quotas, "drawn:int,quota:long,over_before:long"), "drawn")
    # draws within their quota get keys of their own, which meet no gap and fall into all partitions
    beyond = F.col("k") >= F.col("quota")
    moved = moved.withColumn("extra", F.when(beyond, F.col("k") - F.col("quota") + F.col("over_before"))
                             .otherwise(-1 - F.col("shard") * shard_blocks - F.col("slot"))).join(gaps, "extra", "left")
    moved = moved.select("shard", "slot", F.coalesce("to", "drawn").alias("i"),
                         F.when(beyond, F.col("extra") + F.col("shift")).otherwise(F.col("k")).alias("k"))
    placed = moved.join(info.select("i", "blocks", "epochs", "rest"), "i")
    epoch = F.least(F.floor(F.col("k") / F.col("blocks")).cast("long"), F.col("epochs"))
    placed = placed.withColumn("epoch", epoch).withColumn("j", F.col("k") - F.col("epoch") * F.col("blocks"))
    words = F.when(F.col("epoch") < F.col("epochs"), F.lit(block_words)).otherwise(
        F.least(F.lit(block_words), F.col("rest") - F.col("j") * block_words))
    key = F.xxhash64(F.lit(seed), F.col("i"), F.col("epoch"))
    placed = with_permuted(placed, "block", F.col("j"), F.col("blocks"), key)
    return placed.select("i", "shard", "slot", "epoch", "block", words.cast("long").alias("words"))


def taken_words(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    taken = spans.groupBy("i", "start").agg(F.sum("length").alias("n"))
    joined = runs.withColumn("key", F.when(F.col("size") > 0, F.col("start"))).join(
        taken.select("i", F.col("start").alias("key"), "n"), ["i", "key"], "left")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: for each epoch that takes words of a document, its row with those words.

    All columns of ``df`` stay; the text holds the taken words in their
    order, joined by spaces unless the whole text is taken.  A document taken
    twice gives two rows with one id.
    """
    runs, spans = mix_spans(df, id_col, text_col, source_col, **options)
    parts = spans.groupBy("i", "start", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("first", "length"))).alias("parts"), F.sum("length").alias("words"))
    parts = parts.join(runs.filter("size > 0").select("i", "start", "size", F.col("doc_id").alias("_id"),
                                                      F.col("tie").alias("_tie"), F.col("copy").alias("_copy")),
                       ["i", "start"])
    same = Window.partitionBy(F.col("_key"), F.col("_h")).orderBy("_key")
    rows = df.select(F.struct("*").alias("record")).select(
        "record", F.col("record").getField(id_col).alias("_key"),
        F.xxhash64(F.col("record").getField(id_col), F.col("record").getField(text_col),
                   F.col("record").getField(source_col)).alias("_h")) \
        .withColumn("_n", F.row_number().over(same))
    taken = rows.join(parts, rows._key.eqNullSafe(parts._id) & (rows._h == parts._tie) & (rows._n == parts._copy))
    text = F.col("record").getField(text_col)
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))
    # a one-element array binds the words, so that they are found once and not for every part
    bound = F.array(F.struct(words.alias("w"), F.col("parts").alias("p")))
    cut = F.element_at(F.transform(bound, lambda d: F.concat_ws(" ", F.flatten(F.transform(
        d["p"], lambda p: F.slice(d["w"], (p["first"] + 1).cast("int"), p["length"].cast("int")))))), 1)
    new_text = F.when(F.col("words") == F.col("size"), text).otherwise(cut)
    return taken.select(*[
        (new_text if c == text_col else F.char_length(new_text).cast(t) if c == "n_chars"
         else F.col("record").getField(c)).alias(c) for c, t in df.dtypes])
