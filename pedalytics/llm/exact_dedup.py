"""Exact deduplication by a 128-bit content hash, with byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.common import SPACE_CLASS, materialize


def normalised(text: Column) -> Column:
    """The text (null: empty) without any of the six separator characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", "")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document with the document that stands for its group of equal texts.

    Rows are grouped by a 128-bit hash (``digest``, md5) of the normalised
    text, and only hashes are shuffled for it.  For hashes of two rows or
    more the texts are compared as well: the least and the greatest text of a
    hash are the same exactly when all are.  Both are found with map-side
    combining, so a group of any size sends one pair per task.  Rows of a
    hash with different texts (a collision) are grouped by the text instead.

    Of a group the row with most code points in its original text stays, then
    the smallest id (null ids last).  Repeated rows count each; a null text
    is an empty one; an empty table gives an empty result.  Returns ``doc_id,
    keep_id, group_size, kept, text_sha256``.  Rows that repeat the kept id
    all say kept.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = src.withColumn("norm", normalised(F.col("text"))).withColumn("h", digest(F.col("norm")))
    keys = materialize(hashed.select(
        "doc_id", "h", F.sha2("norm", 256).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), "hashes")
    repeated = materialize(keys.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "repeated")
    members = keys.join(repeated, "h", "left_semi").select(F.col("doc_id").alias("m_id")).distinct()
    texts = src.join(members, src.doc_id.eqNullSafe(members.m_id), "left_semi") \
        .withColumn("norm", normalised(F.col("text"))).select("norm", digest(F.col("norm")).alias("h"))
    clashing = materialize(texts.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
                           .filter("lo <> hi").select("h"), "clashes")
    if clashing.isEmpty():
        return _decide(keys, ["h"])
    apart = hashed.join(clashing, "h", "left_semi").select(
        "doc_id", "h", F.sha2("norm", 256).alias("text_sha256"), "norm",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return _decide(keys.join(clashing, "h", "left_anti"), ["h"]).unionByName(_decide(apart, ["h", "norm"]))


def _decide(rows: DataFrame, group: list[str]) -> DataFrame:
    longest = rows.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first"))
    # stored, so that the join below has a plain exchange on either side and a hot group's rows can be split
    keep = materialize(longest.groupBy(*group).agg(F.sum("c").alias("group_size"),
                                                   F.max_by("first", "n").alias("keep_id")), "groups")
    return rows.join(keep, group).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, all columns unchanged.

    Of rows with one id and equal texts the one with most code points stays,
    then the one whose text has the greatest md5.
    """
    groups = exact_groups(df, id_col, text_col)
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "text_sha256").distinct()
    text = F.col("record").getField(text_col)
    rows = df.select(F.struct("*").alias("record")).withColumn("id", F.col("record").getField(id_col)) \
        .withColumn("sha", F.sha2(normalised(text), 256))
    kept = rows.join(gone, rows.id.eqNullSafe(gone.gone_id) & (rows.sha == gone.text_sha256), "left_anti")
    longest = F.struct(F.char_length(F.coalesce(text, F.lit(""))), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return kept.groupBy("id", "sha").agg(F.max_by("record", longest).alias("record")).select("record.*")
