"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalytics.llm.permutation import number_rows, with_permuted


def shard_rows(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               seed: int = 17, buckets: int | None = None) -> DataFrame:
    """Deal all rows of ``df`` into ``shards`` shards in a reproducible shuffled order.

    Every row gets a global row number (by id, then text), a permuted number
    p, and with it shard = p mod shards and slot = p div shards.  Any row's
    place can be computed from its row number alone, shard sizes differ by at
    most one row, and slots are gapless from 0.

    Returns ``record`` (a struct of all input columns, so their names cannot
    clash), ``shard`` int and ``slot`` long.  Repeated rows each get a place
    of their own (equal rows are interchangeable), null ids and texts are
    ordinary values, and an empty table gives an empty result.  Rows are
    numbered in buckets by id and text, so one id may hold any share of them.
    """
    rows = df.select(F.struct("*").alias("record"))
    key, text = F.col("record").getField(id_col), F.col("record").getField(text_col)
    numbered = number_rows(rows, [key, F.xxhash64(text), text], [key, F.xxhash64(text)], buckets)
    return (with_permuted(numbered, "_p", F.col("_row"), F.col("_rows"), F.lit(seed))
            .select("record", (F.col("_p") % shards).cast("int").alias("shard"),
                    F.floor(F.col("_p") / shards).cast("long").alias("slot")))
