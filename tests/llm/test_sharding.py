import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedalytics.llm.permutation import permute, with_permuted
from pedalytics.llm.sharding import shard_rows
from tests.llm.plain import permuted, spark_hash


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(permute(F.col("id"), F.lit(n), F.lit(9))).collect()]
    assert sorted(got) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1


def test_keys_give_different_orders(spark):
    rows = spark.range(500).select(permute(F.col("id"), F.lit(500), F.lit(1)).alias("a"),
                                   permute(F.col("id"), F.lit(500), F.lit(2)).alias("b")).toPandas()
    assert (rows["a"] != rows["b"]).mean() > 0.9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation_against_plain_python(spark, n):
    rows = with_permuted(spark.range(n), "p", F.col("id"), F.lit(n), F.lit(9)) \
        .withColumn("q", permute(F.col("id"), F.lit(n), F.lit(9))).collect()
    want = {i: permuted(i, n, 9) for i in range(n)}
    assert {r["id"]: r["p"] for r in rows} == want == {r["id"]: r["q"] for r in rows}


def test_permutation_rounds_are_generated_code(spark, capsys):
    with_permuted(spark.range(1000), "p", F.col("id"), F.lit(1000), F.lit(9)).explain()
    plan = capsys.readouterr().out
    assert plan.count("xxhash64") > 6 and plan.count("*(1) Project") >= 6


def test_places_against_plain_python(make_docs):
    """Rows of one id and rows without an id spread over buckets by their texts."""
    rows = [(i % 90 if i % 3 else None, f"text {i % 200}") for i in range(600)]
    got = shard_rows(make_docs(rows, 5), 7, buckets=16).select("record.doc_id", "record.text", "shard", "slot").collect()

    def place(row):
        h = spark_hash(row[1], kinds="s")
        return spark_hash(row[0], h, kinds="ll") % 16, (row[0] is not None, row[0] or 0), h, row[1]

    want = []
    for k, (doc_id, text) in enumerate(sorted(rows, key=place)):
        p = permuted(k, 600, 17)
        want.append((doc_id, text, p % 7, p // 7))
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_shards_are_even_gapless_and_stable(make_docs):
    rows = [(i, f"text {i}") for i in range(1003)]
    a = shard_rows(make_docs(rows, 5), 24).select("record.doc_id", "shard", "slot").toPandas()
    b = shard_rows(make_docs(rows[::-1], 2), 24).select("record.doc_id", "shard", "slot").toPandas()
    counts = a.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert len(counts) == 24 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
    assert (counts["nunique"] == counts["count"]).all()
    key = ["doc_id", "shard", "slot"]
    assert a.sort_values(key).values.tolist() == b.sort_values(key).values.tolist()


def test_odd_rows_and_clashing_names(clashing):
    got = shard_rows(clashing, 4).select("record", "shard", "slot").collect()
    assert len(got) == clashing.count()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted(
        (p % 4, p // 4) for p in range(len(got)))
    assert set(got[0]["record"].asDict()) == set(clashing.columns)


def test_empty_table(odd_docs):
    assert shard_rows(odd_docs.limit(0), 24).count() == 0


def test_query_digest(spark, tmp_path, odd_docs):
    from pedalytics.llm.registry import op1_sharding
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_sharding(spark, str(tmp_path)).toPandas()
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == sorted(
        (len(t.encode()) + 8, zlib.crc32(t.encode())) for t in texts)
