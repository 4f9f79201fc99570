import datetime

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples."""
    def make(rows, parts=3):
        full = [(*r, *("en", "a")[len(r) - 2:])[:4] for r in rows]
        data = [(i, t, g, s, len(t or "")) for i, t, g, s in full]
        return spark.createDataFrame(data, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and blank texts, a long text, repeated rows and ids, astral letters."""
    long = "word " * 30_000 + "x" * 5000
    rows = [(1, "alpha beta gamma delta", "en", "a"), (1, "alpha beta gamma delta", "en", "a"), (2, None, "en", None),
            (3, "", None, "b"), (4, " \t\n ", "de", None), (5, long, "en", "a"), (None, "lost id here now", "en", "b"),
            (6, "Alpha  beta\ngamma delta", "en", "a"), (7, "ünïcode \U0001d51e text ☃", "fr", "b"), (8, "1234 !!", "en", "a"),
            (None, None, None, None)]
    return make_docs(rows)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd documents with extra columns that bear names used inside or returned by the operators."""
    from pyspark.sql import functions as F
    names = ["shard", "slot", "record", "_row", "h", "n", "kept", "component_id", "g", "i", "start", "size", "target",
             "score", "held_out", "x", "digest", "sig", "uid", "base", "word", "tie", "copy", "epoch"]
    out = odd_docs
    for k, name in enumerate(names):
        out = out.withColumn(name, F.lit(f"{name}-{k}") if k % 2 else F.lit(datetime.date(2020, 1, 1)))
    return out
