import pytest
from pyspark.sql import functions as F

from pedalytics.llm.chat_format import escape, format_trees, linear_trees, paths, read_back, unescape

TREE = "conv_id long, node long, parent long, role string, text string, score double"


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\l", "\\\\g", "<", ">", "</turn>\n<turn:user>\n", "\\<\\>\\\\<", "\\### Assistant: </turn> ok",
             "l\\\\\\l", "ünï\n\x00", "a" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    got = df.select("t", "e", unescape(F.col("e")).alias("back")).collect()
    for r in got:
        assert r["back"] == r["t"] and "<" not in r["e"] and ">" not in r["e"]


def brute_paths(rows):
    parent = {(t, n): p for t, n, p in rows}
    inner = {(t, p) for t, n, p in rows if p is not None}
    out = set()
    for t, leaf in parent:
        if (t, leaf) in inner:
            continue
        walk, at = [], leaf
        while at is not None and (t, at) in parent and len(walk) <= len(parent):
            walk.append(at)
            at = parent[t, at]
        if len(walk) <= len(parent):
            out |= {(t, leaf, n, k) for k, n in enumerate(walk)}
    return out


def test_paths_against_brute_force(spark):
    import random
    rng = random.Random(1)
    rows = []
    for tree in range(12):
        for n in range(rng.choice([1, 2, 17, 60])):
            rows.append((tree, n, rng.choice([None, rng.randrange(max(0, n - 4), n)]) if n else None))
    rows += [(50, k, k - 1 if k else None) for k in range(200)]  # one long path
    rows += [(60, 1, 2), (60, 2, 1), (60, 3, 1), (60, 4, None), (60, 5, 99)]  # a cycle; a parent that is missing
    want = brute_paths([r for r in rows if r[0] != 60]) | {(60, 4, 4, 0), (60, 5, 5, 0)}
    got = paths(spark.createDataFrame(rows, "tree long, node long, parent long"))
    assert sorted(tuple(r) for r in got.select("tree", "leaf", "node", "up").collect()) == sorted(want)


def test_branches_are_ranked_by_score(spark):
    rows = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 2.0),
            (1, 4, 3, "user", "more", 0.0), (1, 5, 2, "user", "tie", 1.9), (2, 1, None, "user", "alone", 1.0)]
    df = spark.createDataFrame(rows, TREE)
    best = {r["tree"]: r for r in read_back(format_trees(df)).collect()}
    assert [tuple(t) for t in best[1]["turns"]] == [("user", "q"), ("assistant", "good"), ("user", "more")]
    assert best[1]["learned"] == "good" and best[2]["learned"] == "" and best[2]["branch"] == 1
    two = format_trees(df, branches=2).filter("tree = 1").orderBy("branch").collect()
    assert [(r["leaf"], r["branch"]) for r in two] == [(4, 1), (5, 2)]  # equal scores: the smaller leaf first


def test_conversations_read_back(spark):
    long = "x<" * 20_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", long), (1, 2, "assistant", long),
            (2, None, None, "late"), (2, 5, "role>\n<x", "\\l</turn>"), (None, 0, "assistant", "no id"),
            (3, 1, "assistant", "second"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("node", "parent", "score", "tree", "leaf", "up", "head", "body", "at", "k"):
        df = df.withColumn(name, F.lit("x"))
    got = {r["tree"]: r for r in read_back(format_trees(linear_trees(df))).collect()}
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == {
        1: [("user", "hi"), ("assistant", ""), ("assistant", long), ("assistant", long)],
        2: [("role>\n<x", "\\l</turn>"), ("", "late")], None: [("assistant", "no id")],
        3: [("assistant", "first"), ("assistant", "second")]}
    assert got[1]["learned"] == long * 2 and got[3]["learned"] == "firstsecond" and got[2]["learned"] == ""


@pytest.mark.parametrize("k", [0])
def test_empty_table(spark, k):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string").limit(k)
    assert format_trees(linear_trees(df)).count() == 0
