import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pedalytics.llm.exact_dedup import drop_exact, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, own in groups.items():
        most = max(len(t) for _, t in own)
        keep = min((i for i, t in own if len(t) == most and i is not None), default=None)
        out += [(i, keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in own]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(make_docs):
    texts = ["a b", "ab", "a  b ", "\x1fab", "c", "c", "d e", "de", "", " ", None, "x" * 100_000, "x" * 100_000 + "\n"]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    assert rows_of(exact_groups(make_docs(rows))) == brute(rows)


def test_colliding_hashes_are_told_apart_by_their_bytes(make_docs):
    rows = [(i, f"t {i % 17}") for i in range(100)]
    got = exact_groups(make_docs(rows), digest=lambda c: F.substring(F.md5(c), 1, 1))
    assert rows_of(got) == brute(rows)


def test_odd_rows_and_clashing_names(clashing, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(exact_groups(clashing)) == brute(rows)
    kept = drop_exact(clashing)
    assert kept.columns == clashing.columns
    # the repeated row 1 stays once, 6 differs from it by case; of the blank texts the longest stays
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "7", "8", "None"]


def test_of_rows_with_one_id_the_longest_stays(make_docs):
    rows = [(1, "a b"), (1, "a  b  "), (1, "ab"), (2, "ab"), (None, "c d"), (None, "cd"), (3, "x  y"), (3, "x y "), (3, "z")]
    for parts in (1, 3, 7):
        kept = sorted((str(r["doc_id"]), r["text"]) for r in drop_exact(make_docs(rows, parts)).collect())
        assert [k for k in kept if k[0] != "3"] == [("1", "a  b  "), ("None", "c d")]
        ties = [t for i, t in kept if i == "3"]
        assert len(ties) == 2 and "z" in ties and ties == (first := ties if parts == 1 else first)


def test_empty_table(odd_docs):
    assert exact_groups(odd_docs.limit(0)).count() == 0
    assert drop_exact(odd_docs.limit(0)).count() == 0
