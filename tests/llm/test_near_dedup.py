import random
from fractions import Fraction

import numpy as np
import pytest

from pedalytics.llm.components import components
from pedalytics.llm.near_dedup import drop_near, matches_needed, near_groups, signature


def brute(rows, words, threshold):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        whole = [tuple(w)] if w else []
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else set(whole)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if j < i and common and common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    """Chains of edited copies, exact copies, short texts and unrelated texts."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 8, 20])):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
    rows += [(len(rows) + k, t) for k, t in enumerate(
        ["one", "ONE", "one two", "two one", "", None, " \n", "one two three", "One two THREE", "é É"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "threshold"), [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_against_brute_force(make_docs, corpus, words, threshold):
    got = near_groups(make_docs(corpus), words=words, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(corpus, words, threshold)


def test_stray_members_meet_the_rest_of_a_bucket(spark, make_docs):
    """The bucket's smallest id links with nothing, yet the others' links are found."""
    rng = random.Random(8)
    text = [f"w{k}" for k in range(200)]
    far = text[:130] + [f"z{k}" for k in range(70)]
    rows = [(0, " ".join(far))]
    for i in range(1, 40):
        own = list(text)
        own[rng.randrange(130, 200)] = f"q{i}"
        rows.append((i, " ".join(own)))
    got = near_groups(make_docs(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: v[1] for i, v in brute(rows, 5, Fraction(4, 5)).items()}


def test_rows_of_one_id_and_rows_without_an_id(make_docs):
    """A row's links follow from its own text, whatever other row bears its id."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, c), (None, c + " z"), (None, d), (None, d), (2, b), (5, "")]
    for _ in range(2):
        got = near_groups(make_docs(rows)).collect()
        assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([
            ("1", "1", True), ("2", "1", False), ("2", "2", True), ("2", "2", True), ("3", "2", False), ("4", "4", True),
            ("None", "4", False), ("None", "None", False), ("None", "None", False), ("5", "5", True)])
        rows = rows[::-1]


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_bounds_keep_pairs_at_the_threshold():
    needed = matches_needed(Fraction(4, 5), 1e-4)
    rng = np.random.default_rng(2)
    hits = (rng.random((100_000, 120)) < 0.8).cumsum(1)[:, 19::20]
    assert (hits < needed).any(1).mean() < 2e-3
    low = (rng.random((10_000, 120)) < 0.5).cumsum(1)[:, 19::20]
    assert (low < needed).any(1).mean() > 0.999


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    b = np.concatenate([a[:4500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    assert abs((signature(a) == signature(b)).mean() - 4500 / 5500) < 0.12


def test_odd_rows_and_clashing_names(clashing):
    got = near_groups(clashing).collect()
    assert len(got) == clashing.count()
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by[(1, 1)] == (1, True) and by[(6, 1)] == (1, False)  # same words, other case and spaces
    assert by[(2, 0)] == (2, True) and by[(4, 0)] == (4, True)  # nothing to compare
    assert all(not kept for (i, _), (_, kept) in by.items() if i is None)
    kept = drop_near(clashing)
    assert kept.columns == clashing.columns
    # the repeated row 1 and its copy 6 are one group, whatever their ids
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]


def test_rows_are_documents_whatever_their_ids(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " x"), (2, b), (3, c), (None, b + " y"), (None, c), (None, "all alone here"), (7, "all alone here")]
    kept = drop_near(make_docs(rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("1", a), ("2", b), ("3", c), ("7", "all alone here")])


def test_empty_table(odd_docs):
    assert near_groups(odd_docs.limit(0)).count() == 0
    assert drop_near(odd_docs.limit(0)).count() == 0
