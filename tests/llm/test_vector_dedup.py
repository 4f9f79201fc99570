import numpy as np
import pytest

from pedalytics.llm import vector_dedup
from pedalytics.llm.vector_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, []).append(np.array(np.float32(v), float))
    flat = [(i, v) for i, own in good.items() for v in own]
    root = {i: i for i in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for a, (i, v) in enumerate(flat):
        n = 0
        for b, (j, w) in enumerate(flat):
            if a != b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
        links.append((i, n))
    out = [(i, n, find(i), find(i) == i) for i, n in links]
    left = list(rows)
    for i, v in flat:
        left.remove(next(r for r in left if r[0] == i and r[1] is not None and len(r[1]) == len(v)
                         and all(x is not None for x in r[1]) and np.allclose(np.float32(r[1]), v)))
    return sorted(out + [(i, 0, i, i is not None) for i, _ in left], key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        centre = rng.normal(size=20)
        for _ in range(rng.choice([1, 1, 3, 12])):
            rows.append((len(rows) + 5, (centre + rng.normal(size=20) * rng.choice([0, 0.05, 0.3])).tolist()))
    rng.shuffle(rows)
    return [(int(i), list(map(float, v))) for i, v in rows]


@pytest.mark.parametrize("tile_rows", [7, 40, 4096])
def test_against_brute_force(spark, vectors, tile_rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], SCHEMA)
    got = near_vectors(df, tile_rows=tile_rows, lead=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(vectors)


def test_dense_group(spark):
    """Every pair links: whole blocks are decided by one product."""
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(300)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), tile_rows=100, lead=2).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)}


def test_odd_vectors(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (2, e), (2, e), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]),
            (7, [float("inf"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [1.0, 0.0]), (10, [3e38, 0.0, 0.0]),
            (11, [1e-38, 0.0, 0.0]), (12, [0.0, 1.0, 0.0]), (13, [5.0, 0.0])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows] + [(None, e, 1)], SCHEMA)
    from pyspark.sql import functions as F
    for name in ("v", "c", "tile", "root", "class_id", "degree", "n_links", "a", "b"):
        df = df.withColumn(name, F.lit("x"))
    got = {}
    for r in near_vectors(df).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"], r["kept"]))
    assert got == {1: {(4, 1, True)}, 2: {(4, 1, False)}, 10: {(4, 1, False)}, 11: {(4, 1, False)},
                   9: {(1, 9, True)}, 13: {(1, 9, False)}, None: {(0, None, False)},
                   **{i: {(0, i, True)} for i in (3, 4, 5, 6, 7, 8, 12)}}


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_regions_hold_all_rows_and_far_ones_have_no_links():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6))
    x = vector_dedup._unit(centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.15, (1500, 6)))
    regions = vector_dedup.Regions(x[::5, :4], 40)
    leaf = regions.of(x)
    names, sizes = np.unique(leaf, return_counts=True)
    assert len(names) == 40 and sizes.max() < 150 and (regions.axis[names] < 0).all()
    low, high = (np.array([f(x[leaf == k], axis=0) for k in names]) for f in (np.min, np.max))
    near = vector_dedup._near_regions(low, high, 0.9)
    linked = {(leaf[i], leaf[j]) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True)}
    met = {(names[k], names[m]) for k, own in enumerate(near) for m in own}
    assert linked <= met and len(met) < 1000  # of 1600


def test_regions_of_few_or_equal_rows():
    assert vector_dedup.Regions(np.zeros((0, 3)), 5).of(np.ones((4, 3))).tolist() == [0] * 4
    assert vector_dedup.Regions(np.ones((9, 3)), 5).of(np.ones((4, 3))).tolist() == [0] * 4


def test_a_crowded_region_is_dealt_by_hash(spark):
    """A third of all rows stand at about one place, the others apart; brute force decides."""
    rng = np.random.default_rng(3)
    x = np.vstack([np.array([3.0, 1, 0, 0]) + rng.normal(0, 1e-5, (60, 4)), rng.normal(size=(120, 4))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile_rows=9, lead=2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate(links.tolist()))
