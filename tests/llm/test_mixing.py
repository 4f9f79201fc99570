import re
from fractions import Fraction

import pytest

from pedalytics.llm.mixing import alias_table, mix_spans, mixed_documents, source_targets, taken_words
from tests.llm.plain import permuted, spark_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_stop_at_twice_the_size_and_reshare():
    rows = source_targets({"b": 100, "a": 10, None: 1000, "c": 0})
    assert [r["source"] for r in rows] == ["a", "b", "c", None]
    assert [r["weight"] for r in rows] == [5, 2, 1, 5]
    assert [r["target"] for r in rows] == [20, 200, 0, Fraction(1665) - 220]
    assert sum(r["target"] for r in rows) == Fraction(3, 2) * 1110


def test_null_source_takes_its_weight():
    rows = source_targets({"x": 1000, None: 1000, "y": 1000})
    assert {r["source"]: float(r["target"]) for r in rows} == {"x": 2000, "y": 5000 / 3, None: 2500 / 3}


@pytest.fixture(scope="module")
def mixed(make_docs):
    rows = [(i, " ".join(f"w{i}-{k}" for k in range((i * 37) % 400)), "en", ["a", "b", "c", None][min(i % 9, 3)])
            for i in range(400)]
    df = make_docs(rows)
    return rows, df, taken_words(*mix_spans(df, block_words=16, shard_blocks=64)).toPandas()


def test_every_document_and_targets_met(mixed):
    rows, _, got = mixed
    assert sorted(got["doc_id"]) == list(range(400))
    assert (got["size"] == got["doc_id"].map(lambda i: len(WORD.findall(rows[i][1])))).all()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    for _, own in got.assign(source=got["doc_id"].map(lambda i: rows[i][3] or "~")).groupby("source"):
        assert (own["source_size"] == own["size"].sum()).all()
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 32


def test_reruns_agree(mixed):
    _, df, got = mixed
    again = taken_words(*mix_spans(df.repartition(7), block_words=16, shard_blocks=64)).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def test_a_block_is_taken_once_an_epoch(mixed):
    _, df, _ = mixed
    spans = mix_spans(df, block_words=16, shard_blocks=64)[1].toPandas()
    assert not spans.duplicated(["doc_id", "epoch", "first"]).any()
    slots = spans.groupby(["shard", "slot"])["length"].sum()
    assert slots.max() <= 16


def test_mixed_texts_are_the_taken_words(mixed):
    rows, df, got = mixed
    out = mixed_documents(df, block_words=16, shard_blocks=64)
    assert out.columns == df.columns
    seen = out.toPandas()
    assert (seen["n_chars"] == seen["text"].str.len()).all()
    words = seen.assign(n=seen["text"].map(lambda t: len(WORD.findall(t)))).groupby("doc_id")["n"].sum()
    want = got.set_index("doc_id")["taken"]
    assert (words.reindex(want.index, fill_value=0) == want).all()
    for r in seen.head(50).itertuples():
        own = WORD.findall(rows[r.doc_id][1])
        assert set(WORD.findall(r.text)) <= set(own)


def test_odd_rows_and_clashing_names(clashing):
    got = taken_words(*mix_spans(clashing)).toPandas()
    assert len(got) == clashing.count() and (got["taken"] <= 2 * got["size"]).all()
    assert abs(got["taken"].sum() - 1.5 * got["size"].sum()) <= 64 * 3
    assert mixed_documents(clashing).columns == clashing.columns
    assert mixed_documents(clashing).count() > 0


def test_empty_table_and_texts_without_words(odd_docs, make_docs):
    for df in (odd_docs.limit(0), make_docs([(1, ""), (2, None)])):
        got = taken_words(*mix_spans(df)).toPandas()
        assert len(got) == df.count() and not got["taken"].any()
        assert mixed_documents(df).count() == 0


def test_more_sources_than_are_broadcast(spark):
    """Every source is mixed, however many there are."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text",
                                        "concat('s', id) AS source")
    got = taken_words(*mix_spans(df)).toPandas()
    assert len(got) == 20_000 and (got["taken"] <= 2 * got["size"]).all()
    assert ((got["taken"] - got["target"]).abs() <= 64).all()
    assert abs(got["taken"].sum() - got["target"].sum()) <= 20_000


def test_alias_cells_hold_each_quota():
    for quotas in ([5], [0, 3], [1, 2, 3, 4, 90], [7] * 10, [1] * 99 + [10**12]):
        cells, total = alias_table(quotas), sum(quotas)
        mass = [0] * len(quotas)
        for cell in cells:
            mass[cell["j"]] += cell["below"]
            mass[cell["other"]] += total - cell["below"]
        assert mass == [q * len(quotas) for q in quotas]


def plain_mix(rows, block_words, shard_blocks, seed=29, buckets=1024):
    """The mix by loops: words taken per (doc_id, epoch, first)."""
    tie = {r[0]: spark_hash(r[0], r[1], r[3], kinds="lss") for r in rows}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    infos = source_targets(sizes)
    for r in infos:
        words, n = round(r["target"]), -(-r["size"] // block_words)
        epochs = words // r["size"] if r["size"] else 0
        r |= {"n": n, "epochs": epochs, "rest": words - epochs * r["size"], "slots": []}
        r["quota"] = epochs * n + -(-r["rest"] // block_words)
    total, extra = sum(r["quota"] for r in infos), []
    cells = alias_table([r["quota"] for r in infos])
    for k in range(total):
        cell = cells[spark_hash(k, seed, kinds="li") % len(cells)]
        i = cell["j"] if spark_hash(k, seed + 1, kinds="li") % total < cell["below"] else cell["other"]
        infos[i]["slots"].append(k)
    for r in infos:
        extra += r["slots"][r["quota"]:]
        r["slots"] = r["slots"][:r["quota"]]
    for r in infos:
        while len(r["slots"]) < r["quota"]:
            r["slots"].append(extra.pop(0))
    out = []
    for i, r in enumerate(infos):
        own = sorted((d[0] for d in rows if d[3] == r["source"]),
                     key=lambda d: (spark_hash(d, seed, kinds="li") % buckets, d, tie[d]))
        run = [(d, w) for d in own for w in range(size[d])]
        for k, slot in enumerate(r["slots"]):
            epoch = min(k // r["n"], r["epochs"])
            j = k - epoch * r["n"]
            words = block_words if epoch < r["epochs"] else min(block_words, r["rest"] - j * block_words)
            block = permuted(j, r["n"], spark_hash(seed, i, epoch, kinds="iil"))
            taken = {}
            for d, w in run[block * block_words:block * block_words + words]:
                taken.setdefault(d, []).append(w)
            out += [(d, slot // shard_blocks, slot % shard_blocks, epoch, w[0], len(w)) for d, w in taken.items()]
    return sorted(out)


def test_spans_against_plain_python(mixed):
    rows, df, _ = mixed
    spans = mix_spans(df, block_words=16, shard_blocks=64)[1].select(
        "doc_id", "shard", "slot", "epoch", "first", "length").collect()
    assert sorted(map(tuple, spans)) == plain_mix(rows, 16, 64)
