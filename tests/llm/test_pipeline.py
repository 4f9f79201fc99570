"""The five stages: what each keeps, and the whole run on a small fixture."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from pedalytics.llm import registry
from pedalytics.llm.common import materialize

WORDS = ("alder birch cedar elm fir hazel larch maple oak pine rowan willow of the and by river stone field cloud "
         "morning evening").split()


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    rng = random.Random(4)
    rows, labels = [], []

    def add(text, good=True, source="a"):
        rows.append((len(rows), text, "en", source))
        labels.append((rows[-1][0], int(good), 0))
        return rows[-1][0]

    def prose(n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    clean = [add(prose(rng.randrange(60, 200)), source=rng.choice("abc")) for _ in range(150)]
    junk = [add(" ".join(w.upper() + "!!" for w in prose(40).split()), good=False) for _ in range(80)]
    exact = [add(rows[clean[k]][1].replace(" ", "  ")) for k in range(5)]
    near = []
    for k in range(5, 10):
        words = rows[clean[k]][1].split()
        words[3] = "changed"
        near.append(add(" ".join(words)))
    folder = tmp_path_factory.mktemp("pipeline")
    make_docs(rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), {r[0]: r[1] for r in rows}, clean, junk, exact, near


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_in_order(spark, corpus):
    folder, texts, clean, junk, exact, near = corpus
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stage = docs.columns, dict(P.STAGES)
    good = stage["quality"](spark, docs, folder)
    assert good.columns == columns and ids(good) == sorted([*clean, *exact, *near])
    once = stage["exact_dedup"](spark, good, folder)
    # of two spellings the longer one stays
    assert once.columns == columns and ids(once) == sorted([*clean[5:], *exact, *near])
    apart = stage["near_dedup"](spark, once, folder)
    assert apart.columns == columns and ids(apart) == sorted([*clean[5:], *exact])
    mixed = stage["mixing"](spark, apart, folder)
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(apart))
    size = sum(len(texts[i].split()) for i in ids(apart))
    taken = sum(len(r["text"].split()) for r in mixed.collect())
    assert abs(taken - 1.5 * size) < 64 * 3
    packed = stage["packing"](spark, mixed, folder).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert (packed["ids"].str.len() == 4 * packed["length"]).all()


def test_run_is_the_stages_result(spark, corpus):
    """Every document that should stay is in the result with the words the mix took, as the public tokenizer's ids."""
    folder, texts, clean, _, exact, _ = corpus
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in P.STAGES:
        before, docs = docs, materialize(stage(spark, docs, folder), f"test-{name}")
    mixed = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    stay = {*clean[5:], *exact}
    source = {i: s for i, _, s in mixed}
    size = {s: sum(len(texts[i].split()) for i in stay if source.get(i) == s) for s in "abc"}
    taken = {s: sum(len(t.split()) for _, t, x in mixed if x == s) for s in "abc"}
    assert {i for i, _, _ in mixed} <= stay
    for s, n in taken.items():  # each source twice at most, and whole where it is taken more than once
        assert n <= 2 * size[s] + 64
    # the first source of the largest weight reaches its cap: every document of it stands twice in full
    whole = Counter(i for i, t, s in mixed if s == "a" and t.split() == texts[i].split())
    assert abs(taken["a"] - 2 * size["a"]) <= 64 and len(whole) >= 0.95 * sum(s == "a" for s in source.values())
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*bpe.encode(t, add_special_tokens=False).ids, 0])) for i, t, _ in mixed)
    got: dict = {}
    for r in sorted(P.run(spark, folder).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids"]))
    pieces = Counter()
    for (i, n), own in got.items():
        if sum(k for _, k, _ in own) == n:  # one copy of this length: its pieces follow one another
            pieces[i, tuple(np.frombuffer(b"".join(x for _, _, x in own), "<u4").tolist())] += 1
        else:  # copies of one length: all their tokens, without order
            pieces[i, n, tuple(sorted(t for _, _, x in own for t in np.frombuffer(x, "<u4").tolist()))] += 1
    by_length: dict = {}
    for (i, tokens), c in want.items():
        by_length.setdefault((i, len(tokens)), []).extend([tokens] * c)
    expected = Counter()
    for (i, n), copies in by_length.items():
        if len(copies) == 1:
            expected[i, copies[0]] += 1
        else:
            expected[i, n, tuple(sorted(t for x in copies for t in x))] += 1
    assert pieces == expected


def test_empty_documents(spark, corpus, odd_docs, tmp_path):
    folder = str(tmp_path)
    odd_docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert P.run(spark, folder).count() == 0


def test_odd_documents_run_through(spark, corpus, odd_docs, tmp_path):
    folder = str(tmp_path)
    both = odd_docs.unionByName(spark.read.parquet(f"{corpus[0]}/documents.parquet"))
    both.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    assert P.run(spark, folder).count() > 0


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
