import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pedalytics.llm.language_id import Identifier, KneserNey, grams, identify

WORDS = {"aa": "lorem ipsum dolor sit amet elit", "bb": "über straße größe schön müde", "cc": "κόσμος λόγος φως νερό"}


@pytest.fixture(scope="module")
def docs(make_docs):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 40))), lang))
    return make_docs(rows)


def packed(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return grams(raw, np.array([0, len(raw)]))[0]


def test_grams_join_runs_of_other_characters():
    want = packed("é-..1 Ab")
    assert want.tolist() == packed("É ab").tolist() and len(want) == 4
    key = 0
    for c in "  é ":
        key = key << 16 | ord(c)
    assert int(want[1]) == key
    assert len(packed("12 !? ")) == 0


def plain_kneser_ney(text, order=4):
    """The interpolated estimate written out with dictionaries."""
    line = " " * (order - 1) + text
    counts = {order: Counter(line[i - order + 1:i + 1] for i in range(order - 1, len(line)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * p(gram[1:])

    return p


def test_model_equals_the_plain_formula():
    text = "the cat sat on the mat and then the hat sat on that cat"
    keys, counts = np.unique(packed(text), return_counts=True)
    model, p = KneserNey.fit(keys, counts.astype(float)), plain_kneser_ney(text)
    probe = "   the zebra sat"
    got = model.log_probability(packed(probe.strip()))
    want = [math.log(p(probe[i - 3:i + 1])) for i in range(3, len(probe))]
    assert np.allclose(got, want)


def test_probabilities_sum_to_one():
    text = "banana bandana"
    keys, counts = np.unique(packed(text), return_counts=True)
    model = KneserNey.fit(keys, counts.astype(float))
    for context in ("ana", "zzz", "   "):
        probes = np.array([(ord(context[0]) << 48) | (ord(context[1]) << 32) | (ord(context[2]) << 16) | ord(c)
                           for c in sorted(set(text) | {"\u4e00"})], np.uint64)
        assert np.exp(model.log_probability(probes)).sum() == pytest.approx(1)


def test_held_out_accuracy(docs):
    got = identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 300 and got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert 30 < len(held) < 150 and (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_answers_do_not_see_the_lang_column(docs):
    from pyspark.sql import functions as F

    from pedalytics.llm.common import learned_rows
    hidden = docs.withColumn("lang", F.when(learned_rows(F.col("doc_id"), 4), F.col("lang")).otherwise("zz"))
    a, b = (identify(d).toPandas().sort_values("doc_id") for d in (docs, hidden))
    assert (a["lang_pred"].tolist(), a["score"].tolist()) == (b["lang_pred"].tolist(), b["score"].tolist())


def test_strange_text_is_rejected(docs, make_docs):
    strange = make_docs([(1000 + i, "qxz jjkw vvpq xxzz qqk wwj", None) for i in range(8)])
    got = identify(docs.unionByName(strange)).filter("doc_id >= 1000").toPandas()
    assert got["rejected"].all() and set(got["lang_pred"]) <= set(WORDS)


def test_odd_rows_and_clashing_names(clashing):
    got = identify(clashing).toPandas()
    assert len(got) == clashing.count()
    texts = defaultdict(list)
    for r in clashing.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(any(c.isalpha() for c in r["text"] or ""))
    for i, own in got.groupby("doc_id"):
        assert (own["lang_pred"] == "und").sum() == texts[int(i)].count(False)
    assert (got.loc[got["lang_pred"] == "und", "score"] == 0).all()


def test_no_rows_and_nothing_to_learn(odd_docs, make_docs):
    assert identify(odd_docs.limit(0)).count() == 0
    got = identify(make_docs([(1, "words", None), (2, None, None)])).toPandas()
    assert got["lang_pred"].tolist() == ["und", "und"] and (got["score"] == 0).all()
    assert Identifier([], []).entropies(np.zeros(0, np.uint8), np.array([0, 0]))[0].shape == (1, 0)
