import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pedalytics.llm.quality import FEATURES, document_statistics, fit, keep_quality, score_quality, statistics
from pedalytics.llm.textnum import Words, slices


@pytest.fixture(scope="module")
def labelled(make_docs, spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["alder", "birch", "cedar", "of", "the", "elm", "oak"]) for _ in range(rng.randrange(5, 200))]
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words) + "."
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_words_against_plain_python():
    texts = ["", " a  bc\n", None, "Él y\tÉL x\x0b\x0cz\r", "\x1cno-break\x1d here", "a" * 300_000, "  "] * 3
    got = []
    for _, _, raw, offsets in slices(pa.array(texts)):
        w = Words(raw, offsets)
        low = w.bytes.tobytes()
        words = [low[a:b] for a, b in zip(w.start, w.stop, strict=True)]
        got += [words[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert len(set(words)) == len(set(w.hash.tolist()))
    assert got == [(t or "").encode().lower().split() for t in texts]


def test_statistics_of_one_text():
    text = "Aa BB!! c1\nAa BB!! c1"
    raw = np.frombuffer(text.encode(), np.uint8)
    x = dict(zip(FEATURES, statistics(raw, np.array([0, len(raw)]))[0], strict=True))

    def odds(part, whole):
        return math.log((part + 0.5) / (whole - part + 0.5))

    assert x["bytes"] == pytest.approx(math.log1p(len(raw))) and x["words"] == pytest.approx(math.log1p(6))
    assert x["upper"] == pytest.approx(odds(6, 21)) and x["shouts"] == pytest.approx(odds(4, 21))
    assert x["fresh_words"] == pytest.approx(odds(3, 6)) and x["fresh_lines"] == pytest.approx(odds(1, 2))
    assert x["fresh_pairs"] == pytest.approx(odds(3, 5)) and x["top_word"] == pytest.approx(odds(2, 6))


def test_held_out_rows_are_told_apart(labelled):
    docs, labels = labelled
    got = score_quality(docs, labels).toPandas()
    good = got["doc_id"] % 3 != 0
    assert len(got) == 600 and got["score"].between(0, 1).all()
    held = got["held_out"]
    assert 50 < held.sum() < 250
    assert ((got["score"] >= 0.5) == good)[held].mean() > 0.98


def test_density_difference_equals_the_plain_formula(labelled):
    docs, labels = labelled
    stats = document_statistics(docs)
    model = fit(stats, labels)
    x = np.array(stats.limit(5).toPandas()["x"].tolist())
    for row, q in zip(x, model.difference(x), strict=True):
        logs = []
        for c in (0, 1):
            cov = np.linalg.inv(model.whiten[c].T @ model.whiten[c])
            d = row - model.mean[c]
            logs.append(-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d))
        assert q == pytest.approx(logs[1] - logs[0], rel=1e-6, abs=1e-6)


def test_labels_of_held_out_rows_are_not_used(labelled, spark):
    from pyspark.sql import functions as F

    from pedalytics.llm.common import learned_rows
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(learned_rows(F.col("doc_id"), 4), F.col("quality"))
                                .otherwise(1 - F.col("quality")).cast("int"))
    a, b = (score_quality(docs, x).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (labels, flipped))
    assert np.allclose(a, b)


def test_odd_rows_and_clashing_names(clashing, labelled):
    _, labels = labelled
    got = score_quality(clashing, labels).toPandas()
    assert len(got) == clashing.count() and got["score"].between(0, 1).all()
    kept = keep_quality(clashing, labels, least=0.0)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert keep_quality(clashing, labels, least=1.1).count() == 0


def test_no_rows_or_no_labels(odd_docs, labelled, spark):
    docs, labels = labelled
    assert score_quality(odd_docs.limit(0), labels).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(odd_docs, none).toPandas()
    assert len(got) == odd_docs.count() and (got["score"] == 0.5).all()
    one = labels.filter("quality = 1")
    assert score_quality(docs, one).toPandas()["score"].min() > 0.9
