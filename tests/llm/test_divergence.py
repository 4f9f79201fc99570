"""Source divergence audit against a plain count."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pedalytics.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_df, smooth=5, top=50):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")])
            for text, lang, source in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        own = [(s, w) for g, s, w in docs if g == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= min_df]
        total = Counter(t for _, w in own for t in w)

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + smooth) // (n + smooth * len(kept)) for t in kept}
        q = shares(total)
        counts = {s: Counter(t for x, w in own if x == s for t in w) for s, _ in own}
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s],
                     "term": [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1)
                        if part == "pair" or k <= top]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


TEXTS = [("The cat, the DOG", "en", "a"), ("the bird's cat", "en", "b"), ("dog dog cat ünï", "en", "c"), (None, "en", "d"),
         ("the", None, None), ("the x", None, "a"), ("le chat", "fr", "a"), ("le chien", "fr", "a"), ("le", "fr", "ä"),
         ("", "de", "x"), ("123 !!", "de", "y"), ("the cat", "en", "a"), ("the cat", "en", "a"),
         ("a\x00b \U0001d51e \U0001d51e", "en", "b"), ("\U0001d51e", "en", "a"), ("word " * 20_000, "en", "long")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(parts)


def test_equals_plain_counts(spark):
    for min_df, top in ((1, 50), (2, 2), (3, 50), (99, 50)):
        got = told(divergence.audit_sources(frame(spark, TEXTS), min_df=min_df, top=top))
        assert got == plain(TEXTS, min_df, top=top), min_df


def test_slices_of_the_terms_and_blocks_of_sources_change_nothing(spark, monkeypatch):
    rows = [(f"w{'abcdefgh'[i % 8]} w{'abcde'[i % 5]} w{'xyz'[i % 3]}", "en", f"s{i % 11}") for i in range(90)]
    want = plain(rows, 2)
    df = frame(spark, rows)
    assert told(divergence.audit_sources(df, min_df=2)) == want
    monkeypatch.setattr(divergence, "_slices", lambda *_: 3)
    assert told(divergence.audit_sources(df, min_df=2)) == want


def test_blocks(spark):
    """Blocks of two sources, put together from the functions that tasks run."""
    import importlib
    module = importlib.import_module("pedalytics.llm.divergence")
    rows = [(f"t{'abcd'[i % 4]} t{'abcdefg'[i % 7]}", "en", f"s{i % 5}") for i in range(60)]
    docs = frame(spark, rows)
    counts, words = module.group_counts(docs, 2)
    groups = module._groups(docs, counts, words, 5)
    rows_p = counts.join(groups, ["lang", "source"]).select("number", "slot", "absent", module.share(
        F.col("c"), F.col("total"), F.col("size"), 5).alias("p")).toPandas()
    info = groups.toPandas().sort_values("number")
    want = {(s, o): v for _, s, part, o, v, _ in plain(rows, 2) if part == "pair"}
    size, names = module.SOURCE_BLOCK, dict(zip(info["number"], info["source"], strict=True))
    try:
        module.SOURCE_BLOCK = 2
        got: dict = {}
        for low in range(3):
            for high in range(low, 3):
                one = info.assign(own=info["number"] // 2)
                hist = rows_p.groupby("number")["p"].value_counts().reset_index(name="n")
                one["shares"] = [sorted(hist[hist["number"] == k]["p"]) for k in one["number"]]
                one["numbers"] = [[int(hist[(hist["number"] == k) & (hist["p"] == p)]["n"].iloc[0]) for p in sorted(
                    hist[hist["number"] == k]["p"])] for k in one["number"]]
                both = rows_p.assign(own=rows_p["number"] // 2)
                for part in (module._apart(("en", low, high), one), module._together(("en", low, high, 0), both)):
                    for r in part.itertuples():
                        got[r.a, r.b] = got.get((r.a, r.b), 0) + r.value
        assert {(names[a], names[b]): v for (a, b), v in got.items()} == {k: v for k, v in want.items() if k[0] < k[1]}
    finally:
        module.SOURCE_BLOCK = size


def test_odd_rows_and_empty_table(spark, odd_docs, clashing):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    want = plain(rows, 1)
    assert told(divergence.audit_sources(odd_docs, min_df=1)) == want
    assert told(divergence.audit_sources(clashing, min_df=1)) == want
    assert divergence.audit_sources(odd_docs.limit(0)).count() == 0


def test_sizes_of_dictionaries(spark):
    docs = frame(spark, [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "en", "a")] * 3)
    assert divergence._slices(docs, 3, 10**6) == 1
    assert divergence._slices(docs, 4, 1) == 1
    assert divergence._slices(docs, 3, 100) > 1


def test_runs_of_a_batch_hold_all_rows(monkeypatch):
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": "en"} for t in ["a b", None, "", "c" * 100, "d", "É f-g", "h"]])

    def found(*part):
        return [t for b, raw, offsets in divergence.runs(iter([batch]))
                for t in divergence.tagged_terms(b, raw, offsets, *part)[1].to_pylist()]
    whole = found()
    assert [w.split("\x00")[1] for w in whole] == ["a", "b", "c" * 100, "d", "É", "f", "g", "h"]
    assert sorted(t for k in range(5) for t in found(5, k)) == sorted(whole)
    monkeypatch.setattr(divergence, "RUN_BYTES", 4)
    assert len(list(divergence.runs(iter([batch])))) == 5 and found() == whole
    monkeypatch.setattr(divergence, "CACHE_BYTES", 2)
    assert found() == whole
    cut = [b for b, _, _ in divergence.runs(iter([batch]))]
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()


def test_terms_of_a_document_come_once(monkeypatch):
    texts = ["a b A b b", None, "", "b", "b a", "É é É", "c" * 30 + " c"]
    langs = ["en", "en", "de", "de", "en", "fr", ""]
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": g} for t, g in zip(texts, langs, strict=True)])
    for size in (divergence.CACHE_BYTES, 2):
        monkeypatch.setattr(divergence, "CACHE_BYTES", size)
        for part in ((1, 0), (3, 0), (3, 1), (3, 2)):
            (run, raw, offsets), = divergence.runs(iter([batch]))
            row, tagged = divergence.document_terms(run, raw, offsets, *part)
            all_rows, all_terms = divergence.tagged_terms(run, raw, offsets, *part)
            got = list(zip(row.tolist(), tagged.to_pylist(), strict=True))
            assert len(set(got)) == len(got) and row.tolist() == sorted(row)
            assert set(got) == set(zip(all_rows.tolist(), all_terms.to_pylist(), strict=True))


def test_sums_of_a_group_are_held_over_the_batches_of_a_task(monkeypatch):
    rows = [(f"t{'abcd'[i % 4]} t{'abcdefg'[i % 7]} ta", "en" if i % 5 else "", f"s{i % 3}") for i in range(60)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r, strict=True)) for r in rows[at:at + 7]])
               for at in range(0, 60, 7)]
    words = pa.array([f"{g}\x00t{c}" for g in ("en", "") for c in "abcdef"], pa.large_string())
    positions = np.arange(len(words)) * 10
    want = Counter()
    for text, lang, source in rows:
        for term in text.split():
            if f"{lang}\x00{term}" in words.to_pylist():
                want[lang, source, 10 * words.to_pylist().index(f"{lang}\x00{term}")] += 1

    monkeypatch.setattr(divergence, "BLOCK", 4)  # blocks of one group's slots travel as one row

    def packed():
        return list(divergence.group_cells(iter(batches), words))

    def added(parts):
        return sorted(((r["lang"], r["source"], r["pos"]), r["c"]) for b in divergence.added_cells(iter(parts), positions)
                      for r in b.to_pylist())
    monkeypatch.setattr(divergence, "RUN_BYTES", 30)
    once = packed()
    keys = [(r["lang"], r["source"], r["block"]) for b in once for r in b.to_pylist()]
    assert len(keys) == len(set(keys)) == len({(g, s, p // 40) for g, s, p in want})  # whatever the runs
    assert added(once) == sorted(want.items())
    monkeypatch.setattr(divergence, "HELD_CELLS", 8)
    monkeypatch.setattr(divergence, "SENT_CELLS", 3)
    often = packed()
    assert len(often) > len(once) and added(often) == sorted(want.items())
    assert added(divergence.group_cells(iter([]), words)) == [] == added([])


def test_sums_of_many_groups_in_one_task():
    batch = pa.RecordBatch.from_pylist([{"text": "a b a", "lang": "en", "source": f"s{i}"} for i in range(40)] * 2)
    parts = divergence.group_cells(iter([batch]), pa.array(["en\x00a", "en\x00b"], pa.large_string()))
    got = [tuple(r.values()) for b in divergence.added_cells(parts, np.array([1, 0])) for r in b.to_pylist()]
    assert sorted(got) == sorted(("en", f"s{i}", pos, c) for i in range(40) for pos, c in ((1, 4), (0, 2)))
