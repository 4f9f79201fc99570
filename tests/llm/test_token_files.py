"""Token files: round trip against the public tokenizer, order, random access, lost attempts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pedalytics.llm import direct_codes, token_files
from pedalytics.llm.direct_codes import DirectCodes, encode, level_widths

BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(rows):
    """(doc_id, start, n_tokens, crc) in order; rows of one id by the ids of their text, as a set of possibilities."""
    return [(i, [*BPE.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def check(got, rows):
    want = plain(rows)
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    as_sets = sorted(((i is not None, i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert sorted(((r.doc_id is not None, r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == as_sets


def test_odd_documents(spark, odd_docs, clashing):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for df in (odd_docs, clashing):
        check(token_files.read_documents(spark, token_files.write_token_files(df, file_tokens=50)).collect(), rows)
    empty = token_files.read_documents(spark, token_files.write_token_files(odd_docs.limit(0)))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_special_token_and_one_hot_id(spark):
    rows = [(3, "a<|endoftext|>b")] + [(2, f"text {i % 4}") for i in range(200)] + [(1, "x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = token_files.write_token_files(df, file_tokens=40)
    check(token_files.read_documents(spark, folder).collect(), rows)
    index = token_files.token_index(spark, folder).orderBy("base").collect()
    assert len(index) > 5 and max(r.tokens for r in index) < 60


def test_random_access_to_every_token(spark, odd_docs):
    folder = token_files.write_token_files(odd_docs, file_tokens=2000)
    docs = sorted(token_files.read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in docs])
    places = spark.range(-3, len(every) + 3).withColumnRenamed("id", "position").repartition(3)
    got = {r.position: r.token for r in token_files.tokens_at(spark, folder, places).collect()}
    assert [got[i] for i in range(len(every))] == every.tolist()
    assert [got[i] for i in (-3, -2, -1, len(every), len(every) + 2)] == [None] * 5


def test_slices_of_a_level_begin_anywhere(monkeypatch):
    ids = np.random.default_rng(4).zipf(1.3, 5000).astype(np.uint64) % 50_257
    raw = encode(ids, np.array([0, 5000]), np.array([1]), np.array([True]))
    monkeypatch.setattr(direct_codes, "SLICE", 24)
    assert (DirectCodes(raw).all() == ids).all()
    assert encode(ids, np.array([0, 5000]), np.array([1]), np.array([True])) == raw


TEXTS = ["", " ", "a", "word, word. Word!", "line\nbreak", "two\n\nbreaks here", "end\n", "end \n ", "it's we'll I'm", "'s x",
         "a\nb\nc d", "x.\nY, z;\n w", "12 34,5 +1 (716) 555-8176", "ünïcode çé. naïve,\nß", "tab\there  double", "<|endoftext|>x",
         "a <|endoftext|> b", "日本語 テキスト。", "\U0001d51e\U0001d51f x", "é́ combining", "don't.\n'tis", "word…", "\u00a0nbsp x", "ʰx ª"]


@given(st.lists(st.one_of(st.sampled_from(TEXTS + [" ", "\n", ".", "'", "ab", "Z9"]), st.text(max_size=6)), max_size=8))
def test_word_encoder_gives_the_public_ids(pieces):
    text = "".join(pieces)
    coder = token_files.word_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), (("<|endoftext|>", 50256),))
    for t in (text, " ".join(pieces)):
        assert coder.ids(t).tolist() == BPE.encode(t, add_special_tokens=False).ids


def test_files_outside_the_index_are_not_read(spark, odd_docs):
    folder = token_files.write_token_files(odd_docs)
    before = token_files.read_documents(spark, folder).count()
    token_files.write_bytes(f"{folder}/part-0000000-00000-77-lost.dac", encode(
        np.array([1, 2, 0]), np.array([0, 3]), np.array([5]), np.array([True])))
    assert token_files.read_documents(spark, folder).count() == before


@pytest.mark.parametrize("ids", [[], [0], [5] * 700, list(range(3000)), [2**32 - 1, 0, 1, 65535, 65536] * 90,
                                 [0] * 5000 + [50_000] * 3], ids=["none", "one", "same", "range", "wide", "rare"])
def test_codes(ids):
    ids = np.array(ids, np.uint32)
    starts = np.array([0, len(ids) // 3, len(ids) // 3, len(ids)])
    raw = encode(ids, starts, np.array([4, 0, -6]), np.array([True, False, True]))
    codes = DirectCodes(raw, check=True)
    assert len(codes) == len(ids) and codes.documents == 3
    assert codes.keys.tolist() == [4, 0, -6] and codes.known.tolist() == [True, False, True]
    order = np.random.default_rng(1).permutation(len(ids))
    assert (codes.ids(order) == ids[order]).all()
    assert (codes.all() == ids).all()
    for k in range(3):
        assert (codes.document(k) == ids[starts[k]:starts[k + 1]]).all()
    with pytest.raises(IndexError):
        codes.ids(np.array([len(ids)]))


def test_widths_are_the_cheapest_and_damage_is_seen():
    ids = np.array([1] * 1000 + [70_000] * 2, np.uint32)
    assert level_widths(ids)[0] == 1 and sum(level_widths(ids)) == 17
    raw = bytearray(encode(ids, np.array([0, 1002]), np.array([1]), np.array([True])))
    raw[-20] ^= 1
    with pytest.raises(ValueError):
        DirectCodes(bytes(raw), check=True)
    with pytest.raises(ValueError):
        DirectCodes(b"x" * 100)
    assert bytes(raw[:8]) == direct_codes.MAGIC
