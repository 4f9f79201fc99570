import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pedalytics.llm.packing import Encoder, added_tokens, balance, pack


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer_on_odd_spacing(reference):
    rng = random.Random(1)
    parts = ["a", "bé", " ", "  ", "\n", "\t", "'s", "1", "#", "\x1c", "　", "\x85", "<|endoftext|>", "字", "ﬁ", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    bpe = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert [bpe.ids(t).tolist() for t in texts] == reference(texts)


@pytest.fixture(scope="module")
def default():
    """The tokenizer at its default setting: added tokens in a text are one id each."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_equal_the_default_tokenizer(default):
    rng = random.Random(2)
    parts = ["a", "bé", " ", "  ", "\n", "'s", "1", "<|endoftext|>", "<|endoftext", "|>", "字", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    bpe = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    assert [bpe.ids(t).tolist() for t in texts] == default(texts)


def test_added_tokens_in_packed_documents(make_docs, default):
    assert default(["a<|endoftext|>b"]) == [[64, 50256, 65]]
    docs = make_docs([(1, "a<|endoftext|>b"), (2, "one two <|endoftext|>" * 300), (3, "no token here"),
                      (4, "<|endoftext|>"), (5, None)])
    check(pack(docs, with_ids=True).toPandas(), docs.collect(), default)


def test_balance_fills_and_levels():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 3000, 400)
    pieces = balance(lengths, 1024, 1 / 1024)
    seq = {}
    for d, start, n, s, offset in pieces:
        seq.setdefault(s, []).append((offset, n))
        assert n > 0 and start + n <= lengths[d]
    free = sum(1024 - sum(n for _, n in own) for own in seq.values())
    assert 0 <= free < 1024
    for own in seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024


def check(got, docs, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    for doc, own in got.groupby("doc_id"):
        ids = [*reference([texts[doc]])[0], 0]
        own = own.sort_values("start")
        assert (own["doc_tokens"] == len(ids)).all()
        at = 0
        for p in own.itertuples():
            assert p.start == at
            raw = np.array(ids[at:at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(raw) and (not hasattr(p, "ids") or bytes(p.ids) == raw)
            at += p.length
        assert at == len(ids)
    packed = got.sort_values(["sequence_id", "offset"])
    assert (packed["offset"] == packed.groupby("sequence_id")["length"].cumsum() - packed["length"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024


def test_pieces_cover_each_document(make_docs, reference):
    rng = random.Random(3)
    docs = make_docs([(i, " ".join(rng.choice(["red", "ouéth", "x1,", "\n\n"]) for _ in range(rng.randrange(900))))
                      for i in range(60)])
    got = pack(docs, group_bytes=20_000, with_ids=True).toPandas()
    assert got["doc_id"].nunique() == 60
    check(got, docs.collect(), reference)


def test_odd_rows_and_clashing_names(clashing, reference):
    named = clashing.filter("doc_id IS NOT NULL AND doc_id <> 1")
    got = pack(named).toPandas()
    assert set(got["doc_id"]) == {r["doc_id"] for r in named.select("doc_id").collect()}
    check(got, named.collect(), reference)
    everything = pack(clashing).toPandas()
    ends = everything[everything["start"] + everything["length"] == everything["doc_tokens"]]
    assert len(ends) == clashing.count()


def test_empty_table(odd_docs):
    assert pack(odd_docs.limit(0)).count() == 0
