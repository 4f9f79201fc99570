"""Cost-balanced packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
KEEP_WORDS = 400_000  # encoded words a worker remembers before it starts afresh
_ENCODERS: dict[tuple[str, tuple], "Encoder"] = {}


class Encoder:
    """Byte-level BPE ids of whole texts, remembering the ids of words.

    A space between two characters that are no white space always begins a
    new pre-token, so a text's ids are those of its pieces at such spaces.
    Pieces next to other white space are encoded together.  ``added`` are the
    vocabulary's added tokens: a text is first cut at them.
    """

    def __init__(self, ranks_path: str, added: tuple[tuple[str, int], ...] = ()):
        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        self.words: dict[str, bytes | None] = {}
        self.added = {token: array("H", [i]).tobytes() for token, i in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None

    def raw(self, text: str) -> bytes:
        return array("H", self.bpe.encode_ordinary(text)).tobytes()

    def _learn(self, piece: str) -> None:
        if piece.isalpha():  # one pre-token
            ids = array("H", self.bpe._core_bpe.encode_single_piece((" " + piece).encode())).tobytes()
        else:
            apart = bool(piece) and not piece[0].isspace() and not piece[-1].isspace()
            ids = self.raw(" " + piece) if apart else None
        self.words[piece] = ids

    def ids(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.added):
            return np.frombuffer(self._plain(text), dtype="<u2")
        parts = self.cut.split(text)  # every second part is an added token
        return np.frombuffer(b"".join(self.added[part] if i % 2 else self._plain(part)
                                      for i, part in enumerate(parts)), dtype="<u2")

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if len(self.words) > KEEP_WORDS:
            self.words.clear()
        known = self.words
        for piece in rest:
            if piece not in known:
                self._learn(piece)
        found = list(map(known.__getitem__, rest))
        if None in found or (rest and (not first or first[-1].isspace())):
            return b"".join(self._joined([first, *rest], [None, *found]))
        return self.raw(first) + b"".join(found)

    def _joined(self, pieces: list[str], found: list[bytes | None]) -> Iterator[bytes]:
        """Ids of single pieces as remembered, and of pieces around other white space together."""
        start = 0
        for i in range(1, len(pieces) + 1):
            left, right = pieces[i - 1][-1:], pieces[i][:1] if i < len(pieces) else "x"
            if i == len(pieces) or (left and right and not left.isspace() and not right.isspace()):
                alone = found[start] if i == start + 1 else None
                yield self.raw((" " if start else "") + " ".join(pieces[start:i])) if alone is None else alone
                start = i


def encoder(ranks_path: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    if (ranks_path, added) not in _ENCODERS:
        _ENCODERS[ranks_path, added] = Encoder(ranks_path, added)
    return _ENCODERS[ranks_path, added]


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """Texts and ids of the added tokens in a tokenizer's json."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for t in found:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} is not matched as it stands")
    return tuple((t["content"], t["id"]) for t in found)


def balance(lengths: np.ndarray, capacity: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of the given token counts: (document, start, length, sequence, offset) per piece.

    Whole runs of ``capacity`` tokens become sequences of their own.  What is
    left of each document goes, dearest first (cost n + quadratic * n * n), to
    the cheapest sequence with room; where none has room it is cut and fills
    the free places, cheapest sequence first.  At most one sequence's worth
    of places stays free.
    """
    pieces, seq = [], 0
    tails = []
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((d, start, capacity, seq, 0))
            seq += 1
        if n % capacity:
            tails.append((n % capacity, d))
    tails.sort(key=lambda t: (-t[0], t[1]))
    count = math.ceil(sum(n for n, _ in tails) / capacity)
    free, cost = np.full(count, capacity), np.zeros(count)
    for n, d in tails:
        start = int(lengths[d]) - n
        fits = np.flatnonzero(free >= n)
        todo = n
        while todo:
            if not len(fits):
                fits = np.flatnonzero(free)
            s = int(fits[np.argmin(cost[fits])])
            take = min(todo, int(free[s]))
            pieces.append((d, start, take, seq + s, capacity - int(free[s])))
            free[s] -= take
            cost[s] += take + quadratic * take * take
            start, todo, fits = start + take, todo - take, fits[:0]
    return pieces


def pack(df: DataFrame, ranks_path: str | None = None, capacity: int = 1024, quadratic: float = 1 / 1024,
         group_bytes: int = 2 << 20, with_ids: bool = False, id_col: str = "doc_id",
         text_col: str = "text", json_path: str | None = None) -> DataFrame:
    """Pack all documents (null text: empty) into sequences of at most ``capacity`` tokens.

    A document's tokens are the BPE ids of its text and then id 0.  The added
    tokens of ``json_path`` (without ``ranks_path``: of the public vocabulary)
    that stand in a text are one id each.  Documents
    are dealt by a hash of id and text into groups of about ``group_bytes`` of
    text (their number follows from the bytes of all texts); a group is read,
    encoded and packed by one call, so a call's memory is bounded by the group
    and its longest document.  Sequence numbers are unique over all groups.

    Returns per piece ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, if asked for, ``ids`` (little-endian unsigned
    32-bit).  Null ids and repeated rows are packed as documents of their own;
    an empty table gives an empty result.
    """
    if ranks_path is None:
        import public_tokenizers
        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    added = added_tokens(json_path) if json_path else ()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text") + F.lit(1).cast("long"))).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    dealt = src.withColumn("g", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(groups)))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long" + (", ids binary" if with_ids else ""))

    def pack_group(key, rows):
        bpe, g = encoder(ranks_path, added), int(key[0])
        rows = rows.sort_values(["doc_id", "text"], ignore_index=True)
        ids = [np.append(bpe.ids(t).astype("<u4"), np.uint32(END_ID)) for t in rows.pop("text")]
        doc_id = rows["doc_id"].astype("Int64")
        lengths = np.array([len(x) for x in ids])
        pieces = balance(lengths, capacity, quadratic)
        d = [p[0] for p in pieces]
        raw = [ids[i][start:start + n].tobytes() for i, start, n, _, _ in pieces]
        out = pd.DataFrame({
            "doc_id": doc_id.take(d).array, "start": [p[1] for p in pieces], "length": [p[2] for p in pieces],
            "ids_crc32": [zlib.crc32(x) for x in raw], "doc_tokens": lengths[d],
            "sequence_id": [p[3] * groups + g for p in pieces], "offset": [p[4] for p in pieces]})
        return out.assign(ids=raw) if with_ids else out

    return dealt.groupBy("g").applyInPandas(pack_group, schema)
