"""Directly addressable codes: ids in levels of chunks, with continuation bitmaps and rank directories.

The lowest bits of every id stand in level 0.  A bitmap says which ids go on;
their next bits stand in level 1, in the same order, and so on.  A directory
holds the number of set bits before each block of a bitmap, so the place of
an id in the next level is one directory entry and at most four words away.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"DACIDS1\n"
BLOCK_WORDS = 4                  # words of 64 bits per directory entry
SPARE = 8                        # bytes after packed chunks, so that a window never leaves them
SLICE = 1 << 18                  # values packed or read at a time


def level_widths(ids: np.ndarray) -> list[int]:
    """Bits per level for the least total size, counting a continuation bit for all but the last level."""
    longest = max(int(ids.max(initial=0)).bit_length(), 1)
    ordered = np.sort(ids)
    needs = len(ids) - np.searchsorted(ordered, np.concatenate([[0], 2 ** np.arange(1, longest + 1)]))
    best: list[tuple[float, int]] = [(0.0, 0)] * (longest + 1)
    for s in range(longest - 1, -1, -1):
        best[s] = min((float(needs[s]) * (t - s + (1.125 if t < longest else 0)) + best[t][0], t)
                      for t in range(s + 1, longest + 1))
    out, s = [], 0
    while s < longest:
        out.append(best[s][1] - s)
        s = best[s][1]
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits one after another; eight of them fill exactly ``width`` bytes."""
    parts = []
    for at in range(0, len(values), SLICE):
        part = values[at:at + SLICE].astype(np.uint64)
        eight = np.concatenate([part, np.zeros(-len(part) % 8, np.uint64)]).reshape(-1, 8)
        out = np.zeros((len(eight), width + SPARE), np.uint8)
        for j in range(8):
            byte, bit = divmod(j * width, 8)
            window = eight[:, j] << np.uint64(bit)
            for k in range((width + bit + 7) // 8):
                out[:, byte + k] |= (window >> np.uint64(8 * k)).astype(np.uint8)
        parts.append(out[:, :width].tobytes())
    return b"".join(parts) + bytes(SPARE)


def _unpack(data: np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    """Values ``start`` (a multiple of eight) to ``stop`` of packed data."""
    groups = -(-(stop - start) // 8)
    first = start // 8 * width
    rows = np.lib.stride_tricks.as_strided(data[first:], (groups, width + SPARE), (width, 1), writeable=False)
    out = np.empty((groups, 8), np.uint32)
    for j in range(8):
        byte, bit = divmod(j * width, 8)
        window = rows[:, byte].astype(np.uint64)
        for k in range(1, (width + bit + 7) // 8):
            window |= rows[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (window >> np.uint64(bit)) & np.uint64((1 << width) - 1)
    return out.ravel()[:stop - start]


def _bitmap(marks: np.ndarray) -> np.ndarray:
    words = -(-(len(marks) + 1) // 64)
    words += -words % BLOCK_WORDS
    full = np.zeros(words * 64, np.uint8)
    full[:len(marks)] = marks
    return np.packbits(full, bitorder="little").view("<u8")


def encode(ids: np.ndarray, starts: np.ndarray, keys: np.ndarray, known: np.ndarray) -> bytes:
    """A file of ids and its directory of documents.

    ``starts``: first id of each document and the end; ``keys``: document ids
    (where ``known``).  Sections are eight-byte aligned; the header holds the
    place and length of each and a checksum of all that follows it.
    """
    rest = ids.astype(np.uint32)
    widths = level_widths(rest)
    sections = [keys.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for k, width in enumerate(widths):
        sections.append(_pack(rest & np.uint32((1 << width) - 1), width))
        if k + 1 < len(widths):
            rest = rest >> np.uint32(width)
            goes_on = rest != 0
            words = _bitmap(goes_on)
            blocks = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.uint64)
            sections += [words.tobytes(), np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u8").tobytes()]
            rest = rest[goes_on]
    head = 8 * (5 + len(widths) + 2 * len(sections))
    places, body, at = [], [], head
    for s in sections:
        places += [at, len(s)]
        padded = s + bytes(-len(s) % 8)
        body.append(padded)
        at += len(padded)
    raw = b"".join(body)
    fields = [len(keys), len(ids), len(widths), zlib.crc32(raw), *widths, *places]
    return MAGIC + np.array(fields, "<u8").tobytes() + raw


class DirectCodes:
    """Random access to the ids of an encoded file; nothing is decoded but what is asked for."""

    def __init__(self, data, check: bool = False):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("no file of directly addressable codes")
        field = np.frombuffer(data, "<u8", 4, 8).tolist()
        self.documents, self.length, levels, crc = field
        rest = np.frombuffer(data, "<u8", levels + 2 * (3 * levels + 1), 40).tolist()
        self.widths, places = rest[:levels], rest[levels:]
        if check and zlib.crc32(memoryview(data)[places[0]:]) != crc:
            raise ValueError("checksum of a file of directly addressable codes does not fit")

        def section(k: int, dtype: str) -> np.ndarray:
            at, size = places[2 * k:2 * k + 2]
            return np.frombuffer(data, dtype, size // np.dtype(dtype).itemsize, at)

        self.keys, self.known, self.starts = section(0, "<i8"), section(1, "u1").astype(bool), section(2, "<u8")
        self.chunks = [section(3 + 3 * k, "u1") for k in range(levels)]
        self.words = [section(4 + 3 * k, "<u8") for k in range(levels - 1)]
        self.before = [section(5 + 3 * k, "<u8") for k in range(levels - 1)]

    def __len__(self) -> int:
        return self.length

    def _chunk(self, level: int, at: np.ndarray) -> np.ndarray:
        width, data = self.widths[level], self.chunks[level]
        bit = at * width
        byte = bit >> 3
        window = data[byte].astype(np.uint64)
        for k in range(1, (width + 14) // 8):
            window |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (window >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place of a level's bitmap."""
        words, word = self.words[level], at >> 6
        block = word // BLOCK_WORDS
        count = self.before[level][block].astype(np.int64)
        for k in range(BLOCK_WORDS - 1):
            i = block * BLOCK_WORDS + k
            count += np.where(i < word, np.bitwise_count(words[i]), 0)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return count + np.bitwise_count(words[word] & below)

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places (any order, repeats allowed)."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.length):
            raise IndexError("no such token")
        out, open_, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for level, width in enumerate(self.widths):
            out[open_] |= (self._chunk(level, at) << np.uint64(shift)).astype(np.uint32)
            if level + 1 == len(self.widths):
                break
            goes_on = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            open_, at = open_[goes_on], self._rank(level, at[goes_on])
            shift += width
        return out

    def all(self) -> np.ndarray:
        """All ids in order; no rank is needed, each level is read once from its start."""
        out = np.zeros(self.length, np.uint32)
        taken = [0] * len(self.widths)
        for at in range(0, self.length, SLICE):
            count, shift = min(SLICE, self.length - at), 0
            open_ = slice(at, at + count)
            for level, width in enumerate(self.widths):
                begin = taken[level]
                low = begin // 8 * 8
                values = _unpack(self.chunks[level], low, begin + count, width)[begin - low:]
                out[open_] |= values << np.uint32(shift)
                taken[level] += count
                if level + 1 == len(self.widths):
                    break
                marks = np.unpackbits(self.words[level].view(np.uint8)[begin // 8:(begin + count + 7) // 8], bitorder="little")
                goes_on = np.flatnonzero(marks[begin % 8:begin % 8 + count])
                open_ = goes_on + at if isinstance(open_, slice) else open_[goes_on]
                count, shift = len(goes_on), shift + width
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(np.arange(int(self.starts[k]), int(self.starts[k + 1])))
