"""Plain-Python models of Spark's xxhash64 and of the keyed permutation, for brute-force comparisons."""

import math
import struct

import xxhash


def spark_hash(*values, kinds):
    """Spark's xxhash64 of ``values``: kinds are i (int), l (long) and s (string); nulls are skipped."""
    h = 42
    for v, kind in zip(values, kinds, strict=True):
        if v is not None:
            raw = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
            h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >> 63 else h


def permuted(x, n, key, rounds=6):
    a = max(math.ceil(math.sqrt(n)), 1)
    b = max(math.ceil(n / a), 1)
    while True:
        left, right = divmod(x, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = (left + spark_hash(right, i, key, kinds="lil") % a) % a
            else:
                right = (right + spark_hash(left, i, key, kinds="lil") % b) % b
        x = left * b + right
        if x < n:
            return x
