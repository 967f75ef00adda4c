"""Fuzzy digests by the published TLSH scheme, in Arrow-batched functions.

A window of five bytes slides over the text; six of its triplets are hashed, by Pearson
hashing with a salt each, into buckets, and a bucket's digest code is the quartile of its
count. The Pearson permutation is a parameter; the default one is drawn by a fixed rule,
so digests compare among themselves but not with digests made with another permutation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shorter texts have no digest; distances are taken as similarity on a scale of 300.
LEAST_LENGTH, MAX_DISTANCE = 512, 300
BUCKETS = 128
# Salt, and the window's bytes (0 the newest) of each triplet.
TRIPLETS = [(2, 0, 1, 2), (3, 0, 1, 3), (5, 0, 2, 3), (7, 0, 2, 4), (11, 0, 1, 4), (13, 0, 3, 4)]
# Up to this length, log base, offset of the length code.
LENGTH_SCALES = [(656, 1.5, 0.0), (3199, 1.3, 8.72777), (math.inf, 1.1, 62.5472)]


def permutation(seed: int = 1664525) -> list[int]:
    """A permutation of 0 to 255, by Fisher-Yates with a linear congruential generator."""
    out, state = list(range(256)), seed
    for i in range(255, 0, -1):
        state = (state * 1664525 + 1013904223) % 2**32
        j = (state >> 8) % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


PERMUTATION = permutation()


def length_code(n: int) -> int:
    base, offset = next((b, o) for most, b, o in LENGTH_SCALES if n <= most)
    return int(math.log(n) / math.log(base) - offset) & 0xFF


def tlsh_digest(text: str | None, table: Sequence[int] | None = None) -> str | None:
    """Hex digest, or None of a text that is too short or too uniform."""
    if text is None or len(text) < LEAST_LENGTH:
        return None
    p = np.array(PERMUTATION if table is None else table, np.uint8)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(data)
    byte = [data[4 - i : n - i] for i in range(5)]
    counts = np.zeros(256, np.int64)
    for salt, a, b, c in TRIPLETS:
        counts += np.bincount(p[p[p[p[salt] ^ byte[a]] ^ byte[b]] ^ byte[c]], minlength=256)
    counts = counts[:BUCKETS]
    if np.count_nonzero(counts) <= BUCKETS // 2:
        return None
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    if q3 == 0:
        return None
    check, steps, table_list = 0, p[p[p[0] ^ byte[0]] ^ byte[1]].tolist(), p.tolist()
    for step in steps:
        check = table_list[step ^ check]
    codes = (counts > q1).astype(int) + (counts > q2) + (counts > q3)
    body = np.sum(codes.reshape(-1, 4) << np.array([0, 2, 4, 6]), axis=1)
    head = [check, length_code(n), (q1 * 100 // q3 % 16) << 4 | q2 * 100 // q3 % 16]
    return bytes([*head, *body.tolist()]).hex()


def _circular(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    gap = np.abs(a - b)
    return np.minimum(gap, size - gap)


def tlsh_distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Distances of digests, pair by pair; a malformed digest raises ValueError."""
    width = 3 + BUCKETS // 4
    for x in (*a, *b):
        if len(x) != 2 * width:
            raise ValueError("not a digest")
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(-1, width).astype(int) for s in (a, b))
    length = _circular(x[:, 1], y[:, 1], 256)
    out = np.where(length <= 1, length, 12 * length) + (x[:, 0] != y[:, 0])
    for shift in (4, 0):
        gap = _circular(x[:, 2] >> shift & 15, y[:, 2] >> shift & 15, 16)
        out = out + np.where(gap <= 1, gap, 12 * (gap - 1))
    for shift in (0, 2, 4, 6):
        gap = np.abs((x[:, 3:] >> shift & 3) - (y[:, 3:] >> shift & 3))
        out = out + np.where(gap == 3, 6, gap).sum(axis=1)
    return out


@F.pandas_udf(T.StringType())
def digest_udf(text: pd.Series) -> pd.Series:
    return text.map(tlsh_digest)


@F.pandas_udf(T.IntegerType())
def distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype="Int32")
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        out[known] = tlsh_distances(a[known].tolist(), b[known].tolist())
    return out
