"""MinHash signatures and bands of set-valued members."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES, BANDS = 128, 16


def seeds(n: int) -> np.ndarray:
    """The first n values of a linear congruential generator that starts from its factor."""
    out, state = [], 1664525
    for _ in range(n):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append(state)
    return np.array(out, np.uint32)


def token_hashes(token: str, of: np.ndarray) -> np.ndarray:
    """FNV-1a over UTF-16 units from each seed, with a final mix; signed, as their order is."""
    with np.errstate(over="ignore"):
        h = of * np.uint32(0x9E3779B9) ^ np.uint32(0x811C9DC5)
        for unit in np.frombuffer(token.encode("utf-16-le", "surrogatepass"), np.uint16):
            h = (h ^ np.uint32(unit)) * np.uint32(0x01000193)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x45D9F3B)
        return (h ^ h >> np.uint32(16)).view(np.int32)


def tokens(fp: Column) -> Column:
    """Distinct non-empty strings of the set-valued members, each marked with its member.

    Plugins and MIME types are structs, of which only plain strings would count; so they
    add nothing.
    """
    marked = []
    for name, mark in (("fonts", "f:"), ("languages", "l:")):
        known = F.filter(F.coalesce(fp[name], F.array().cast("array<string>")), lambda x: x != "")
        marked.append(F.transform(known, lambda x: F.concat(F.lit(mark), x)))
    return F.array_distinct(F.concat(*marked))


def signature_udf(hashes: int) -> Callable[[Column], Column]:
    of = seeds(hashes)

    @F.pandas_udf("array<int>")
    def signature(lists: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def one(items: np.ndarray | None) -> list[int] | None:
            if items is None or not len(items):
                return None
            for x in items:
                if x not in known:
                    known[x] = token_hashes(x, of)
            return np.minimum.reduce([known[x] for x in items])

        return lists.map(one)

    return signature


def band_table(df: DataFrame, key: str, token_column: str, hashes: int = HASHES, bands: int = BANDS, bucket: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(key, band, bucket) of every record with tokens; ``bucket`` hashes the band's number and its part of the signature."""
    if hashes % bands:
        raise ValueError(f"{hashes} hashes can't be divided into {bands} bands")
    rows = hashes // bands
    signed = df.where(F.size(token_column) > 0).select(key, signature_udf(hashes)(F.col(token_column)).alias("_signature"))
    cut = F.array(*(F.struct(F.lit(b).alias("band"), bucket(F.lit(b), F.slice("_signature", b * rows + 1, rows)).alias("bucket")) for b in range(bands)))
    return signed.select(key, F.explode(cut).alias("_b")).select(key, "_b.band", "_b.bucket").distinct()
