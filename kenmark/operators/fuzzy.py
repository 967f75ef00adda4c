"""Near-duplicates by TLSH digest: all pairs of records below a distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kenmark.functions.tlsh import BUCKETS, digest_udf, tlsh_distances
from kenmark.plans.scratch import materialise

#: Digests of one side of a tile, and of the matrix product within it.
ROWS_PER_TILE, ROWS_PER_PRODUCT = 4000, 1000
_COSTS = np.array([[6 if abs(i - j) == 3 else abs(i - j) for j in range(4)] for i in range(4)], np.float32)


def digest_pairs(digests: list[str], others: list[str] | None, below: int) -> Iterator[tuple[str, str, int]]:
    """Pairs of different digests nearer than ``below``; of one list with itself if there's no other.

    The distance of the bodies never exceeds the whole one. It is a sum over buckets of a cost
    of two codes, so one matrix product of coded digests gives it for all pairs exactly; those
    it leaves are measured.
    """
    right = digests if others is None else others

    def codes(chosen: list[str]) -> np.ndarray:
        body = np.frombuffer(bytes.fromhex("".join(chosen)), np.uint8).reshape(len(chosen), -1)[:, 3:]
        return np.stack([body >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(chosen), BUCKETS)

    one = np.eye(4, dtype=np.float32)
    for i in range(0, len(digests), ROWS_PER_PRODUCT):
        x = digests[i : i + ROWS_PER_PRODUCT]
        left = _COSTS[codes(x)].reshape(len(x), -1)
        for j in range(i if others is None else 0, len(right), ROWS_PER_PRODUCT):
            y = right[j : j + ROWS_PER_PRODUCT]
            a, b = np.nonzero(left @ one[codes(y)].reshape(len(y), -1).T < below)
            if others is None and i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                near = tlsh_distances([x[k] for k in a], [y[k] for k in b])
                yield from ((x[k], y[m], int(d)) for k, m, d in zip(a, b, near) if d < below)


def near_duplicates(records: DataFrame, key: str, text: Column, below: int = 50) -> DataFrame:
    """(a, b, distance): each pair of keys, in order, whose texts' digests are nearer than ``below``.

    Digests are compared once each, every tile of them with every other; records of equal
    digests share the comparisons of their class. Texts without a digest are near to none.
    """
    named = materialise(records.select(F.col(key).alias("id"), digest_udf(text).alias("digest")).where("digest is not null"), "digests")
    classes = named.select("digest").distinct()
    tiles = -(-classes.count() // ROWS_PER_TILE) or 1
    place = classes.withColumn("t", F.pmod(F.xxhash64("digest"), F.lit(tiles)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o")
    spread = place.select("digest", "t", other).select("digest", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).alias("right"))

    def compare(tile: pa.Table) -> pa.Table:
        digests, right = tile.column("digest").to_pylist(), tile.column("right").to_pylist()
        left, rest = ([d for d, r in zip(digests, right) if r is side] for side in (False, True))
        own = tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
        found = list(digest_pairs(left, None if own else rest, below))
        return pa.Table.from_pylist([{"x": x, "y": y, "distance": d} for x, y, d in found], pa.schema([("x", pa.string()), ("y", pa.string()), ("distance", pa.int32())]))

    near = spread.groupBy("i", "j").applyInArrow(compare, "x string, y string, distance int")
    left, right = (named.select(F.col("id").alias(i), F.col("digest").alias(d)) for i, d in (("p", "x"), ("q", "y")))
    between = near.join(left, "x").join(right, "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")
    within = left.join(right, F.col("x") == F.col("y")).where("p < q and 0 < " + str(int(below))).select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(0).alias("distance"))
    return between.unionByName(within)
