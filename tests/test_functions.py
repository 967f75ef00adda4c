import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions import similarity as sim
from kenmark.functions.minhash import band_table, seeds, token_hashes
from kenmark.functions.registry import Registry, ScoringOptions
from kenmark.functions.text import normalised, number_text
from kenmark.functions.tlsh import PERMUTATION, tlsh_digest, tlsh_distances


def positional(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1 - (abs(len(a) - len(b)) + sum(x != y for x, y in zip(a, b))) / max(len(a), len(b))


def test_positional_similarity(spark):
    rows = [("", ""), ("abc", ""), ("abc", "abd"), ("abc", "abcdef"), ("ÄÖ", "ÄU"), ("a b", "ab ")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", sim.positional_similarity(F.col("a"), F.col("b")).alias("s"))
    assert all(r.s == pytest.approx(positional(r.a, r.b)) for r in df.collect())


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    kind = T.ArrayType(T.StringType())
    assert one(sim.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")), kind)) == 0.5
    assert one(sim.jaccard(F.lit(None).cast(kind), F.array().cast(kind), kind)) == 1.0
    assert one(sim.numeric_proximity(F.lit(4.0), F.lit(8.0))) == 0.5
    assert one(sim.decay(F.lit(sim.DECAY_TAU_MS))) == pytest.approx(math.exp(-1))
    assert one(sim.decay(F.lit(-5))) == 1.0
    assert one(sim.subnet(F.lit("10.1.2.3"))) == "10.1.2" and one(sim.subnet(F.lit("10.1.2"))) is None
    assert one(sim.round_half_up(F.lit(2.5))) == 3
    assert one(normalised(F.lit(" \t Ab\n"))) == "ab"
    assert one(number_text(F.lit(" 8.00"))) == one(number_text(F.lit("8")))


def test_registry():
    r = Registry().with_weight("userAgent", 25).with_plugin("x", lambda a, b, p: F.lit(1.0), 3)
    assert ScoringOptions(registry=r).weight("userAgent") == 10 and ScoringOptions(registry=r).weight("x") == 3
    assert ScoringOptions(weights={"userAgent": 1}).weight("userAgent") == 1
    assert ScoringOptions(registry=r.without_comparator("x")).comparator("x") is None
    assert Registry().with_default_weight(-1).default_weight == 0
    with pytest.raises(TypeError):
        r.with_comparator("y", 3)
    with pytest.raises(ValueError):
        r.with_weight("y", -1)


def test_tlsh():
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 2000)))
    other = "".join(map(chr, rng.integers(97, 123, 2000)))
    assert sorted(PERMUTATION) == list(range(256))
    a, b, c = (tlsh_digest(t) for t in (text, text[:1000] + "x" + text[1000:], other))
    near, far, same = tlsh_distances([a, a, a], [b, c, a])
    assert same == 0 and near < far and near < 60
    assert tlsh_digest("short") is None and tlsh_digest("a" * 5000) is None and tlsh_digest(None) is None
    with pytest.raises(ValueError):
        tlsh_distances([a], ["zz"])


def naive_hash(token, seed):
    h = (seed * 0x9E3779B9 % 2**32) ^ 0x811C9DC5
    for c in token:
        h = (h ^ ord(c)) * 0x01000193 % 2**32
    h = (h ^ h >> 16) * 0x45D9F3B % 2**32
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def test_minhash(spark):
    of = seeds(16)
    assert token_hashes("f:Arial", of).tolist() == [naive_hash("f:Arial", int(s)) for s in of]
    rows = [(1, ["a", "b", "c"]), (2, ["c", "b", "a"]), (3, ["x", "y"]), (4, [])]
    got = band_table(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 32, 8).collect()
    bands = {i: {(r.band, r.bucket) for r in got if r.id == i} for i in (1, 2, 3, 4)}
    assert bands[1] == bands[2] and not bands[1] & bands[3] and not bands[4] and len(bands[1]) == 8
    with pytest.raises(ValueError):
        band_table(spark.createDataFrame(rows, "id long, t array<string>"), "id", "t", 10, 3)
