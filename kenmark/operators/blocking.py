"""Candidate devices for a set of queries, without comparing everything with everything.

Queries are (query_id, q); the store is (device_id, ts, h), one row per device. A pair that
shares several keys is formed on the first of them only, so no distinct is needed. A query
set of at most ``BROADCAST_QUERIES`` rows is broadcast and the store isn't shuffled; a
larger one is joined by shuffling both sides on the key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kenmark.functions.minhash import band_table, tokens
from kenmark.functions.registry import ScoringOptions
from kenmark.operators.nearest import nearest, plain
from kenmark.operators.scoring import features, score_pairs
from kenmark.plans.scratch import materialise

HARDWARE_KEYS = ["deviceMemory", "hardwareConcurrency", "platform"]
STRONG_KEYS = ["canvas", "webgl"]
BROADCAST_QUERIES = 2_000
STRATEGIES = ("none", "any_key", "all_keys", "lsh")


def _small(queries: DataFrame) -> DataFrame:
    """The queries, marked for broadcast if they are few enough."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


def _keys(fp: Column, names: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(fp[k].isNotNull(), F.struct(F.lit(i).alias("key"), fp[k].cast("string").alias("value"))) for i, k in enumerate(names))))


def _first_shared(names: list[str]) -> Column:
    """The number of the first key on which ``q`` and ``h`` agree."""
    shared = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(names))):
        shared = F.when(F.col("q")[k].cast("string") == F.col("h")[k].cast("string"), i).otherwise(shared)
    return shared


def any_key(queries: DataFrame, store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pairs that agree on at least one of the keys."""
    names = names or HARDWARE_KEYS
    asked = queries.withColumn("_k", F.explode(_keys(F.col("q"), names)))
    held = store.withColumn("_k", F.explode(_keys(F.col("h"), names)))
    return _small(asked).join(held, "_k").where(F.col("_k.key") == _first_shared(names)).drop("_k")


def all_keys(queries: DataFrame, store: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pairs that agree on every key that the query has; a query without keys has no pair."""
    names = names or HARDWARE_KEYS
    out = None
    for n in range(len(names), 0, -1):
        for own in combinations(names, n):
            mine = queries.where(" and ".join(f"q.{k} is {'not ' if k in own else ''}null" for k in names))
            meets = [F.col(f"q.{k}") == F.col(f"h.{k}") for k in own]
            part = _small(mine).join(store, meets)
            out = part if out is None else out.unionByName(part)
    return out


def every_device(queries: DataFrame, store: DataFrame) -> DataFrame:
    """A stated query set against the whole store, in one broadcast block per ``BROADCAST_QUERIES`` queries."""
    blocks = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // BROADCAST_QUERIES)))))
    numbers = [r["_b"] for r in blocks.select("_b").distinct().collect()]
    out = None
    for b in numbers:
        part = store.join(F.broadcast(blocks.where(F.col("_b") == b).drop("_b")), F.lit(True))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else queries.join(store, F.lit(False))


def shared_bands(queries: DataFrame, store: DataFrame, hashes: int = 128, bands: int = 16) -> DataFrame:
    """(query_id, device_id) of pairs that share a MinHash band over their set-valued members."""
    q = band_table(queries.select("query_id", tokens(F.col("q")).alias("_t")), "query_id", "_t", hashes, bands)
    h = band_table(store.select("device_id", tokens(F.col("h")).alias("_t")), "device_id", "_t", hashes, bands)
    return q.join(h, ["band", "bucket"]).select("query_id", "device_id").distinct()


def prefer_strong(pairs: DataFrame) -> DataFrame:
    """Of a query's pairs those that also agree on a rendering digest, if it has any; else all."""
    agrees = F.lit(False)
    for k in STRONG_KEYS:
        agrees = agrees | F.coalesce((F.col(f"q.{k}") != "") & (F.col(f"q.{k}") == F.col(f"h.{k}")), F.lit(False))
    marked = pairs.withColumn("_strong", agrees)
    best = marked.withColumn("_any", F.max("_strong").over(Window.partitionBy("query_id")))
    return best.where(F.col("_strong") | ~F.col("_any")).drop("_strong", "_any")


def block(queries: DataFrame, store: DataFrame, strategy: str) -> DataFrame:
    if strategy == "none":
        return every_device(queries, store)
    if strategy == "any_key":
        return prefer_strong(any_key(queries, store))
    if strategy == "all_keys":
        return all_keys(queries, store)
    if strategy == "lsh":
        return shared_bands(queries, store).join(queries, "query_id").join(store, "device_id")
    raise ValueError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")


def scored(pairs: DataFrame, options: ScoringOptions) -> DataFrame:
    """The pairs with their nine scores; features of pairs are computed with the pair."""
    return score_pairs(pairs, "q", "h", options)


def best_of_blocks(found: DataFrame, limit: int) -> DataFrame:
    """Of what ``nearest`` gives for blocks of the store the best ``limit`` devices of each query, with their place."""
    of = Window.partitionBy("query_id")
    preferred = found.withColumn("_any", F.max("strong").over(of)).where(F.col("strong") | ~F.col("_any")).drop("_any")
    return preferred.withColumn("place", F.row_number().over(of.orderBy(F.desc("confidence"), "device_id"))).where(F.col("place") <= limit)


def candidates(queries: DataFrame, store: DataFrame, strategy: str = "any_key", least: int = 30, limit: int = 20, options: ScoringOptions | None = None) -> DataFrame:
    """(query_id, device_id, confidence, last_seen, place): the best ``limit`` devices of each query, ties by device."""
    options = options or ScoringOptions()
    if strategy in ("none", "any_key") and plain(options):
        return best_of_blocks(nearest(queries, store, strategy == "any_key", least, limit), limit).select("query_id", "device_id", "confidence", "last_seen", "place")
    q = features(queries, "q", options, "_q")
    h = features(store, "h", options, "_h")
    # Pairs are written before they are scored. The scoring plan is then one projection over a
    # scan; above joins and filters the optimizer's constraint propagation takes minutes on it.
    met = materialise(block(q, h, strategy), "pairs")
    pairs = score_pairs(met, "q", "h", options, ("_q", "_h"))
    best = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "device_id")
    rated = pairs.select("query_id", "device_id", F.col("composite").alias("confidence"), F.col("ts").alias("last_seen"))
    # The score is filtered after the ranking: before it, the optimizer would push the filter
    # below the projections and repeat the whole scoring expression in it.
    return rated.withColumn("place", F.row_number().over(best)).where((F.col("place") <= limit) & (F.col("confidence") >= least))


def with_extra(found: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds the pairs that only the band index gave, with confidence 0."""
    more = extra.join(found, ["query_id", "device_id"], "left_anti")
    return found.select("query_id", "device_id", "confidence").unionByName(more.select("query_id", "device_id", F.lit(0).alias("confidence")))
