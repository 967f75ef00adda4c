"""Identification: find the device of each query, or name a new one.

All queries are scored against the store as it is; queries of a batch don't see each other
(``DeviceManager.identify_in_order`` is the way in which they do). New ids derive from the
query id, so that a repeated batch gives the same ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kenmark.functions.registry import ScoringOptions
from kenmark.functions.similarity import age_ms
from kenmark.operators.blocking import best_of_blocks, candidates, shared_bands, with_extra
from kenmark.operators.drift import field_stability, stability_map
from kenmark.operators.nearest import nearest, plain
from kenmark.operators.scoring import score_pairs
from kenmark.operators.store import latest
from kenmark.plans.scratch import materialise


@dataclass(frozen=True)
class IdentifyOptions:
    match_threshold: int = 50
    candidate_least: int = 30
    candidate_limit: int = 100
    stability_window: int = 5
    dedup_ms: int = 5000
    strategy: str = "any_key"
    use_lsh: bool = False
    scoring: ScoringOptions = ScoringOptions()


def queries_of(incoming: DataFrame) -> DataFrame:
    """(query_id, ts, q) of rows of a snapshots table."""
    return incoming.select(F.col("snapshot_id").alias("query_id"), F.col("ts").alias("query_ts"), F.col("fingerprint").alias("q"))


def store_of(snapshots: DataFrame) -> DataFrame:
    """(device_id, ts, h): the newest snapshot of each device."""
    return latest(snapshots).select("device_id", "ts", F.col("fingerprint").alias("h"))


def identify(incoming: DataFrame, snapshots: DataFrame, options: IdentifyOptions | None = None) -> DataFrame:
    """(query_id, device_id, confidence, is_new_device, candidates), one row per query.

    Candidates are re-scored with field weights scaled by the stability of each candidate's
    history and with the age of its newest snapshot. The best one is taken if its score is
    above the threshold, ties by the candidate's place.
    """
    return identify_with_candidates(incoming, snapshots, options)[0]


def identify_with_candidates(incoming: DataFrame, snapshots: DataFrame, options: IdentifyOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``identify`` gives, and (query_id, device_id, confidence) of all candidates."""
    options = options or IdentifyOptions()
    queries, store = queries_of(incoming), store_of(snapshots)
    if options.strategy in ("none", "any_key") and plain(options.scoring) and not options.use_lsh:
        scored = nearest(queries, store, options.strategy == "any_key", options.candidate_least, options.candidate_limit, field_stability(snapshots, options.stability_window))
        kept = materialise(best_of_blocks(scored, options.candidate_limit), "candidates")
        found = kept.select("query_id", "device_id", "confidence")
        return _chosen(queries, kept.select("query_id", "device_id", F.col("confidence").alias("first_confidence"), F.col("rescored").alias("composite")), options.match_threshold), found
    found = candidates(queries.select("query_id", "q"), store, options.strategy, options.candidate_least, options.candidate_limit, options.scoring)
    if options.use_lsh:
        found = with_extra(found, shared_bands(queries, store))
    found = materialise(found.select("query_id", "device_id", "confidence"), "candidates")
    # Of the store only the candidates' snapshots are read further.
    chosen = found.select("device_id").distinct()
    past = snapshots.join(chosen, "device_id", "left_semi")
    stabilities = stability_map(field_stability(past, options.stability_window))
    newest = store_of(past)
    pairs = found.select("query_id", "device_id", F.col("confidence").alias("first_confidence")).join(queries, "query_id").join(newest, "device_id").join(stabilities, "device_id", "left")
    scoring = replace(options.scoring, age=age_ms(F.col("query_ts"), F.col("ts")), field_stabilities=F.col("stabilities"))
    rescored = score_pairs(materialise(pairs, "pairs"), "q", "h", scoring)
    return _chosen(queries, rescored, options.match_threshold), found


def _chosen(queries: DataFrame, rescored: DataFrame, threshold: int) -> DataFrame:
    """The best re-scored candidate of each query, or a new device."""
    order = Window.partitionBy("query_id").orderBy(F.desc("composite"), F.desc("first_confidence"), "device_id")
    best = rescored.withColumn("_n", F.row_number().over(order)).withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("_n = 1")
    best = best.select("query_id", F.col("device_id").alias("_found"), "composite", "candidates")
    matched = F.coalesce(F.col("composite") > threshold, F.lit(False))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.when(matched, F.col("_found")).otherwise(F.concat(F.lit("dev_"), F.sha2("query_id", 256))).alias("device_id"),
        F.coalesce("composite", F.lit(0)).alias("confidence"),
        (~matched).alias("is_new_device"),
        F.coalesce("candidates", F.lit(0)).cast("int").alias("candidates"),
    )


def within_window(rows: DataFrame, digest: str, ts: str, window_ms: int) -> DataFrame:
    """Adds ``opened_ms``: when the window opened whose result a repeated row takes.

    A sighting of a digest opens a window of ``window_ms`` from its own time, which hits
    don't extend; the next sighting after it opens another. Rows without a digest or a time
    stand for themselves. The distinct times of a digest are read in order, one at a time,
    so a frequent digest takes time but no memory.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened = None, 0
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or t - opened >= window_ms:
                    key, opened = k, t
                out.append(opened)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=[digest, "_ms", "opened_ms"])

    timed = rows.withColumn("_ms", F.unix_millis(ts))
    sightings = timed.where(F.col(digest).isNotNull() & F.col("_ms").isNotNull()).select(F.col(digest).cast("string"), "_ms").distinct()
    openings = sightings.repartition(digest).sortWithinPartitions(digest, "_ms").mapInArrow(chain, f"`{digest}` string, _ms long, opened_ms long")
    joined = timed.join(openings, [digest, "_ms"], "left")
    return joined.withColumn("opened_ms", F.coalesce("opened_ms", "_ms")).drop("_ms")


PostProcessor = Callable[[DataFrame], DataFrame]


def enrich(results: DataFrame, processors: dict[str, PostProcessor]) -> tuple[DataFrame, dict[str, str]]:
    """Runs each post-processor on the results and writes what it gives; one that fails, in planning or on any row, is left out and its error returned."""
    failures: dict[str, str] = {}
    for name, processor in processors.items():
        try:
            results = materialise(processor(results), "enriched")
        except Exception as error:  # noqa: BLE001 - a plugin may raise anything
            failures[name] = f"{type(error).__name__}: {error}"
    return results, failures


def identify_metrics(log: DataFrame) -> DataFrame:
    """Counters and means over results of ``identify``."""
    return log.agg(
        F.count(F.lit(1)).alias("identify_total"),
        F.count_if(F.col("is_new_device")).alias("new_devices"),
        F.count_if(~F.col("is_new_device")).alias("matches"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg("candidates"), 6).alias("mean_candidates"),
    )
