"""The identity graph: weighted edges between devices, ends in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kenmark.functions.similarity import jaccard, subnet
from kenmark.schema import FINGERPRINT

# Most certain edge, share of a repeated observation, edge weights by reason.
MOST, REPEATED = 0.97, 0.5
SUBNET_WEIGHT, FONT_WEIGHT, FONT_OVERLAP, SUBNET_PEERS = 0.4, 0.3, 0.8, 200
#: Visitors of a subnet whose counts are held at once, and rows of a batch; more are given out in parts.
ROWS_HELD, ROWS_OUT = 2048, 20_000
_MET = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def fold_edges(observations: DataFrame) -> DataFrame:
    """Edges from (a, b, weight, reason, seen_at, seq): each pair once, self links left out.

    A row with ``n`` and ``last_at`` stands for ``n`` equal observations up to that time.
    The first observation sets the weight and each further one adds half of its own, up to
    0.97. As nothing is negative, capping once at the end is the same as capping each time.
    """
    n, last_at = (F.col("n"), F.col("last_at")) if "n" in observations.columns else (F.lit(1), F.col("seen_at"))
    ordered = F.struct("seq", "weight")
    ends = observations.where("a <> b").select(F.least("a", "b").alias("device_id_a"), F.greatest("a", "b").alias("device_id_b"), "weight", "reason", "seen_at", "seq", n.alias("n"), last_at.alias("last_at"))
    first = F.least(F.lit(MOST), F.min(ordered)["weight"])
    # Weights are added in thousandths of a millionth, so that their order doesn't matter.
    exact = lambda w: F.round(w * 1_000_000_000).cast("long")
    more = (F.sum(exact(F.col("weight")) * F.col("n")) - exact(F.min(ordered)["weight"])) / 1_000_000_000 * REPEATED
    return ends.groupBy("device_id_a", "device_id_b").agg(
        F.least(F.lit(MOST), first + more).alias("weight"),
        F.array_sort(F.collect_set("reason")).alias("reasons"),
        F.min("seen_at").alias("first_seen"),
        F.max("last_at").alias("last_seen"),
        F.sum("n").cast("int").alias("occurrences"),
    )


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per pair from rows that are edges themselves, ends in any order: device_id_a, device_id_b, weight, reasons, first_seen, last_seen, occurrences.

    The row first seen, ties by weight, sets the weight and each further one adds half of
    its own, up to 0.97; reasons are united and occurrences added up. Self links and rows
    with a null end or weight don't count; a row without occurrences stands for one.
    """
    rows = edges.where("device_id_a <> device_id_b and weight is not null").select(
        F.least("device_id_a", "device_id_b").alias("device_id_a"), F.greatest("device_id_a", "device_id_b").alias("device_id_b"), "weight", "reasons", "first_seen", "last_seen", "occurrences"
    )
    first = F.min(F.struct("first_seen", "weight"))["weight"]
    exact = lambda w: F.round(w * 1_000_000_000).cast("long")
    more = (F.sum(exact(F.col("weight"))) - exact(first)) / 1_000_000_000 * REPEATED
    return rows.groupBy("device_id_a", "device_id_b").agg(
        F.least(F.lit(MOST), F.least(F.lit(MOST), first) + more).alias("weight"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("reasons"))))).alias("reasons"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum(F.coalesce("occurrences", F.lit(1))).cast("int").alias("occurrences"),
    )


def subnet_meetings(snapshots: DataFrame, peers: int = SUBNET_PEERS) -> DataFrame:
    """Pairs of devices (a, b) in order that met ``n`` times in a /24, ``first`` and ``last`` in microseconds.

    A visit, in order of time and snapshot id, meets all listed devices, then joins the end of
    the list if it isn't on it; a list longer than ``peers`` loses its head, which may come
    back later. One task reads the visits of a subnet in order and counts meetings per pair,
    so only counts are shuffled.
    """
    visits = snapshots.where("device_id is not null and ts is not null").select(subnet(F.col("ip")).alias("net"), "device_id", F.unix_micros("ts").alias("at"), "snapshot_id").where("net is not null")
    # Copies of a snapshot are neighbours in the order.
    ordered = visits.repartition("net").sortWithinPartitions("net", "at", "snapshot_id", "device_id")
    held = ROWS_HELD
    met = ordered.mapInArrow(lambda batches: _replay(batches, peers, held), "a string, b string, n long, first long, last long")
    ends = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "first", "last")
    return ends.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def subnet_observations(snapshots: DataFrame, peers: int = SUBNET_PEERS) -> DataFrame:
    """Meetings in subnets for ``fold_edges``, one row per pair."""
    seen_at, last_at = F.timestamp_micros("first").alias("seen_at"), F.timestamp_micros("last").alias("last_at")
    seq = F.struct(seen_at, F.lit("").alias("net"))
    return subnet_meetings(snapshots, peers).select("a", "b", F.lit(SUBNET_WEIGHT).alias("weight"), F.lit("shared-ip-subnet").alias("reason"), seen_at, seq.alias("seq"), "n", last_at)


def subnet_edges(snapshots: DataFrame, peers: int = SUBNET_PEERS) -> DataFrame:
    """What ``fold_edges`` makes of subnets alone, without folding again."""
    weight = F.least(F.lit(MOST), F.lit(SUBNET_WEIGHT) + F.lit(SUBNET_WEIGHT * REPEATED) * (F.col("n") - 1))
    return subnet_meetings(snapshots, peers).select(
        F.col("a").alias("device_id_a"), F.col("b").alias("device_id_b"), weight.alias("weight"), F.array(F.lit("shared-ip-subnet")).alias("reasons"),
        F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), F.col("n").cast("int").alias("occurrences"),
    )


def _replay(batches: Iterator[pa.RecordBatch], peers: int, held: int) -> Iterator[pa.RecordBatch]:
    """Meetings from visits (net, device_id, at, snapshot_id), ordered; counts of at most ``held`` visitors are kept."""
    count, first, last = (np.zeros((held, peers), np.int64) for _ in range(3))
    listed: list[str | None] = [None] * peers
    slots: dict[str, int] = {}
    visitors: dict[str, int] = {}
    net = before = None
    pushed = 0
    out: list[tuple] = []

    def flush(chosen: slice) -> None:
        names = list(visitors)
        part = count[: len(names), chosen]
        for i, j in np.argwhere(part > 0):
            slot = j + chosen.start
            out.append((names[i], listed[slot], int(count[i, slot]), int(first[i, slot]), int(last[i, slot])))
        part[:] = 0

    def take() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MET.types)], schema=_MET)
        out.clear()
        return batch

    for batch in batches:
        for where, device, at, snapshot in zip(*(c.to_pylist() for c in batch.columns)):
            if where != net:
                flush(slice(0, peers))
                net, before, pushed = where, None, 0
                slots.clear(), visitors.clear()
            if (at, snapshot, device) == before and snapshot is not None:
                continue
            before = (at, snapshot, device)
            i = visitors.get(device)
            if i is None:
                if len(visitors) == held:
                    flush(slice(0, peers))
                    visitors.clear()
                i = visitors[device] = len(visitors)
            size = min(pushed, peers)
            own = slots.get(device)
            new = count[i, :size] == 0
            first[i, :size][new] = at
            last[i, :size] = at
            count[i, :size] += 1
            if own is not None:
                count[i, own] = 0
            else:
                slot = pushed % peers
                if pushed >= peers:
                    flush(slice(slot, slot + 1))
                    del slots[listed[slot]]
                listed[slot], slots[device] = device, slot
                pushed += 1
            if len(out) >= ROWS_OUT:
                yield take()
    flush(slice(0, peers))
    if out:
        yield take()


def font_observations(pairs: DataFrame, least: float = FONT_OVERLAP) -> DataFrame:
    """Edges between (a, fonts_a) and (b, fonts_b), with seen_at, whose fonts overlap by at least ``least``."""
    overlap = jaccard(F.col("fonts_a"), F.col("fonts_b"), FINGERPRINT["fonts"].dataType)
    met = pairs.where((F.size("fonts_a") > 0) & (F.col("a") != F.col("b"))).withColumn("_j", overlap).where(F.col("_j") >= least)
    return met.select("a", "b", (F.col("_j") * FONT_WEIGHT).alias("weight"), F.lit("font-overlap").alias("reason"), "seen_at", F.struct("seen_at", F.lit("~").alias("net")).alias("seq"))


def edge(edges: DataFrame, a: str, b: str) -> DataFrame:
    low, high = sorted((a, b))
    return edges.where((F.col("device_id_a") == low) & (F.col("device_id_b") == high))


def related(edges: DataFrame) -> DataFrame:
    """Every device with its neighbours, ``place`` 1 for the heaviest, ties by id: filter on device_id for one device."""
    rest = ["weight", "reasons", "last_seen", "occurrences"]
    both = edges.select(F.col("device_id_a").alias("device_id"), F.col("device_id_b").alias("related_id"), *rest).unionByName(
        edges.select(F.col("device_id_b").alias("device_id"), F.col("device_id_a").alias("related_id"), *rest)
    )
    return both.withColumn("place", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("weight"), "related_id")))


def stale(edges: DataFrame, now: Column, most_age_ms: int) -> Column:
    return F.unix_millis("last_seen") + most_age_ms <= F.unix_millis(now)


def prune(edges: DataFrame, now: Column, most_age_ms: int) -> DataFrame:
    """The edges seen within the given age."""
    return edges.where(~stale(edges, now, most_age_ms))
