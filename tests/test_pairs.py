"""Pairs of consecutive snapshots: all of each device, not only the newest."""

import pytest
from pyspark.sql import functions as F

from kenmark.operators.store import neighbours
from kenmark.plans.queries import queries


def expected(rows):
    by_device = {}
    for r in {(r.device_id, r.ts, r.snapshot_id) for r in rows if r.device_id is not None}:
        by_device.setdefault(r[0], []).append(r[1:])
    for device, seen in by_device.items():
        seen.sort(key=lambda x: x[1])
        seen.sort(key=lambda x: x[0], reverse=True)
        yield from ((device, new[1], new[0], old[0]) for new, old in zip(seen, seen[1:]))


@pytest.mark.parametrize("rows", [2000, 20, 3])
def test_all_consecutive_snapshots_are_paired(spark, tables, rows):
    # Months instead of times, so that cuts fall on ties.
    for unit in ("microsecond", "month"):
        snapshots = spark.read.parquet(f"{tables}/snapshots.parquet").withColumn("ts", F.date_trunc(unit, "ts"))
        got = sorted((r.device_id, r.snapshot_id, r.ts, r.older_ts) for r in neighbours(snapshots, rows).drop("l", "r").collect())
        assert got == sorted(expected(snapshots.select("device_id", "ts", "snapshot_id").collect()))


def test_records_of_a_pair_are_those_of_its_snapshots(spark, tables):
    snapshots = spark.read.parquet(f"{tables}/snapshots.parquet")
    digest = lambda c: F.md5(F.to_json(c))
    of = {r.snapshot_id: r.d for r in snapshots.select("snapshot_id", digest("fingerprint").alias("d")).collect()}
    got = neighbours(snapshots, 5).select("device_id", "snapshot_id", digest("l").alias("l"), digest("r").alias("r")).collect()
    chain = {}
    for device, snapshot, ts, older in expected(snapshots.select("device_id", "ts", "snapshot_id").collect()):
        chain.setdefault(device, []).append((snapshot, ts))
    for row in got:
        assert of[row.snapshot_id] == row.l
        later = [s for s, _ in chain[row.device_id]]
        k = later.index(row.snapshot_id)
        assert k + 1 == len(later) or of[later[k + 1]] == row.r


def test_queries_score_every_consecutive_pair(spark, tables):
    snapshots = spark.read.parquet(f"{tables}/snapshots.parquet")
    wanted = sorted((d, s) for d, s, _, _ in expected(snapshots.select("device_id", "ts", "snapshot_id").collect()))
    assert sorted((r.device_id, r.snapshot_id) for r in queries()["temporal_decay"](spark, tables).collect()) == wanted
