"""Folding edges that were observed or stored, and the newest snapshot before a time."""

from datetime import datetime, timedelta

import pytest

from kenmark.operators.graph import merge_edges, related
from kenmark.operators.scoring import dimension
from kenmark.operators.store import as_of, with_hashes
from kenmark.schema import SNAPSHOT

T0 = datetime(2025, 1, 1)
EDGES = "device_id_a string, device_id_b string, weight double, reasons array<string>, first_seen timestamp, last_seen timestamp, occurrences int"


def at(hours):
    return T0 + timedelta(hours=hours)


def test_edges_unite_reasons_and_counts(spark):
    rows = [
        ("a", "b", 0.4, ["x", "y"], at(1), at(5), 3),
        ("b", "a", 0.3, ["z", None, "x"], at(0), at(2), None),
        ("a", "a", 0.9, ["x"], at(0), at(0), 1),
        ("a", None, 0.9, ["x"], at(0), at(0), 1),
        ("a", "c", None, ["x"], at(0), at(0), 1),
        ("c", "d", 0.5, None, at(0), at(0), 2),
    ]
    edges = merge_edges(spark.createDataFrame(rows, EDGES))
    got = {(r.device_id_a, r.device_id_b): r for r in edges.collect()}
    assert set(got) == {("a", "b"), ("c", "d")}
    one = got["a", "b"]
    assert (round(one.weight, 9), one.reasons, one.first_seen, one.last_seen, one.occurrences) == (0.5, ["x", "y", "z"], at(0), at(5), 4)
    assert got["c", "d"].reasons in (None, []) and got["c", "d"].occurrences == 2
    assert {(r.device_id, r.related_id, r.place) for r in related(edges).collect()} == {("a", "b", 1), ("b", "a", 1), ("c", "d", 1), ("d", "c", 1)}
    assert merge_edges(edges.limit(0)).count() == 0


def test_newest_snapshot_before_a_time(spark):
    held = spark.createDataFrame([("d", "s2", at(1)), ("d", "s1", at(1)), ("d", "s3", at(3)), (None, "s4", at(0)), ("e", "s5", None)], "device_id string, snapshot_id string, ts timestamp")
    asked = spark.createDataFrame([("q1", "d", at(1)), ("q2", "d", at(2)), ("q3", "d", at(9)), ("q4", None, at(9)), ("q5", "e", at(9)), ("q6", "d", None), ("q2", "d", at(2))], "query_id string, device_id string, query_ts timestamp")
    got = sorted((r.query_id, r.snapshot_id) for r in as_of(asked, held).collect())
    assert got == [("q1", None), ("q2", "s1"), ("q2", "s1"), ("q3", "s3"), ("q4", None), ("q5", None), ("q6", None)]
    assert as_of(asked, held.limit(0)).count() == 7 and as_of(asked.limit(0), held).count() == 0


def test_hashes_are_made_where_none_is_stored(spark, tables):
    rows = spark.read.parquet(f"{tables}/snapshots.parquet").select(SNAPSHOT.fieldNames()).limit(50)
    got = {(r.snapshot_id, r.ts): r.signals_hash for r in with_hashes(rows).collect()}
    for r in rows.collect():
        assert got[r.snapshot_id, r.ts] == r.signals_hash if r.signals_hash else got[r.snapshot_id, r.ts] is None or len(got[r.snapshot_id, r.ts]) == 70


def test_single_scores_have_names(spark):
    with pytest.raises(ValueError):
        dimension(spark.range(1), "l", "r", "guess")
