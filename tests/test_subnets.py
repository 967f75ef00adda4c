"""Subnet edges against a replay of the visits, one by one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kenmark.operators import graph
from kenmark.plans.queries import queries

T0 = datetime(2025, 1, 1)


def replay(visits, peers):
    """(a, b) -> [weight, first, last, occurrences] from (ts, snapshot, device, net), link by link."""
    lists, edges = {}, {}
    for ts, _, device, net in sorted(set(visits)):
        listed = lists.setdefault(net, [])
        for other in listed:
            if other != device:
                edge = edges.setdefault((min(device, other), max(device, other)), [0.2, ts, ts, 0])
                edge[:] = [min(0.97, edge[0] + 0.2), edge[1], ts, edge[3] + 1]
        if device not in listed:
            listed.append(device)
            if len(listed) > peers:
                listed.pop(0)
    return {k: [round(w, 9), *rest] for k, (w, *rest) in edges.items()}


def found(rows):
    return {(r.device_id_a, r.device_id_b): [round(r.weight, 9), r.first_seen, r.last_seen, r.occurrences] for r in rows.collect()}


def test_every_visit_reinforces(spark):
    rows = [(f"s{i}", d, T0 + timedelta(hours=i), "10.0.0.9") for i, d in enumerate("abababc")]
    edges = found(graph.fold_edges(graph.subnet_observations(spark.createDataFrame(rows, "snapshot_id string, device_id string, ts timestamp, ip string"))))
    assert edges["a", "b"] == [0.97, T0 + timedelta(hours=1), T0 + timedelta(hours=5), 5]
    assert edges["a", "c"] == edges["b", "c"] == [0.4, T0 + timedelta(hours=6), T0 + timedelta(hours=6), 1]


@pytest.mark.parametrize(("peers", "held"), [(200, 2048), (3, 2048), (3, 2), (1, 5)])
def test_edges_equal_a_replay(spark, tables, monkeypatch, peers, held):
    monkeypatch.setattr(graph, "ROWS_HELD", held)
    snapshots = spark.read.parquet(f"{tables}/snapshots.parquet").withColumn("ip", F.regexp_replace("ip", r"\.\d+\.(\d+)$", ".7.$1"))
    visits = [(r.ts, r.snapshot_id, r.device_id, r.ip.rsplit(".", 1)[0]) for r in snapshots.where("device_id is not null and ip rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'").collect()]
    assert found(graph.fold_edges(graph.subnet_observations(snapshots, peers))) == replay(visits, peers)


def test_query_counts_every_visit(spark, tables):
    micros = lambda t: round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    rows = spark.read.parquet(f"{tables}/snapshots.parquet").where("device_id is not null and ip rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'").collect()
    wanted = replay([(r.ts, r.snapshot_id, r.device_id, r.ip.rsplit(".", 1)[0]) for r in rows], 200)
    got = found(queries()["subnet_edges"](spark, tables))
    assert got == {k: [w, micros(a), micros(b), n] for k, (w, a, b, n) in wanted.items()}
