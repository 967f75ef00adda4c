"""Searches that take every incoming snapshot as a query, not a share of them."""

import pytest

from kenmark.plans.queries import queries


@pytest.mark.parametrize("name", ["best_match", "candidate_topk", "candidates_any_key", "candidates_none"])
def test_queries_of_any_id_are_answered(spark, tables, tmp_path, name):
    incoming = spark.read.parquet(f"{tables}/incoming.parquet")
    odd = incoming.where("conv(right(snapshot_id, 6), 16, 10) % 50 <> 0")
    odd.write.parquet(f"{tmp_path}/incoming.parquet")
    spark.read.parquet(f"{tables}/snapshots.parquet").write.parquet(f"{tmp_path}/snapshots.parquet")
    asked = {r.snapshot_id for r in odd.select("snapshot_id").collect()}
    found = {r.query_id for r in queries()[name](spark, str(tmp_path)).collect()}
    assert found and found <= asked
    if name == "candidates_none":  # any two snapshots have at least the least score here
        assert found == asked
