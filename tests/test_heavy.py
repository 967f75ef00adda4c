from collections import Counter
from datetime import datetime, timedelta

from kenmark.operators.heavy import expand_links, heavy_keys, join_on_hot_keys, latest_per_key

T0 = datetime(2025, 1, 1)


def test_latest_with_a_hot_key_ties_copies_and_nulls(spark):
    rows = [("hot", T0 + timedelta(minutes=i % 50), f"r{i:04d}", "x") for i in range(2000)]
    rows += [("cold", T0, "b", "x"), ("cold", T0, "a", "x"), ("cold", T0, "a", "y"), (None, T0, "z", "x"), ("cold", None, "q", "x")]
    df = spark.createDataFrame(rows, "k string, t timestamp, id string, _k_ string")
    got = latest_per_key(df, ["k"], "t", "id", 3).collect()
    assert sorted(r.id for r in got if r.k == "hot") == ["r0049", "r0099", "r0149"]
    assert sorted(r.id for r in got if r.k == "cold") == ["a", "b"]
    assert len(got) == 5
    assert latest_per_key(df.limit(0), ["k"], "t", "id", 3).count() == 0


def test_heavy_keys_are_found(spark):
    df = spark.range(10_000).selectExpr("case when id % 3 = 0 then 'h' else cast(id as string) end as k")
    assert [k for k, _ in heavy_keys(df, ["k"], 0.1)] == ['{"k0":"h"}']


def test_join_equals_plain_join(spark):
    left = spark.range(3000).selectExpr("id", "case when id % 2 = 0 then 'h' else cast(id % 100 as string) end as k")
    right = spark.createDataFrame([("h", 1), ("1", 2), ("3", 3)], "k string, v int")
    for how in ("inner", "left"):
        assert sorted(map(tuple, join_on_hot_keys(left, right, ["k"], how).select("id", "k", "v").collect())) == sorted(map(tuple, left.join(right, "k", how).select("id", "k", "v").collect()))


def test_links_of_big_groups_expand_whole(spark):
    members = spark.range(300).selectExpr("unhex(case when id < 200 then 'ff' when id < 290 then 'fe' else hex(id) end) as g", "id as item")
    links = spark.createDataFrame([("ff", "ff"), ("ff", "fe"), ("fe", hex(295)[2:])], "a string, b string").selectExpr("unhex(a) as g_a", "unhex(b) as g_b")
    plain = links.join(members.toDF("g_a", "item_a"), "g_a").join(members.toDF("g_b", "item_b"), "g_b")
    rows = lambda df: Counter((bytes(r.g_a), bytes(r.g_b), r.item_a, r.item_b) for r in df.collect())
    assert rows(expand_links(links, members, "g", 30)) == rows(expand_links(links, members, "g")) == rows(plain)
    assert expand_links(links.limit(0), members, "g", 30).count() == expand_links(links, members.limit(0), "g", 30).count() == 0
