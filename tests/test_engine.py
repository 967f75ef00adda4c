from datetime import datetime, timedelta
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kenmark.functions.minhash import tokens
from kenmark.functions.registry import ScoringOptions
from kenmark.operators.bands import BandIndex
from kenmark.operators.blocking import BROADCAST_QUERIES, any_key, block
from kenmark.operators.drift import drift
from kenmark.operators.identify import IdentifyOptions, enrich, within_window
from kenmark.operators.scoring import score_pairs
from kenmark.schema import SCORES, SNAPSHOT
from kenmark.sources.store import decode_records, encode_records, open_store
from kenmark.streaming.identify import DeviceManager, identify_stream, snapshots_stream

T0 = datetime(2025, 1, 1)
PLAIN = ScoringOptions(tlsh_weight=0.0)


def snapshots(spark, tables, n=60):
    rows = spark.read.parquet(f"{tables}/snapshots.parquet").where("device_id is not null").dropDuplicates(["snapshot_id"])
    return rows.select(SNAPSHOT.fieldNames()).orderBy("snapshot_id").limit(n)


def test_scores_are_symmetric_bounded_and_full_for_equal_records(spark, tables):
    rows = snapshots(spark, tables).select(F.col("fingerprint").alias("l"), "snapshot_id")
    other = snapshots(spark, tables).select(F.col("fingerprint").alias("r"), F.col("snapshot_id").alias("other"))
    pairs = rows.join(other, F.col("snapshot_id") <= F.col("other"))
    one = score_pairs(pairs, "l", "r", PLAIN).drop("l", "r").toPandas().set_index(["snapshot_id", "other"])
    two = score_pairs(pairs, "r", "l", PLAIN).drop("l", "r").toPandas().set_index(["snapshot_id", "other"])
    assert (one.sort_index() == two.sort_index()).all().all()
    assert one.min().min() >= 0 and one.max().max() <= 100
    same = one[one.index.get_level_values(0) == one.index.get_level_values(1)]
    assert (same.deviceSimilarity == 100).all() and (same.composite[same.attractorRisk < 70] == 100).all()


def test_too_short_for_a_digest_gives_zeros(spark):
    row = spark.range(1).select(F.lit(None).cast(SNAPSHOT["fingerprint"].dataType).alias("l")).withColumn("r", F.col("l"))
    assert set(score_pairs(row, "l", "r").select(*SCORES).first()) == {0}
    assert score_pairs(row, "l", "r", PLAIN).first().fieldAgreement == 50


def test_blocking_equals_its_definition(spark, tables):
    q = snapshots(spark, tables, 20).select(F.col("snapshot_id").alias("query_id"), F.col("fingerprint").alias("q"))
    h = snapshots(spark, tables, 60).dropDuplicates(["device_id"]).select("device_id", "ts", F.col("fingerprint").alias("h"))
    keys = ["deviceMemory", "hardwareConcurrency", "platform"]
    met = q.join(h, F.expr(" or ".join(f"q.{k} = h.{k}" for k in keys)))
    assert any_key(q, h).count() == met.count() == any_key(q, h).select("query_id", "device_id").distinct().count()
    assert block(q, h, "none").count() == q.count() * h.count()
    assert BROADCAST_QUERIES > 0
    with pytest.raises(ValueError):
        block(q, h, "guess")


def test_drift_of_an_unchanged_device_is_none(spark, tables):
    one = snapshots(spark, tables, 1)
    past = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumns({"snapshot_id": F.concat("snapshot_id", F.col("i").cast("string")), "ts": F.expr("ts - make_interval(0, 0, 0, i)")}).drop("i")
    report = drift(one, past).first()
    assert report.drift_score == 0 and report.pattern_flag == "NORMAL_AGING" and report.suspicious_fields == [] and report.snapshots_analyzed == 4
    assert report.baseline_window_ms == 3 * 24 * 3600 * 1000
    assert drift(one, past.limit(0)).count() == 0


def test_window_opens_anew_after_its_end(spark):
    rows = [(str(i), "h", T0 + timedelta(seconds=s)) for i, s in enumerate([0, 3, 4, 5, 9, 10])] + [("n", None, T0)]
    got = {r.snapshot_id: r.opened_ms for r in within_window(spark.createDataFrame(rows, "snapshot_id string, h string, ts timestamp"), "h", "ts", 5000).collect()}
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert [got[str(i)] - base for i in range(6)] == [0, 0, 0, 5000, 5000, 10000] and got["n"] == base


def test_stores(spark, tables, tmp_path):
    rows = snapshots(spark, tables, 30)
    assert encode_records(rows).schema["fingerprint"].dataType.simpleString() == "string"
    assert decode_records(encode_records(rows)).count() == rows.where("fingerprint is not null").count()
    for kind, options in (("memory", {}), ("parquet", {"path": str(tmp_path / "store")})):
        opened = open_store(spark, kind, **options)
        opened.save(rows)
        n = opened.scan().count()
        opened.save(rows)
        without = rows.where("signals_hash is null").count()
        assert opened.scan().count() == n + without
        device = rows.first().device_id
        assert opened.history(device, 2).count() <= 2
        opened.link_user(device, "someone")
        assert opened.device_users().where(F.col("device_id") == device).first().user_id == "someone"
        total = opened.scan().count()
        assert opened.delete_old(1, F.lit("2100-01-01").cast("timestamp")) == total and opened.scan().count() == 0
        opened.close()
    for kind, options in (("parquet", {}), ("postgres", {}), ("cloud", {})):
        with pytest.raises(ValueError):
            open_store(spark, kind, **options)


def test_manager_and_stream(spark, tables, tmp_path):
    rows = snapshots(spark, tables, 40)
    first, second = rows.limit(20), rows
    first.write.parquet(str(tmp_path / "in" / "a"))
    manager = DeviceManager(open_store(spark, "parquet", path=str(tmp_path / "store")), IdentifyOptions(scoring=PLAIN))
    remove = manager.use("label", lambda df: df.withColumn("label", F.lit("x")))
    manager.use("broken", lambda df: df.select("missing"))
    found = manager.identify_many(first).collect()
    assert len(found) == 20 and all(r.is_new_device and r.label == "x" for r in found) and manager.failures[0][0] == "broken"
    remove()
    assert manager.plugins() == ["broken"]
    again = {r.query_id: r for r in manager.identify_many(second.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))).collect()}
    assert len(again) == 40 and not any(again[r.query_id].is_new_device for r in found)
    assert manager.metrics().first().identify_total == 60
    assert manager.sink.counters["identify_total"] == 60 and manager.sink.mean("batch_seconds") > 0
    assert {r.name for r in manager.sink.summary(spark).collect()} >= {"identify_new", "mean_confidence"}
    with pytest.raises(ValueError):
        manager.use("broken", lambda df: df)
    other = DeviceManager(open_store(spark, "memory"), replace(manager.options))
    query = identify_stream(snapshots_stream(spark, str(tmp_path / "in" / "a")), other, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    streamed = {r.query_id: r.device_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {r.query_id: r.device_id for r in found}


def test_restart_dedup_over_batches_and_graph(spark, tables, tmp_path):
    rows = snapshots(spark, tables, 12).withColumn("signals_hash", F.when(F.col("signals_hash") > "8", F.col("signals_hash")))
    manager = DeviceManager(open_store(spark, "parquet", path=str(tmp_path / "store")), IdentifyOptions(scoring=PLAIN))
    out = str(tmp_path / "out")
    first = {r.query_id: r for r in manager.identify_many(rows, out).collect()}
    stored = manager.store.scan().count()
    manager.save_again(rows, spark.read.parquet(out))
    assert manager.store.scan().count() == stored
    # The same contents a second later are hits of the earlier batch, until the cache is cleared.
    soon = rows.withColumns({"snapshot_id": F.concat("snapshot_id", F.lit("+")), "ts": F.expr("ts + interval 1 second")})
    hashed = {r.snapshot_id for r in manager.store.scan().where("signals_hash is not null").collect()}
    newest = max(r.ts for r in rows.collect())
    late = {r.snapshot_id for r in rows.collect() if (newest - r.ts).total_seconds() < 5} & hashed
    again = {r.query_id: r for r in manager.identify_many(soon).collect()}
    assert late and all(again[f"{i}+"].cache_hit and again[f"{i}+"].device_id == first[i].device_id for i in late)
    manager.clear_dedup()
    assert manager.recent is None
    edges = manager.edges()
    assert {x for r in edges.collect() for x in r.reasons} <= {"shared-ip-subnet", "font-overlap"}
    some = edges.first()
    if some:
        near = manager.related(some.device_id_a).collect()
        assert [r.place for r in near] == list(range(1, len(near) + 1)) and near[0].weight == max(r.weight for r in near)
    assert manager.drift_of(rows.drop("device_id").join(manager.store.scan().select("snapshot_id", "device_id"), "snapshot_id")).count() > 0


def test_later_rows_see_earlier_ones_in_order(spark, tables):
    one = snapshots(spark, tables, 1).withColumn("signals_hash", F.lit(None).cast("string"))
    visits = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"snapshot_id": F.concat("snapshot_id", F.lit("-"), F.col("i").cast("string")), "ts": F.expr("ts + make_interval(0, 0, 0, i)")}).drop("i")
    options = IdentifyOptions(scoring=PLAIN)
    together = DeviceManager(open_store(spark, "memory"), options).identify_many(visits).collect()
    assert len({r.device_id for r in together}) == 3
    manager = DeviceManager(open_store(spark, "memory"), options)
    ordered = sorted(manager.identify_in_order(visits).collect(), key=lambda r: r.query_id)
    assert [r.is_new_device for r in ordered] == [True, False, False] and len({r.device_id for r in ordered}) == 1
    # Equal contents are stored once.
    assert manager.store.scan().count() == 1 and manager.identify_in_order(visits.limit(0)).count() == 0


def test_enrich_isolates_failures(spark):
    df = spark.range(2)
    late = F.udf(lambda i: 1 // i, "int")
    out, failures = enrich(df, {"bad": lambda d: 1 / 0, "late": lambda d: d.withColumn("y", late("id")), "good": lambda d: d.withColumn("x", F.lit(1))})
    assert out.columns == ["id", "x"] and "ZeroDivisionError" in failures["bad"] and set(failures) == {"bad", "late"}


def test_bands_find_similar_sets(spark, tables):
    rows = snapshots(spark, tables, 400).where("size(fingerprint.fonts) > 0")
    sets = {r.snapshot_id: set(r.t) for r in rows.select("snapshot_id", tokens(F.col("fingerprint")).alias("t")).collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    index = BandIndex.build(rows, "snapshot_id", "fingerprint")
    found = {(r.query_id, r.id) for r in index.query(rows, "snapshot_id", "fingerprint").collect()}
    assert len(alike) > 50 and len(alike & found) >= 0.9 * len(alike)


def test_band_index(spark, tables):
    rows = snapshots(spark, tables, 12).where("size(fingerprint.fonts) > 0")
    index = BandIndex.build(rows, "snapshot_id", "fingerprint", 32, 8)
    found = {(r.query_id, r.id) for r in index.query(rows, "snapshot_id", "fingerprint").collect()}
    ids = [r.snapshot_id for r in rows.select("snapshot_id").collect()]
    assert {(i, i) for i in ids} <= found and index.size() == len(ids)
    assert index.add(rows, "snapshot_id", "fingerprint").size() == len(ids)
    less = index.remove(spark.createDataFrame([(ids[0],)], "id string"))
    assert less.size() == len(ids) - 1 and index.clear().size() == 0
    with pytest.raises(ValueError):
        BandIndex.build(rows, "snapshot_id", "fingerprint", 10, 3)
