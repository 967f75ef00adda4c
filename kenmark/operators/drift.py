"""How far a record departs from its device's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kenmark.functions.registry import Registry
from kenmark.functions.similarity import present, score, total, unit
from kenmark.operators.attractor import attractor_risk
from kenmark.operators.store import consecutive, history
from kenmark.schema import FIELDS, FINGERPRINT, WEIGHTS

# Least expected variance, cap of a z-score in the aggregate, limit of suspicion.
EPSILON, Z_CAP, Z_SUSPICIOUS = 0.05, 5.0, 1.5


def _similarity(a: Column, b: Column, name: str, registry: Registry) -> Column:
    comparator = registry.comparators.get(name)
    return unit(comparator(a, b, name)) if comparator else (a == b).cast("double")


def _both(a: Column, b: Column, name: str, strict: bool) -> Column:
    kind = FINGERPRINT[name].dataType
    return present(a, kind) & present(b, kind) if strict else a.isNotNull() & b.isNotNull()


def field_stability(snapshots: DataFrame, n: int = 5, strict: bool = False, registry: Registry | None = None) -> DataFrame:
    """(device_id, one column per field): mean similarity of neighbours among the ``n`` newest snapshots, 1 where none compare.

    Devices with one snapshot have no row. ``strict`` compares only fields that are present
    on both sides; else blank values count too.
    """
    registry = registry or Registry()
    pairs = consecutive(snapshots, n)
    similar = {f: F.when(_both(F.col("l")[f], F.col("r")[f], f, strict), _similarity(F.col("l")[f], F.col("r")[f], f, registry)) for f in FIELDS}
    return pairs.groupBy("device_id").agg(*(F.coalesce(F.avg(s), F.lit(1.0)).alias(f) for f, s in similar.items()))


def stability_map(stabilities: DataFrame) -> DataFrame:
    return stabilities.select("device_id", F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f)))).alias("stabilities"))


def drift(incoming: DataFrame, snapshots: DataFrame, n: int = 10, z_threshold: float = Z_SUSPICIOUS, registry: Registry | None = None) -> DataFrame:
    """A report per row of ``incoming`` (snapshot_id, device_id, fingerprint) whose device has a history.

    Result: device_id, snapshot_id, drift_score, suspicious_fields (by falling z-score,
    then field order), pattern_flag, snapshots_analyzed, baseline_window_ms.
    """
    registry = registry or Registry()
    past = history(snapshots, n).select("device_id", "ts", F.col("fingerprint").alias("h"))
    met = incoming.select("device_id", "snapshot_id", F.col("fingerprint").alias("q")).join(past, "device_id")
    q, h = F.col("q"), F.col("h")
    far = {f: F.when(_both(q[f], h[f], f, True), _similarity(q[f], h[f], f, registry)) for f in FIELDS}
    per = met.groupBy("device_id", "snapshot_id").agg(
        *(F.avg(s).alias(f"_d_{f}") for f, s in far.items()),
        F.first(attractor_risk(q)).alias("risk"),
        F.count(F.lit(1)).cast("int").alias("snapshots_analyzed"),
        (F.max(F.unix_millis("ts")) - F.min(F.unix_millis("ts"))).alias("baseline_window_ms"),
    )
    stable = field_stability(snapshots, n, True, registry)
    joined = per.join(stable, "device_id", "left")
    entries = []
    for i, f in enumerate(FIELDS):
        deviation = 1 - F.col(f"_d_{f}")
        stability = F.coalesce(F.col(f), F.lit(1.0))
        z = deviation / (1 - stability + EPSILON)
        entry = F.struct((-z).alias("order"), F.lit(i).alias("place"), F.lit(f).alias("field"), stability.alias("historical_stability"), deviation.alias("current_deviation"), z.alias("z_score"), F.lit(float(WEIGHTS[f])).alias("weight"))
        entries.append(F.when(F.col(f"_d_{f}").isNotNull(), entry))
    listed = joined.withColumn("_all", F.array_compact(F.array(*entries)))
    part = lambda f: F.aggregate("_all", F.lit(0.0), lambda s, x: s + f(x))
    listed = listed.withColumns({"_sum": part(lambda x: F.least(x["z_score"], F.lit(Z_CAP)) * x["weight"]), "_most": part(lambda x: x["weight"] * Z_CAP)})
    listed = listed.withColumn("drift_score", F.when(F.col("_most") > 0, score(F.col("_sum") / F.col("_most") * 100)).otherwise(0))
    suspicious = F.array_sort(F.filter("_all", lambda x: x["z_score"] >= z_threshold))
    listed = listed.withColumn("suspicious_fields", F.transform(suspicious, lambda x: F.struct(*(x[c].alias(c) for c in ("field", "historical_stability", "current_deviation", "z_score")))))
    few = F.size("suspicious_fields") <= 3
    flag = (
        F.when((F.col("drift_score") >= 75) & (F.col("risk") >= 50), "CANONICAL_INJECTION")
        .when((F.col("drift_score") >= 55) & few, "ABRUPT_CHANGE")
        .when(F.col("drift_score") >= 30, "INCREMENTAL_DRIFT")
        .otherwise("NORMAL_AGING")
    )
    return listed.select("device_id", "snapshot_id", "drift_score", "suspicious_fields", flag.alias("pattern_flag"), "snapshots_analyzed", "baseline_window_ms")
