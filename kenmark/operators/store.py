"""Operators on the snapshot store: history, latest, dedup, retention, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kenmark.functions.tlsh import digest_udf
from kenmark.operators.scoring import canonical_fingerprint

#: A device with more snapshots is cut by time into blocks, up to so many and one.
ROWS_PER_BLOCK, CUTS = 2000, 63


def history(snapshots: DataFrame, n: int = 50, device: str = "device_id") -> DataFrame:
    """The ``n`` newest distinct snapshots of each device, with ``rank`` 1 for the newest; ties by snapshot id.

    Copies of a snapshot share a dense rank and are dropped afterwards, so the limit per
    device also works before the shuffle.
    """
    newest = Window.partitionBy(device).orderBy(F.desc("ts"), "snapshot_id")
    ranked = snapshots.where(F.col(device).isNotNull()).withColumn("rank", F.dense_rank().over(newest)).where(F.col("rank") <= n)
    return ranked.dropDuplicates([device, "snapshot_id"])


def latest(snapshots: DataFrame) -> DataFrame:
    return history(snapshots, 1).drop("rank")


def consecutive(snapshots: DataFrame, n: int = 5) -> DataFrame:
    """Pairs of neighbours among the ``n`` newest snapshots of each device: ``l`` the newer, ``r`` the older."""
    ranked = history(snapshots, n).select("device_id", "rank", F.struct("snapshot_id", "ts", "fingerprint").alias("s"))
    older = F.lead("s").over(Window.partitionBy("device_id").orderBy("rank"))
    return (
        ranked.withColumn("o", older)
        .where(F.col("o").isNotNull())
        .select("device_id", "rank", F.col("s.snapshot_id").alias("snapshot_id"), F.col("s.ts").alias("ts"), F.col("o.ts").alias("older_ts"), F.col("s.fingerprint").alias("l"), F.col("o.fingerprint").alias("r"))
    )


def neighbours(snapshots: DataFrame, rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """Pairs of all consecutive snapshots of each device: ``l`` the newer, ``r`` the older; ties by snapshot id.

    A device of more than ``rows`` snapshots is cut at quantiles of its times, so that it is
    many groups. The rows at a cut end the newer block as guests too: they are what its
    oldest row is paired with. Copies of a snapshot are neighbours of one time and left out.
    """
    known = snapshots.where(F.col("device_id").isNotNull())
    hot = known.groupBy("device_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("device_id")
    shares = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    cuts = known.select("device_id", "ts").join(F.broadcast(hot), "device_id").groupBy("device_id").agg(F.array_distinct(F.percentile_approx("ts", shares)).alias("_cuts"))
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("ts"))), F.lit(0))
    places = F.when(F.array_contains("_cuts", F.col("ts")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    held = known.select("device_id", "snapshot_id", "ts", "fingerprint").join(F.broadcast(cuts), "device_id", "left").withColumns({"_block": F.when(F.col("_cuts").isNull(), 0).otherwise(block), "_guest": F.explode(places)})
    # Guests are the oldest of their block, so they come last in its order by time.
    placed = held.withColumn("_block", F.col("_block") + F.col("_guest")).drop("_cuts")
    newest = Window.partitionBy("device_id", "_block").orderBy(F.desc("ts"), "snapshot_id")
    once = placed.withColumn("_before", F.lag("snapshot_id").over(newest)).where(~F.col("_before").eqNullSafe(F.col("snapshot_id")))
    older = F.lead(F.struct("ts", "fingerprint")).over(newest)
    return (
        once.withColumn("_o", older)
        .where(F.col("_o").isNotNull() & (F.col("_guest") == 0))
        .select("device_id", "snapshot_id", "ts", F.col("_o.ts").alias("older_ts"), F.col("fingerprint").alias("l"), F.col("_o.fingerprint").alias("r"))
    )


def as_of(queries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(query_id, device_id, query_ts, snapshot_id, ts): the newest snapshot of the query's device before its time, null if there's none.

    ``queries`` has query_id, device_id and query_ts. Of snapshots of one time the smallest
    id counts, as in ``history``. Queries without device or time get nulls. One sort per
    device carries the latest snapshot along, so nothing is multiplied.
    """
    seen = snapshots.where("device_id is not null and ts is not null").select("device_id", F.col("ts").alias("_at"), F.lit(1).alias("_kind"), F.struct("snapshot_id", "ts").alias("_s"), F.lit(None).cast("string").alias("query_id"))
    asked = queries.select("device_id", F.col("query_ts").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(seen.schema["_s"].dataType).alias("_s"), "query_id")
    before = Window.partitionBy("device_id").orderBy("_at", "_kind", F.desc("_s.snapshot_id")).rowsBetween(Window.unboundedPreceding, 0)
    carried = asked.unionByName(seen).withColumn("_last", F.last("_s", ignorenulls=True).over(before)).where("_kind = 0")
    known = F.col("device_id").isNotNull() & F.col("_at").isNotNull()
    return carried.select("query_id", "device_id", F.col("_at").alias("query_ts"), F.when(known, F.col("_last.snapshot_id")).alias("snapshot_id"), F.when(known, F.col("_last.ts")).alias("ts"))


def with_hashes(snapshots: DataFrame, digest: str = "signals_hash") -> DataFrame:
    """The content hash as stored, else the digest of the fingerprint; null where there's too little for one."""
    known = snapshots.where(F.col(digest).isNotNull())
    made = snapshots.where(F.col(digest).isNull()).withColumn(digest, digest_udf(canonical_fingerprint(F.col("fingerprint"))))
    return known.unionByName(made)


def first_by_hash(snapshots: DataFrame, digest: str = "signals_hash") -> DataFrame:
    """One row per content hash, the earliest by (ts, snapshot_id); rows without a hash all stay."""
    ordered = Window.partitionBy(digest).orderBy("ts", "snapshot_id")
    hashed = snapshots.where(F.col(digest).isNotNull()).withColumn("_n", F.row_number().over(ordered)).where("_n = 1").drop("_n")
    return hashed.unionByName(snapshots.where(F.col(digest).isNull()))


def new_by_hash(store: DataFrame, incoming: DataFrame, digest: str = "signals_hash") -> DataFrame:
    """The rows of ``incoming`` to append: first of their hash, and with a hash that the store lacks."""
    known = store.where(F.col(digest).isNotNull()).select(digest).distinct()
    return first_by_hash(incoming, digest).join(known, digest, "left_anti").select(incoming.columns)


def hash_index(snapshots: DataFrame, digest: str = "signals_hash") -> DataFrame:
    """The last snapshot of each hash."""
    return snapshots.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.max(F.struct("ts", "snapshot_id"))["snapshot_id"].alias("snapshot_id"))


def expired(snapshots: DataFrame, now: Column, days: int) -> DataFrame:
    """The rows older than ``days`` before ``now``."""
    return snapshots.where(F.col("ts") < now - F.expr(f"INTERVAL {int(days)} DAYS"))


def device_users(snapshots: DataFrame) -> DataFrame:
    """The user last seen on each device."""
    seen = snapshots.where(F.col("device_id").isNotNull() & F.col("user_id").isNotNull())
    last = F.max(F.struct("ts", "snapshot_id", "user_id"))
    return seen.groupBy("device_id").agg(last.alias("x")).select("device_id", "x.user_id", F.col("x.ts").alias("linked_at"))
