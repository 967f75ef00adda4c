"""Work per key where a few keys hold most rows.

Heavy keys are found with a frequent-items sketch over all rows, at most ``MOST_HEAVY``
of them, so the list of heavy keys may be broadcast whatever the input. Rows of heavy
keys meet that list in a broadcast join and are spread over salts; rows of all other
keys take the ordinary shuffle. The two results are united. The sketch only chooses the
route: the result is the same for any list of heavy keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kenmark.functions.text import normalised
from kenmark.plans.scratch import materialise

#: No more keys than this are treated as heavy; a key below 1/1024 of the rows never is.
MOST_HEAVY = 256
SKETCH_ITEMS = 4096
#: A group of more members is dealt to parts of about so many when pairs are formed.
ROWS_PER_PART = 1000


def key_text(keys: list[str]) -> Column:
    """One text per combination of keys, different for different combinations; bytes are in base 64."""
    return F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))), {"ignoreNullFields": "false"})


def heavy_keys(df: DataFrame, keys: list[str], share: float = 1 / 1024) -> list[tuple[str, int]]:
    """The keys, as ``key_text``, that hold at least ``share`` of the rows, with their estimated counts."""
    sketch = F.expr(f"approx_top_k(_k, {MOST_HEAVY}, {SKETCH_ITEMS})")
    row = df.select(key_text(keys).alias("_k")).agg(F.count("_k").alias("n"), sketch.alias("top")).first()
    return [(x["item"], x["count"]) for x in row["top"] or [] if x["count"] >= max(2, share * row["n"])]


def heavy_table(df: DataFrame, keys: list[str], rows_per_salt: int = 250_000, share: float = 1 / 1024) -> DataFrame:
    """(_k, _salts) of the heavy keys of ``df``; bounded by ``MOST_HEAVY`` rows."""
    found = heavy_keys(df, keys, share)
    rows = [(k, max(2, min(4096, -(-n // rows_per_salt)))) for k, n in found]
    return df.sparkSession.createDataFrame(rows, "_k string, _salts int")


def latest_per_key(df: DataFrame, keys: list[str], time: str, row_id: str, n: int) -> DataFrame:
    """The ``n`` latest distinct row ids per key, ties by the smaller row id.

    Rows in which a key, the time or the row id is null don't count. Copies of a row (same
    keys, time and row id) count once. An empty table gives no rows. Result: keys, row id,
    time, one row each.
    """
    rows = df.select(*keys, row_id, time).dropna()
    heavy = F.broadcast(heavy_table(rows, keys))
    keyed = rows.withColumn("_k", key_text(keys))
    latest_first = [F.col(time).desc(), F.col(row_id)]

    def best(of: DataFrame, by: list[str]) -> DataFrame:
        # Copies share a dense rank, so they don't push other rows out; Spark limits each group before the shuffle too.
        rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(*latest_first))
        return of.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    salt = F.pmod(F.xxhash64(row_id), F.col("_salts").cast("long"))
    spread = keyed.join(heavy, "_k").withColumn("_salt", salt)
    from_heavy = best(best(spread, ["_k", "_salt"]), ["_k"])
    from_light = best(keyed.join(heavy, "_k", "left_anti"), ["_k"])
    columns = [*keys, row_id, time]
    return from_heavy.select(columns).unionByName(from_light.select(columns)).dropDuplicates(columns)


def join_on_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per key.

    Left rows of heavy keys meet their right rows (one per heavy key, so at most
    ``MOST_HEAVY``) in a broadcast join; all others meet in an ordinary shuffled join.
    """
    heavy = F.broadcast(heavy_table(left, keys))
    l, r = left.withColumn("_k", key_text(keys)), right.withColumn("_k", key_text(keys))
    hot_right = r.join(heavy.select("_k"), "_k", "left_semi")
    hot = l.join(heavy.select("_k"), "_k", "left_semi").join(F.broadcast(hot_right.drop(*keys)), "_k", how)
    cold = l.join(heavy.select("_k"), "_k", "left_anti").join(r.drop(*keys), "_k", how)
    return hot.drop("_k").unionByName(cold.drop("_k"))


def expand_links(links: DataFrame, members: DataFrame, group: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Each member of the one group with each of the other, for every row of ``links``.

    ``links`` has the group's name with the endings _a and _b, ``members`` the group and
    further columns, which get these endings too. A group of more than ``rows_per_part``
    members is dealt to parts and its links to pairs of parts, so that one key of the joins
    makes at most about ``rows_per_part`` squared rows, whatever the size of a group.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_part)
    big = materialise(sizes.select(group, F.ceil(F.col("_n") / rows_per_part).cast("int").alias("_parts")), "big")
    on = lambda s: [f"{group}_{s}"]
    if not big.isEmpty():
        place = F.pmod(F.xxhash64(*members.columns), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int")
        members = join_on_hot_keys(members, big, [group], "left").withColumn("_part", place).drop("_parts")
        for s in "ab":
            parts = big.withColumnRenamed(group, f"{group}_{s}")
            links = join_on_hot_keys(links, parts, on(s), "left").withColumn(f"_part_{s}", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        on = lambda s: [f"{group}_{s}", f"_part_{s}"]
    side = lambda s: members.withColumnsRenamed({c: f"{c}_{s}" for c in members.columns})
    return links.join(side("a"), on("a")).join(side("b"), on("b")).drop("_part_a", "_part_b")


def latest_snapshots(snapshots: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` latest snapshots per pair of normalised platform and screen size."""
    flat = snapshots.select(
        normalised(F.col("fingerprint.platform")).alias("platform"),
        F.col("fingerprint.screen.width").alias("width"),
        F.col("fingerprint.screen.height").alias("height"),
        "snapshot_id",
        "ts",
    )
    return latest_per_key(flat, ["platform", "width", "height"], "ts", "snapshot_id", n)
