"""History of changing entity attributes, by tree-reduction coalescing.

A snapshot is a unit interval. Neighbouring runs of intervals of one entity are merged
pairwise, over logarithmic rounds, each run keeping per attribute its first observed
value, the row of that observation and its last observed value. Where the last value of
the left run differs from the first of the right one, that row opens a version; runs that
agree become one run. Rows are range-partitioned by (entity, time, row id), so that an
entity with a third of all rows spreads over many tasks, and a task reduces block after
block in bounded memory. Only the first run of a partition depends on other partitions;
it is settled afterwards from at most two run summaries per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions.text import normalised, normalised_set, number_text
from kenmark.plans.scratch import materialise

#: Kinds of rows that the reduction writes.
FINAL, UNSETTLED, SUMMARY = 0, 1, 2

_RUN = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("entity", T.StringType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_to", T.TimestampType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("open_end", T.BooleanType()),
        T.StructField("changed", T.ArrayType(T.IntegerType())),
        T.StructField("first_seen", T.ArrayType(T.IntegerType())),
        T.StructField("state", T.ArrayType(T.StringType())),
    ]
)


def reduce_runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges neighbouring runs pairwise until each entity is one run.

    codes: rows x attributes, a value's code or -1 where it isn't observed. starts: true
    where a row is the first of its entity. Returns, per row and attribute, whether the
    value differs from the last observed one, and whether it is the first observed one.
    """
    n, _ = codes.shape
    changed = np.zeros(codes.shape, bool)
    entity = np.cumsum(starts) - 1
    place = np.arange(n) - np.flatnonzero(starts)[entity]
    first, last = codes.copy(), codes.copy()
    at = np.where(codes >= 0, np.arange(n)[:, None], -1)
    while len(place) and place.max() > 0:
        even = place % 2 == 0
        left = np.flatnonzero(even[:-1] & (entity[:-1] == entity[1:]))
        right = left + 1
        differs = (last[left] >= 0) & (first[right] >= 0) & (last[left] != first[right])
        pair, attribute = np.nonzero(differs)
        changed[at[right[pair], attribute], attribute] = True
        unseen = first[left] < 0
        first[left] = np.where(unseen, first[right], first[left])
        at[left] = np.where(unseen, at[right], at[left])
        last[left] = np.where(last[right] >= 0, last[right], last[left])
        entity, place, first, last, at = entity[even], place[even] // 2, first[even], last[even], at[even]
    opening = np.zeros(codes.shape, bool)
    run, attribute = np.nonzero(at >= 0)
    opening[at[run, attribute], attribute] = True
    return changed, opening


def _reducer(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema(
        [
            ("kind", pa.int32()),
            ("part", pa.int32()),
            ("entity", pa.string()),
            ("valid_from", pa.timestamp("us", "UTC")),
            ("valid_to", pa.timestamp("us", "UTC")),
            ("row_id", pa.string()),
            ("open_end", pa.bool_()),
            ("changed", pa.list_(pa.int32())),
            ("first_seen", pa.list_(pa.int32())),
            ("state", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()

        # entity: the one of the last row; leading: whether it is the partition's first;
        # state: its values as last observed; pending: its version that hasn't ended.
        entity, leading, state, pending, last_key = None, True, [None] * width, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names, stamps = batch.column(0), batch.column(1)
            ids = batch.column(2).to_pylist()
            times = stamps.cast(pa.int64()).fill_null(-(2**63)).to_numpy()
            known = names.dictionary_encode().indices.to_numpy()
            goes_on = names[0].as_py() == entity
            same_entity = np.r_[goes_on, known[1:] == known[:-1]]
            repeated = np.zeros(n, bool)
            for i in np.flatnonzero(np.r_[goes_on, same_entity[1:] & (times[1:] == times[:-1])]):
                key = (times[i - 1], ids[i - 1]) if i else last_key
                repeated[i] = ids[i] is not None and key == (times[i], ids[i])
            # Row 0 stands for what the earlier blocks know of the entity.
            begins = np.r_[True, ~same_entity]
            codes = np.full((n + 1, width), -1)
            values = []
            for k in range(width):
                before = pa.array([state[k] if goes_on else None], pa.string())
                coded = pa.concat_arrays([before, batch.column(3 + k)]).dictionary_encode()
                codes[:, k] = coded.indices.fill_null(-1).to_numpy()
                values.append(coded.dictionary.to_pylist())
            codes[1:][repeated] = -1
            changed, opening = reduce_runs(codes, begins)
            # The latest row at or before each row where the attribute was observed.
            seen = np.maximum.accumulate(np.where(codes >= 0, np.arange(n + 1)[:, None], -1), axis=0)
            begun = np.maximum.accumulate(np.where(begins, np.arange(n + 1), 0))

            def state_at(i: int) -> list[str | None]:
                return [values[k][codes[seen[i, k], k]] if seen[i, k] >= begun[i] else None for k in range(width)]

            # Rows 1 to lead_end are of the partition's first entity; they stay unsettled.
            was_leading = leading and (goes_on or entity is None)
            inner = np.flatnonzero(begins[2:])
            lead_end = 0 if not was_leading else int(inner[0]) + 1 if len(inner) else n
            opens = changed.any(axis=1) | begins
            opens[: lead_end + 1] |= opening[: lead_end + 1].any(axis=1)
            opens[0] = False
            for i in np.flatnonzero(opens).tolist():
                if pending is not None:
                    pending["open_end"] = False
                    if not begins[i]:
                        pending["valid_to"] = stamps[i - 1].as_py()
                    elif pending["kind"] == UNSETTLED:
                        out.append({"kind": SUMMARY, "part": part, "entity": pending["entity"], "state": state_at(i - 1) if i > 1 else state})
                    out.append(pending)
                pending = {
                    "kind": UNSETTLED if i <= lead_end else FINAL,
                    "part": part,
                    "entity": names[i - 1].as_py(),
                    "valid_from": stamps[i - 1].as_py(),
                    "row_id": ids[i - 1],
                    "open_end": True,
                    "changed": np.flatnonzero(changed[i]).tolist(),
                    "first_seen": np.flatnonzero(opening[i]).tolist(),
                    "state": state_at(i),
                }
            leading = was_leading and lead_end == n
            entity, last_key, state = names[n - 1].as_py(), (times[-1], ids[-1]), state_at(n)
            yield from flush()
        if pending is not None:
            out += [pending, {"kind": SUMMARY, "part": part, "entity": entity, "state": state}]
        yield from flush()

    return run


def attribute_history(df: DataFrame, entity: str, time: str, row_id: str, tracked: dict[str, Column]) -> DataFrame:
    """Every version of every entity, with the period in which it was valid.

    ``tracked`` maps an attribute to an expression on ``df`` that gives text. Null or empty
    text is not observed and changes nothing. A version opens at the entity's first row and
    at each row where an observed value differs from the last one observed; a first value
    is no change. Rows are taken in the order of (time, row id).

    Result: entity, row_id (the row that opens the version), valid_from, valid_to (null
    while it holds), changed (the attributes that differ) and attributes (map of all values
    known then). Rows without entity don't count; a row without time comes before all
    others; rows with the same entity, time and row id count once, rows without row id
    each count. An empty table gives no rows.
    """
    fields = list(tracked)
    carried = [f"_v{i}" for i in range(len(fields))]
    rows = df.where(F.col(entity).isNotNull())
    ordered = rows.repartitionByRange(entity, time, row_id).sortWithinPartitions(entity, time, row_id)
    observed = ordered.select(
        F.col(entity).cast("string").alias("_entity"),
        F.col(time).cast("timestamp").alias("_time"),
        F.col(row_id).cast("string").alias("_row"),
        *(F.when(tracked[f] != "", tracked[f]).alias(c) for f, c in zip(fields, carried)),
    )
    runs = materialise(observed.mapInArrow(_reducer(len(fields)), _RUN), "runs")

    # What earlier partitions know of an entity whose run goes on: a prefix over at most two summaries per partition.
    summaries = runs.where(F.col("kind") == SUMMARY).groupBy("entity", "part").agg(F.max("state").alias("state"))
    earlier = Window.partitionBy("entity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = summaries.select(
        "entity",
        "part",
        F.array(*(F.last(F.get("state", F.lit(i)), ignorenulls=True).over(earlier) for i in range(len(fields)))).alias("known"),
        F.lag("part").over(Window.partitionBy("entity").orderBy("part")).isNotNull().alias("goes_on"),
    )
    unsettled = runs.where(F.col("kind") == UNSETTLED).join(carry, ["entity", "part"], "left")
    moved = F.filter("first_seen", lambda i: F.get("known", i) != F.get("state", i))
    within = Window.partitionBy("entity", "part").orderBy("valid_from", "row_id")
    settled = (
        unsettled.withColumn("changed", F.array_sort(F.array_union("changed", F.coalesce(moved, F.array().cast("array<int>")))))
        .withColumn("head", F.row_number().over(within) == 1)
        .where((F.size("changed") > 0) | (F.col("head") & ~F.coalesce("goes_on", F.lit(False))))
        .withColumn("state", F.coalesce(F.zip_with("state", "known", lambda a, b: F.coalesce(a, b)), F.col("state")))
        .withColumn("valid_to", F.lead("valid_from").over(within))
        .withColumn("open_end", F.col("valid_to").isNull())
    )
    columns = ["entity", "part", "valid_from", "valid_to", "row_id", "open_end", "changed", "state"]
    opened = settled.select(columns).unionByName(runs.where(F.col("kind") == FINAL).select(columns))
    # The end of a partition's last version of an entity is the first opening in a later partition.
    later = Window.partitionBy("entity").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    heads = settled.groupBy("entity", "part").agg(F.min("valid_from").alias("opens"))
    ends = (
        summaries.select("entity", "part")
        .join(heads, ["entity", "part"], "left")
        .select("entity", "part", F.min("opens").over(later).alias("next_opens"))
        .where(F.col("next_opens").isNotNull())
    )
    whole = opened.where(~F.col("open_end")).withColumn("next_opens", F.lit(None).cast("timestamp")).unionByName(
        opened.where("open_end").join(ends, ["entity", "part"], "left")
    )
    names = F.array(*map(F.lit, fields))
    return whole.select(
        F.col("entity").alias(entity),
        F.col("row_id").alias(row_id),
        "valid_from",
        F.coalesce("valid_to", "next_opens").alias("valid_to"),
        F.transform("changed", lambda i: F.get(names, i)).alias("changed"),
        F.map_filter(F.map_from_arrays(names, "state"), lambda _, v: v.isNotNull()).alias("attributes"),
    )


#: Text attributes of a fingerprint whose history is followed.
FOLLOWED_TEXT = ["userAgent", "platform", "timezone", "language", "canvas", "webgl", "audio"]


def fingerprint_history(snapshots: DataFrame) -> DataFrame:
    """Versions of the followed attributes of every device of a snapshots table."""
    part = lambda name: F.col(f"fingerprint.{name}")
    flat = snapshots.select(
        "device_id",
        "snapshot_id",
        "ts",
        *(part(f).alias(f) for f in FOLLOWED_TEXT),
        part("hardwareConcurrency").alias("hardwareConcurrency"),
        part("deviceMemory").alias("deviceMemory"),
        part("screen.width").alias("width"),
        part("screen.height").alias("height"),
        part("fonts").alias("fonts"),
    )
    tracked = {f: normalised(F.col(f)) for f in FOLLOWED_TEXT} | {
        "hardwareConcurrency": F.col("hardwareConcurrency").cast("string"),
        "deviceMemory": number_text(F.col("deviceMemory")),
        "screen.width": F.col("width").cast("string"),
        "screen.height": F.col("height").cast("string"),
        "fonts": F.array_join(normalised_set(F.col("fonts")), "\n"),
    }
    return attribute_history(flat, "device_id", "ts", "snapshot_id", tracked)
