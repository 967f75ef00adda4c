"""Consolidating pairwise matches into groups.

Union-find runs within bounded partitions of the edges, each of which keeps only its
spanning forest as (node, root of its tree). Roots are the nodes of the least hash, so that
the order of names doesn't matter: on a chain about two thirds of the nodes are roots even if
every edge is alone in its partition, and no order of ids can keep levels from shrinking. A node with several roots links them; these links between roots are the edges of
the next level, which is dealt to partitions anew. Levels are merged until the remaining
forest fits one bounded partition or no links are left; then the labels are composed
downwards and named by their smallest node. A hub's edges lie in many partitions, and each
keeps one row of the hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmark.functions.text import normalised
from kenmark.operators.heavy import join_on_hot_keys
from kenmark.plans.scratch import materialise

#: Edges that one task holds at most, in the mean.
EDGES_PER_TASK = 200_000


def rank_of(name: str, level: int) -> int:
    """The hash by which roots are chosen, another one at each level, as a signed number."""
    return xxhash.xxh3_64_intdigest(name, level) - 2**63


def spanning_forest(batches: Iterator[pa.RecordBatch], level: int | None = None) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition; each tree is written as (node, root, rank of the root).

    The root is the node of the least rank at this level or, without one, the smallest node.
    """
    number: dict[str, int] = {}
    names: list[str] = []
    keys: list[tuple] = []
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for name in (u, v):
                if name not in number:
                    number[name] = len(names)
                    parent.append(len(names))
                    names.append(name)
                    keys.append((0 if level is None else rank_of(name, level), name))
            a, b = find(number[u]), find(number[v])
            if a != b:
                if keys[b] < keys[a]:
                    a, b = b, a
                parent[b] = a
    for start in range(0, len(names), 50_000):
        part = range(start, min(start + 50_000, len(names)))
        roots = [find(i) for i in part]
        columns = [pa.array([names[i] for i in part], pa.string()), pa.array([names[r] for r in roots], pa.string()), pa.array([keys[r][0] for r in roots], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "rank"])


def components(edges: DataFrame, a: str, b: str, edges_per_task: int = EDGES_PER_TASK, trace: list[int] | None = None) -> DataFrame:
    """(node, root): each node that an edge links to another one, with the smallest node of its component.

    Rows with a null end and self links give nothing; repeated and reversed rows change
    nothing. Without edges the result is empty. ``trace`` takes the number of links at each
    level.
    """
    ends = edges.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v"))
    links = materialise(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    levels: list[DataFrame] = []
    while True:
        n = links.count()
        if trace is not None:
            trace.append(n)
        tasks = max(1, -(-n // edges_per_task))
        last, whole = tasks == 1, tasks == 1 and not levels
        # Each level deals by another hash, so that links which met no other one meet others.
        spread = links.coalesce(1) if last else links.repartition(tasks, F.xxhash64(F.lit(len(levels)), "u", "v"))
        forest = materialise(spread.mapInArrow(lambda batches, level=None if whole else len(levels): spanning_forest(batches, level), "node string, root string, rank long"), "forest")
        if whole:
            return forest.select("node", "root")
        if last:
            upper = forest.select("node", "root")
            break
        # A node has at most one root per task.
        rooted = materialise(forest.groupBy("node").agg(F.collect_set(F.struct("rank", "root")).alias("roots")).select("node", F.array_min("roots")["root"].alias("root"), F.col("roots.root").alias("roots")), "rooted")
        levels.append(rooted.select("node", "root"))
        between = rooted.where(F.size("roots") > 1).select(F.col("root").alias("u"), F.explode("roots").alias("v")).where("u <> v")
        links = materialise(between.distinct(), "links")

    def step(level: DataFrame, to: DataFrame) -> DataFrame:
        top = to.select(F.col("node").alias("root"), F.col("root").alias("top"))
        return join_on_hot_keys(level, top, ["root"], "left").select("node", F.coalesce("top", "root").alias("root"))

    # Written level by level, since each step reads the one above twice.
    for level in reversed(levels[1:]):
        upper = materialise(step(level, upper), "labels")
    # Components take their smallest node's name: per root of the first level, then per component.
    least = levels[0].groupBy("root").agg(F.min("node").alias("least")).select(F.col("root").alias("node"), F.col("root"), "least")
    top = upper.select("node", F.col("root").alias("top"))
    tops = materialise(least.join(top, "node", "left").select("node", F.coalesce("top", "root").alias("root"), "least"), "tops")
    names = tops.groupBy("root").agg(F.min("least").alias("name"))
    named = join_on_hot_keys(tops.select("node", "root"), names, ["root"]).select("node", F.col("name").alias("root"))
    return step(levels[0], materialise(named, "labels"))


def device_groups(edges: DataFrame, least_weight: float = 0.5) -> DataFrame:
    """(device_id, group_id) of the devices that edges of at least ``least_weight`` link, ids normalised."""
    rows = edges.where((F.col("weight") >= least_weight) & ~F.isnan("weight")).select(normalised(F.col("device_id_a")).alias("a"), normalised(F.col("device_id_b")).alias("b"))
    rows = rows.where("a <> '' and b <> ''")
    return components(rows, "a", "b").select(F.col("node").alias("device_id"), F.col("root").alias("group_id"))
