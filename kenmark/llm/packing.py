"""Filling fixed-capacity containers with items, at target proportions of the sources.

Texts longer than a container are cut into full pieces and a rest; nothing else is split.
Pieces are numbered and spread over tasks of bounded tokens and bounded numbers of pieces,
whatever their keys and sources. Each task serves one queue per source by
deficit round-robin: a window of containers is filled by giving every queue its share of
the window's tokens, and what a queue couldn't use, or used in excess, is carried to the
next window. The first window of a task starts from the deficits that all earlier tasks
leave, which follow from their token counts alone. Within a window pieces are placed
best-fit by decreasing size; those that find no room wait for the next window.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from os.path import basename

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kenmark.plans.scratch import materialise

CAPACITY = 2048
#: Containers of a window; tokens, and pieces, that one task packs in the mean at most.
WINDOW, TOKENS_PER_TASK, PIECES_PER_TASK = 64, 20_000_000, 500_000
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(ranks: str):  # noqa: ANN202
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(documents: DataFrame, key: str, text: str, source: str, ranks: str = RANKS) -> DataFrame:
    """(key, source, n_tokens) in tokens of the tokenizer whose ranks lie at ``ranks``; a null text has none.

    The file is read where the driver runs and sent along with the job.
    """
    documents.sparkSession.sparkContext.addFile(ranks)
    name = basename(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(SparkFiles.get(name))
        for batch in batches:
            n = [len(encoder.encode_ordinary(x)) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[key, source, "n_tokens"])

    kinds = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (key, source)]
    return documents.select(key, source, text).mapInArrow(count, ", ".join(kinds) + ", n_tokens long")


def pieces_of(counts: DataFrame, key: str, source: str, capacity: int) -> DataFrame:
    """(key, source, piece, first_token, size): full pieces and a rest; an item without tokens is one piece of size 0."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(capacity).cast("long"))
    cut = counts.select(key, source, "n_tokens", F.posexplode(starts).alias("piece", "first_token"))
    return cut.select(key, source, "piece", "first_token", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(capacity)).alias("size"))


def fill_window(items: list[tuple[int, int]], capacity: int, window: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Best-fit by decreasing size of (size, item) into ``window`` containers: item -> container, and what found no room."""
    room = [(capacity, c) for c in range(window)]
    placed: dict[int, int] = {}
    left: list[tuple[int, int]] = []
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(room, (size, -1))
        if at == len(room):
            left.append((size, item))
            continue
        free, container = room.pop(at)
        placed[item] = container
        insort(room, (free - size, container))
    return placed, left


def pack(sizes: list[int], sources: list[str], deficits: dict[str, float], target: dict[str, float], capacity: int, window: int) -> list[int]:
    """The container of each item; containers are numbered from 0 without gaps."""
    # In the given order, which is random in sizes, every window has small pieces to fill gaps.
    queues: dict[str, deque[tuple[int, int]]] = {}
    for item, size in enumerate(sizes):
        queues.setdefault(sources[item], deque()).append((size, item))
    deficit = {s: deficits.get(s, 0.0) for s in queues}
    out = [0] * len(sizes)
    begin = 0
    while any(queues.values()):
        space = window * capacity
        chosen: list[tuple[int, int]] = []
        # A little more than fits is chosen; what finds no room goes back.
        while space > -0.05 * window * capacity and any(queues.values()):
            live = [s for s, q in queues.items() if q]
            whole = sum(target.get(s, 0.0) for s in live)
            for s in live:
                deficit[s] += window * capacity / 8 * (target.get(s, 0.0) / whole if whole else 1 / len(live))
            # However far behind, some queue always reaches its first piece.
            if all(deficit[s] < queues[s][0][0] for s in live):
                lift = min(queues[s][0][0] - deficit[s] for s in live)
                for s in live:
                    deficit[s] += lift
            for s in sorted(live, key=lambda s: -deficit[s]):
                queue = queues[s]
                while queue and queue[0][0] <= deficit[s] and space > -0.05 * window * capacity:
                    size, item = queue.popleft()
                    deficit[s] -= size
                    space -= size
                    chosen.append((size, item))
        placed, left = fill_window(chosen, capacity, window)
        for size, item in left:
            deficit[sources[item]] += size
            queues[sources[item]].appendleft((size, item))
        used = {c: i for i, c in enumerate(sorted(set(placed.values())))}
        for item, container in placed.items():
            out[item] = begin + used[container]
        begin += len(used)
    return out


def carried_deficits(per: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """(task, s, share, deficit) from ``per`` (task, s, n): tokens of each source in each task.

    ``share`` is the source's target share, by default that of all tokens. ``deficit`` is
    what all earlier tasks leave the source: its share of their tokens, less its own. There
    is a row per task and source that occurs in it, and no other.
    """
    spark = per.sparkSession
    total = per.agg(F.sum("n")).first()[0] or 1
    if target is None:
        shares = per.groupBy("s").agg((F.sum("n") / F.lit(float(total))).alias("share"))
    else:
        whole = sum(target.values()) or 1
        shares = spark.createDataFrame([(s, x / whole) for s, x in target.items()], "s string, share double")
    # One row per task goes through this window; tasks are few, since each has many tokens or pieces.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    whole = per.groupBy("task").agg(F.sum("n").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = per.withColumn("own", own).join(whole, "task").join(shares, "s", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return rows.select("task", "s", "share", (F.col("share") * F.col("before") - F.col("own")).alias("deficit"))


def packed(
    documents: DataFrame,
    key: str,
    text: str,
    source: str,
    capacity: int = CAPACITY,
    ranks: str = RANKS,
    target: dict[str, float] | None = None,
    window: int = WINDOW,
    tokens_per_task: int = TOKENS_PER_TASK,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """(key, piece, source, first_token, n_tokens, container): the container of each document, or piece of a longer one.

    ``target`` gives the token share of each source, by default that of the whole
    collection. Null sources are one source. Every document gets a row, also without
    tokens; repeated rows are packed once per copy. An empty table gives no rows.
    """
    counts = token_counts(documents, key, text, source, ranks).select(key, F.col(source).cast("string").alias("source"), "n_tokens")
    pieces = materialise(pieces_of(counts, key, "source", capacity).withColumn("n", F.monotonically_increasing_id()), "pieces")
    size = pieces.agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces")).first()
    tasks = max(1, -(-(size["tokens"] or 0) // tokens_per_task), -(-size["pieces"] // pieces_per_task))
    slim = pieces.select(F.pmod(F.xxhash64("n"), F.lit(tasks)).cast("int").alias("task"), "n", F.xxhash64("n", F.lit(1)).alias("h"), F.coalesce("source", F.lit("\0null")).alias("s"), "size")
    debts = materialise(carried_deficits(slim.groupBy("task", "s").agg(F.sum("size").alias("n")), target), "deficits")

    def run(ids: tuple, items: pd.DataFrame, debts: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"n": [], "container": []}).astype("int64")
        items = items.sort_values(["h", "n"], ignore_index=True)
        deficits, shares = dict(zip(debts["s"], debts["deficit"])), dict(zip(debts["s"], debts["share"]))
        found = pack(items["size"].tolist(), items["s"].tolist(), deficits, shares, capacity, window)
        return pd.DataFrame({"n": items["n"], "container": [int(ids[0]) * 2**32 + c for c in found]})

    placed = slim.groupBy("task").cogroup(debts.groupBy("task")).applyInPandas(run, "n long, container long")
    return pieces.join(placed, "n").select(key, "piece", F.col("source").alias(source), "first_token", F.col("size").alias("n_tokens"), "container")


def packed_documents(documents: DataFrame) -> DataFrame:
    """Containers of 2,048 tokens for the documents table, mixed by source."""
    return packed(documents, "doc_id", "text", "source")
