"""Deduplicating new batches against all history.

A record becomes a vector of one hash per field; the distance of two vectors is the number
of fields in which they differ. The index is an inverted file over subspaces: the fields
are dealt to ``limit + 1`` subspaces, strongest fields first, and a vector lies in one cell
of each. Every vector outside the cells of a query differs from it in each subspace, so its
distance is at least ``limit + 1``: after the query's own cells no match is possible, and
probing ends. Within the cells the full vectors are compared exactly. One more kind of cell
holds the records' own content hashes.

The cells of the history are persisted as a table bucketed by cell, so that a batch is
shuffled to the cells and the history stays where it is. Accepted records are appended as
further parts. A manifest beside the parts says what the index consists of; it is published
after its parts, whole or not at all, so that ``CellIndex.open`` finds the index of the last
finished batch in any later session, and the history itself isn't read again. Equal vectors
are stored and probed once; cells that hold a large part of a part's vectors are split, and
a query probes each of the splits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions.text import canonical_text, normalised, number_text
from kenmark.operators.heavy import MOST_HEAVY, SKETCH_ITEMS
from kenmark.plans.scratch import materialise, names_below, new_path, publish, remove

#: Fields of the fingerprint that don't count, and the one that compares as a number.
VOLATILE, NUMBER_TEXT = "behavioralMetrics", "deviceMemory"
ROWS_PER_BUCKET = 1_000_000
#: A cell of more than twice so many entries of a part is split into cells of about so many.
ENTRIES_PER_SPLIT = 50_000


def field_hashes(df: DataFrame, struct: str = "fingerprint") -> list[Column]:
    """One hash per field, f0 and on; a null, and each field of a null struct, gives the hash's seed.

    Lists of text are hashed element by element together with their length, so that an
    empty list isn't null and a null element isn't missing.
    """
    out = []
    for i, f in enumerate(x for x in df.schema[struct].dataType.fields if x.name != VOLATILE):
        value = F.col(struct)[f.name]
        if f.name == NUMBER_TEXT:
            hashed = F.xxhash64(number_text(value))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            entries = F.array_sort(F.array_distinct(F.transform(value, lambda x: F.coalesce(normalised(x), F.lit("\0")))))
            hashed = F.xxhash64(entries, F.size(entries))
        else:
            hashed = F.xxhash64(canonical_text(value, f.dataType))
        out.append(hashed.alias(f"f{i}"))
    return out


def deal_fields(vectors: DataFrame, width: int, limit: int) -> list[list[int]]:
    """The fields of each subspace: in the order of their distinct values, to and fro, so that each has a strong one."""
    row = vectors.agg(*(F.approx_count_distinct(f"f{i}").alias(f"f{i}") for i in range(width))).first()
    order = sorted(range(width), key=lambda i: (-row[i], i))
    spaces: list[list[int]] = [[] for _ in range(limit + 1)]
    for place, i in enumerate(order):
        turn, at = divmod(place, limit + 1)
        spaces[at if turn % 2 == 0 else limit - at].append(i)
    return spaces


@dataclass
class Part:
    """Entries of the index in one folder, the cells that are split there, and how often; 0 buckets if it isn't bucketed."""

    rows: DataFrame
    hot: dict[int, int]
    folder: str
    buckets: int = 0


@dataclass
class CellIndex:
    """An index below ``path``: its parts, as far as they are known here, published or not."""

    spark: SparkSession
    spaces: list[list[int]]
    width: int
    limit: int
    path: str
    parts: list[Part] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    @classmethod
    def build(cls, history: DataFrame, hash_column: str, vector: list[Column], limit: int = 3, path: str | None = None) -> CellIndex:
        """Index of the distinct vectors and content hashes of ``history``, published below ``path``."""
        spark, width = history.sparkSession, len(vector)
        names = [f"f{i}" for i in range(width)]
        first = F.lit(0).alias("batch")
        vectors = materialise(history.select(*vector).distinct().select(*names, first), "vectors")
        hashes = history.select(F.col(hash_column).alias("own_hash")).where("own_hash is not null").distinct().select("own_hash", first)
        index = cls(spark, deal_fields(vectors, width, limit), width, limit, path or new_path(spark, "index"))
        index._write(index.spread(vectors, hashes))
        index.commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        """The index as it was last published below ``path``."""
        manifests = [n for n in names_below(spark, path) if n.startswith("manifest-") and n.endswith(".json")]
        if not manifests:
            raise FileNotFoundError(f"no index below {path}")
        held = json.loads(spark.read.text(f"{path}/{manifests[-1]}", wholetext=True).first()[0])
        index = cls(spark, held["spaces"], held["width"], held["limit"], path)
        for p in held["parts"]:
            rows = index._table(p["folder"], p["buckets"]) if p["buckets"] else spark.read.schema(index._schema()).parquet(f"{path}/{p['folder']}")
            index.parts.append(Part(rows, {int(c): n for c, n in p["hot"].items()}, p["folder"], p["buckets"]))
        return index

    def commit(self) -> None:
        """Publishes all parts; FileExistsError if another writer was first, whose index then holds."""
        parts = [{"folder": p.folder, "buckets": p.buckets, "hot": {str(c): n for c, n in p.hot.items()}} for p in self.parts]
        held = {"spaces": self.spaces, "width": self.width, "limit": self.limit, "parts": parts}
        version = sum(n.startswith("manifest-") and n.endswith(".json") for n in names_below(self.spark, self.path))
        publish(self.spark, f"{self.path}/manifest-{version:08d}.json", json.dumps(held))

    def close(self) -> None:
        """Takes the index's tables out of the session's catalog; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def compact(self) -> None:
        """Brings all parts into one bucketed part, with cells split anew, and publishes it; the old parts are then deleted.

        Each vector is read from the cells of its first subspace only.
        """
        names = [f"f{i}" for i in range(self.width)]
        held = reduce(DataFrame.unionByName, (p.rows for p in self.parts))
        once = held.where("space = 0").groupBy(*names).agg(F.min("batch").alias("batch"))
        hashes = held.where(F.col("space") == len(self.spaces)).groupBy("own_hash").agg(F.min("batch").alias("batch"))
        old = [p.folder for p in self.parts]
        self.parts = []
        self._write(self.spread(once, hashes))
        self.commit()
        for folder in old:
            remove(self.spark, f"{self.path}/{folder}")

    def _schema(self) -> T.StructType:
        kinds = {"cell": T.LongType(), "space": T.IntegerType(), "own_hash": T.StringType(), "batch": T.IntegerType()} | {f"f{i}": T.LongType() for i in range(self.width)}
        return T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    def _table(self, folder: str, buckets: int) -> DataFrame:
        name = f"cells_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._schema())
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell) SORTED BY (cell) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        self.tables.append(name)
        return self.spark.table(name)

    def _hot(self, entries: DataFrame) -> tuple[int, dict[int, int]]:
        """The number of entries, and the cells to split."""
        top = entries.select("cell").agg(F.count("cell").alias("n"), F.expr(f"approx_top_k(cell, {MOST_HEAVY}, {SKETCH_ITEMS})").alias("top")).first()
        share = max(ENTRIES_PER_SPLIT, top["n"] // 1024)
        return top["n"], {x["item"]: min(256, -(-x["count"] // share)) for x in top["top"] or [] if x["count"] > 2 * share}

    def _write(self, entries: DataFrame) -> Part:
        """A bucketed part; the history's."""
        n, hot = self._hot(entries)
        buckets = max(1, min(4096, -(-n // ROWS_PER_BUCKET) * 2), self.spark.sparkContext.defaultParallelism)
        folder, name = f"part-{uuid.uuid4().hex}", f"cells_{uuid.uuid4().hex}"
        placed = self.split(entries, hot, every=False).select(self._schema().fieldNames()).repartition(buckets, "cell")
        placed.write.bucketBy(buckets, "cell").sortBy("cell").option("path", f"{self.path}/{folder}").format("parquet").saveAsTable(name)
        self.tables.append(name)
        self.parts.append(Part(self.spark.table(name), hot, folder, buckets))
        return self.parts[-1]

    def part_of(self, rows: DataFrame, hot: dict[int, int] | None = None) -> Part:
        """Rows with own_hash, batch, f0 and on as a written part, which isn't yet one of the index."""
        folder = f"part-{uuid.uuid4().hex}"
        entries = self.entries(rows).select(self._schema().fieldNames())
        schema, at = self._schema(), f"{self.path}/{folder}"
        self.split(entries, hot or {}, every=False).select(schema.fieldNames()).write.parquet(at)
        held = self.spark.read.schema(schema).parquet(at)
        if hot is None and held.count() > 2 * ENTRIES_PER_SPLIT and (found := self._hot(held)[1]):
            part = self.part_of(rows, found)
            remove(self.spark, at)
            return part
        return Part(held, hot or {}, folder)

    def entries(self, rows: DataFrame) -> DataFrame:
        """The entries of rows with own_hash, batch, f0 and on.

        Of equal vectors, or hashes, the earliest batch is kept: what it can't match no later one can.
        """
        keep = F.min("batch").alias("batch")
        return self.spread(rows.groupBy(*(f"f{i}" for i in range(self.width))).agg(keep), rows.where(F.col("own_hash").isNotNull()).groupBy("own_hash").agg(keep))

    def spread(self, vectors: DataFrame, hashes: DataFrame) -> DataFrame:
        """(cell, space, own_hash, batch, f0 and on): one row per vector and subspace, one per content hash."""
        names = [f"f{i}" for i in range(self.width)]
        cells = F.array(*(F.struct(F.lit(s).alias("space"), F.xxhash64(F.lit(s), *(F.col(f"f{i}") for i in own)).alias("cell")) for s, own in enumerate(self.spaces)))
        spread = vectors.select(F.explode(cells).alias("_c"), F.lit(None).cast("string").alias("own_hash"), "batch", *names).select("_c.cell", "_c.space", "own_hash", "batch", *names)
        last = len(self.spaces)
        own = hashes.select(F.xxhash64(F.lit(last), "own_hash").alias("cell"), F.lit(last).alias("space"), "own_hash", "batch", *(F.lit(None).cast("long").alias(n) for n in names))
        return spread.unionByName(own)

    def split(self, entries: DataFrame, hot: dict[int, int], every: bool) -> DataFrame:
        """Hot cells become several: an entry lies in one of them, a query (``every``) goes to all."""
        if not hot:
            return entries
        names = [f"f{i}" for i in range(self.width)]
        table = F.broadcast(self.spark.createDataFrame([(c, n) for c, n in hot.items()], "cell long, _n int"))
        joined = entries.join(table, "cell", "left")
        if every:
            salts = F.when(F.col("_n").isNotNull(), F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.lit(None).cast("int")))
            joined = joined.withColumn("_s", F.explode(salts))
        else:
            joined = joined.withColumn("_s", F.pmod(F.xxhash64(*names), F.col("_n")).cast("int"))
        return joined.withColumn("cell", F.when(F.col("_s").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", "_s"))).drop("_n", "_s")

    def probe(self, rows: DataFrame, part: Part, earlier: bool = False) -> DataFrame:
        """The rows of which the part holds a match; with ``earlier`` only one of an earlier batch.

        ``rows`` has row (a key), own_hash, batch and f0 and on.
        """
        names = [f"f{i}" for i in range(self.width)]
        kinds = [*names, "own_hash", *(["batch"] if earlier else [])]
        # Rows with equal contents get the same answer, so they are asked once.
        asked = rows.groupBy(*kinds).agg(F.lit(1).alias("_one")) if earlier else rows.select(*kinds).distinct().withColumn("batch", F.lit(None).cast("int"))
        cells = [F.struct(F.lit(s).alias("space"), F.xxhash64(F.lit(s), *(F.col(f"f{i}") for i in own)).alias("cell")) for s, own in enumerate(self.spaces)]
        last = len(self.spaces)
        cells.append(F.struct(F.lit(last).alias("space"), F.when(F.col("own_hash").isNotNull(), F.xxhash64(F.lit(last), "own_hash")).alias("cell")))
        query = asked.select(F.explode(F.array(*cells)).alias("_c"), "own_hash", "batch", *names).select("_c.cell", "_c.space", "own_hash", "batch", *names)
        query = self.split(query.where(F.col("cell").isNotNull()), part.hot, every=True)
        held = part.rows.select([F.col(c).alias(f"h_{c}") for c in part.rows.columns])
        differing = reduce(Column.__add__, [(F.col(n) != F.col(f"h_{n}")).cast("int") for n in names])
        same = ((F.col("space") == last) & (F.col("own_hash") == F.col("h_own_hash"))) | ((F.col("space") < last) & (differing <= self.limit))
        meets = (F.col("cell") == F.col("h_cell")) & (F.col("space") == F.col("h_space")) & same
        if earlier:
            meets &= F.col("batch") > F.col("h_batch")
        matched = query.join(held, meets, "left_semi")
        # A row matches through its vector or through its hash; either is looked up by its own value.
        ways = ["batch"] if earlier else []
        near = matched.where(F.col("space") < last).select(*names, *ways).distinct()
        equal = matched.where(F.col("space") == last).select("own_hash", *ways).distinct()
        by_vector = rows.join(near, [*names, *ways], "left_semi").select("row")
        by_hash = rows.join(equal, ["own_hash", *ways], "left_semi").select("row")
        return by_vector.unionByName(by_hash).distinct()

    def append(self, rows: DataFrame, hot: dict[int, int] | None = None) -> Part:
        """Adds accepted rows to the cells; returns the new part, which ``commit`` publishes."""
        self.parts.append(self.part_of(rows, hot))
        return self.parts[-1]


def known_rows(history: DataFrame | CellIndex, batches: DataFrame, batch: str, hash_column: str, vector: list[Column], keep: list[str], limit: int = 3) -> tuple[DataFrame, CellIndex]:
    """The rows of ``batches`` that match the history or an accepted row of an earlier batch, and the index with all accepted rows.

    Rows match if their content hashes are equal and not null or if their vectors differ in
    at most ``limit`` fields. Rows of one batch don't match each other. ``history`` may be
    an index that was opened; its own limit then holds, only its cells are read, and what
    is accepted becomes part of it, published once at the end. All batches are probed
    against the history's cells at once. Of the rest, those that match no earlier undecided
    row are accepted and appended, those that match these are known, and so on: each round
    decides at least the earliest batch, so there are no more rounds than batches.
    """
    index = history if isinstance(history, CellIndex) else CellIndex.build(history, hash_column, vector, limit)
    names = [f"f{i}" for i in range(index.width)]
    rows = batches.select(F.monotonically_increasing_id().alias("row"), F.col(batch).cast("int").alias("batch"), F.col(hash_column).alias("own_hash"), *keep, *vector)
    rows = materialise(rows, "batches")
    found: list[DataFrame] = []
    undecided = rows.select("row", "batch", "own_hash", *names)
    for part in list(index.parts):
        found.append(materialise(index.probe(undecided, part), "known"))
        undecided = materialise(undecided.join(found[-1], "row", "left_anti"), "undecided")
    while not undecided.isEmpty():
        own = index.part_of(undecided)
        waiting = materialise(index.probe(undecided, own, earlier=True), "waiting")
        remove(index.spark, f"{index.path}/{own.folder}")
        accepted = index.append(undecided.join(waiting, "row", "left_anti"))
        held_back = undecided.join(waiting, "row", "left_semi")
        found.append(materialise(index.probe(held_back, accepted, earlier=True), "known"))
        undecided = materialise(held_back.join(found[-1], "row", "left_anti"), "undecided")
    index.commit()
    known = reduce(DataFrame.unionByName, found) if found else rows.select("row").limit(0)
    return rows.join(known, "row", "left_semi").select(F.col("batch").alias(batch), *keep), index


def known_snapshots(snapshots: DataFrame, incoming: DataFrame, limit: int = 3) -> DataFrame:
    """(batch_no, snapshot_id) of the rows of ``incoming`` that are already known."""
    found, index = known_rows(snapshots, incoming, "batch_no", "signals_hash", field_hashes(incoming), ["snapshot_id"], limit)
    # What was found is written by now and doesn't read the index.
    index.close()
    return found.distinct()
