"""Stores of snapshots: in memory, as Parquet files or behind JDBC, and how to open one."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmark.operators import blocking, identify, store
from kenmark.plans.scratch import new_path, remove
from kenmark.schema import SNAPSHOT


class SnapshotStore(ABC):
    """What an engine needs of a store; subclasses give ``scan``, ``append`` and ``replace``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def init(self) -> None:
        """Creates the store if it is new; again does nothing."""

    @abstractmethod
    def scan(self) -> DataFrame:
        """All snapshots."""

    @abstractmethod
    def append(self, rows: DataFrame) -> None:
        """Adds rows as they are."""

    @abstractmethod
    def replace(self, rows: DataFrame) -> None:
        """Keeps only the given rows, which may be read from this store."""

    def history(self, device_id: str, n: int = 50) -> DataFrame:
        """The ``n`` newest snapshots of one device; the filter is pushed down to the scan."""
        return store.history(self.scan().where(F.col("device_id") == device_id), n)

    def save(self, rows: DataFrame) -> DataFrame:
        """Appends the rows whose content hash is new; returns (signals_hash, snapshot_id) as stored."""
        self.append(store.new_by_hash(self.scan(), rows.select(SNAPSHOT.fieldNames())))
        return store.hash_index(self.scan()).join(rows.select("signals_hash").distinct(), "signals_hash", "left_semi")

    def candidates(self, queries: DataFrame, strategy: str = "any_key", **options) -> DataFrame:
        return blocking.candidates(queries, identify.store_of(self.scan()), strategy, **options)

    def delete_old(self, days: int, now: Column | None = None) -> int:
        """Deletes snapshots older than ``days``; returns how many."""
        now = F.current_timestamp() if now is None else now
        rows = self.scan()
        gone = store.expired(rows, now, days).count()
        if gone:
            limit = now - F.expr(f"INTERVAL {int(days)} DAYS")
            self.replace(rows.where(F.col("ts").isNull() | (F.col("ts") >= limit)))
        return gone

    def link_user(self, device_id: str, user_id: str) -> None:
        """Sets the user of all snapshots of a device."""
        user = F.when(F.col("device_id") == device_id, F.lit(user_id)).otherwise(F.col("user_id"))
        self.replace(self.scan().withColumn("user_id", user))

    def device_users(self) -> DataFrame:
        return store.device_users(self.scan())

    def close(self) -> None:
        """Releases what the store holds."""


class MemoryStore(SnapshotStore):
    """A cached frame; for tests and small stores."""

    def __init__(self, spark: SparkSession) -> None:
        super().__init__(spark)
        self._rows = spark.createDataFrame([], SNAPSHOT)

    def scan(self) -> DataFrame:
        return self._rows

    def append(self, rows: DataFrame) -> None:
        self._hold(self._rows.unionByName(rows.select(SNAPSHOT.fieldNames())))

    def replace(self, rows: DataFrame) -> None:
        self._hold(rows)

    def _hold(self, rows: DataFrame) -> None:
        before, self._rows = self._rows, rows.cache()
        self._rows.count()
        before.unpersist()

    def close(self) -> None:
        self._rows.unpersist()


class ParquetStore(SnapshotStore):
    """Files below a folder all executors share; each append is a further set of files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark)
        self.path = path

    def init(self) -> None:
        self.spark.createDataFrame([], SNAPSHOT).write.mode("ignore").parquet(self.path)

    def scan(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select(SNAPSHOT.fieldNames()).write.mode("append").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        kept = new_path(self.spark, "kept")
        rows.write.parquet(kept)
        self.spark.read.schema(SNAPSHOT).parquet(kept).write.mode("overwrite").parquet(self.path)
        remove(self.spark, kept)


class JdbcStore(SnapshotStore):
    """One table behind JDBC; the fingerprint and metadata are JSON text there, as in a document column."""

    def __init__(self, spark: SparkSession, url: str, table: str = "snapshots", **options: str) -> None:
        super().__init__(spark)
        self.table, self.options = table, {"url": url, **options}

    def init(self) -> None:
        self._write(self.spark.createDataFrame([], SNAPSHOT), "ignore")

    def scan(self) -> DataFrame:
        return decode_records(self.spark.read.format("jdbc").options(dbtable=self.table, **self.options).load())

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def replace(self, rows: DataFrame) -> None:
        kept = new_path(self.spark, "kept")
        rows.write.parquet(kept)
        self._write(self.spark.read.schema(SNAPSHOT).parquet(kept), "overwrite")
        remove(self.spark, kept)

    def _write(self, rows: DataFrame, mode: str) -> None:
        encode_records(rows).write.format("jdbc").options(dbtable=self.table, **self.options).mode(mode).save()


def encode_records(rows: DataFrame) -> DataFrame:
    """Nested members as JSON text."""
    return rows.select(SNAPSHOT.fieldNames()).withColumns({c: F.to_json(c) for c in ("fingerprint", "metadata")})


def decode_records(rows: DataFrame) -> DataFrame:
    """Nested members from JSON text; rows whose fingerprint isn't an object are left out."""
    kinds = {c: SNAPSHOT[c].dataType for c in ("fingerprint", "metadata")}
    return rows.withColumns({c: F.from_json(c, kind, {"mode": "PERMISSIVE"}) for c, kind in kinds.items()}).where(F.col("fingerprint").isNotNull()).select(SNAPSHOT.fieldNames())


def open_store(spark: SparkSession, kind: str, **options: str) -> SnapshotStore:
    """A store by name: memory; parquet (path); jdbc, sqlite or postgres (url, table and reader options)."""
    if kind == "memory":
        opened: SnapshotStore = MemoryStore(spark)
    elif kind == "parquet":
        if not options.get("path"):
            raise ValueError("a parquet store needs a path")
        opened = ParquetStore(spark, options["path"])
    elif kind in ("jdbc", "sqlite", "postgres"):
        if not options.get("url"):
            raise ValueError(f"a {kind} store needs a url")
        drivers = {"sqlite": "org.sqlite.JDBC", "postgres": "org.postgresql.Driver"}
        opened = JdbcStore(spark, **({"driver": drivers[kind]} if kind in drivers else {}) | options)
    else:
        raise ValueError(f"unknown kind of store: {kind}")
    opened.init()
    return opened
