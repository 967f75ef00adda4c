"""Identification of a stream of fingerprints, in micro-batches.

``identify_many`` scores a whole batch against the store as it was before, so rows of a
batch don't see each other; ``identify_in_order`` is the ordered replay, in which each row
sees all that earlier ones saved.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kenmark.functions.minhash import band_table, tokens
from kenmark.operators import drift, graph
from kenmark.operators.bands import BandIndex
from kenmark.operators.blocking import HARDWARE_KEYS
from kenmark.operators.identify import IdentifyOptions, enrich, identify_metrics, identify_with_candidates, within_window
from kenmark.operators.store import latest, with_hashes
from kenmark.plans.scratch import materialise, names_below
from kenmark.schema import SNAPSHOT
from kenmark.sources.store import SnapshotStore
from kenmark.streaming.observe import MemoryMetrics, Metrics, default_logger, report_batch

_RESULT = ["query_id", "device_id", "confidence", "is_new_device", "candidates", "cache_hit"]


class DeviceManager:
    """Holds a store, options, post-processors, the identity graph's own observations and a log; identifies frames or streams."""

    def __init__(self, store: SnapshotStore, options: IdentifyOptions | None = None, metrics: Metrics | None = None, logger: logging.Logger | None = None) -> None:
        self.store, self.options = store, options or IdentifyOptions()
        self.sink, self.logger = metrics or MemoryMetrics(), logger or default_logger()
        self.processors: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.failures: list[tuple[str, str]] = []
        self.log: DataFrame | None = None
        self.recent: DataFrame | None = None
        self.font_links: DataFrame | None = None

    def use(self, name: str, processor: Callable[[DataFrame], DataFrame]) -> Callable[[], None]:
        """Registers a post-processor; the returned function takes it out again.

        It gets the results with the column ``incoming``, the whole snapshot of each, and
        may add or change columns.
        """
        if not name or name in self.processors:
            raise ValueError(f"a post-processor needs a name of its own, not {name!r}")
        if not callable(processor):
            raise TypeError("a post-processor must be callable")
        self.processors[name] = processor
        return lambda: self.processors.pop(name, None) and None

    def plugins(self) -> list[str]:
        return list(self.processors)

    def clear_dedup(self) -> None:
        """Forgets all windows of equal hashes."""
        self.recent = None

    def identify_many(self, incoming: DataFrame, output: str | None = None) -> DataFrame:
        """Identifies, saves and enriches one batch of snapshots (without device ids).

        Rows without a content hash get the digest of their fingerprint. Rows whose hash was
        seen within the dedup window, in this or an earlier batch, take the result of the row
        that opened the window; they are neither scored nor saved again. With ``output`` the
        results are written there before anything is saved.
        """
        began = time.perf_counter()
        rows = materialise(with_hashes(incoming), "arrived")
        results, found = self._identified(rows)
        return self._finish(rows, results, found, time.perf_counter() - began, output)

    def _identified(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Results and candidates of rows that have their hashes; nothing is saved."""
        window = self.options.dedup_ms
        hits = None
        if window > 0 and self.recent is not None:
            age = F.unix_millis("ts") - F.col("opened_ms")
            met = rows.join(self.recent, "signals_hash").where((age >= 0) & (age < window))
            hits = materialise(met.select(F.col("snapshot_id").alias("query_id"), F.col("found_device").alias("device_id"), "confidence", "is_new_device", F.lit(0).alias("candidates"), F.lit(True).alias("cache_hit"), "opened_ms"), "hits")
            rows = materialise(rows.join(hits.select(F.col("query_id").alias("snapshot_id")), "snapshot_id", "left_anti"), "arrived")
        rows = materialise(within_window(rows, "signals_hash", "ts", window), "arrived")
        leads = rows.where(F.col("signals_hash").isNull() | (F.unix_millis("ts") == F.col("opened_ms"))) if window > 0 else rows
        once = leads.where(F.col("signals_hash").isNull()).unionByName(leads.where(F.col("signals_hash").isNotNull()).dropDuplicates(["signals_hash", "opened_ms"])) if window > 0 else leads
        once = materialise(once, "once")
        found, candidates = identify_with_candidates(once, self.store.scan(), self.options)
        found = materialise(found, "identified")
        heads = once.select(F.col("snapshot_id").alias("query_id"), "signals_hash", "opened_ms").join(found, "query_id")
        rest = rows.join(once.select("snapshot_id"), "snapshot_id", "left_anti").select("snapshot_id", "signals_hash", "opened_ms")
        repeated = rest.join(heads.drop("query_id", "candidates"), ["signals_hash", "opened_ms"]).select(F.col("snapshot_id").alias("query_id"), "device_id", "confidence", "is_new_device", F.lit(0).alias("candidates"), F.lit(True).alias("cache_hit"), "opened_ms")
        results = found.join(once.select(F.col("snapshot_id").alias("query_id"), "opened_ms"), "query_id").withColumn("cache_hit", F.lit(False)).unionByName(repeated)
        return results if hits is None else results.unionByName(hits), candidates

    def _finish(self, incoming: DataFrame, results: DataFrame, found: DataFrame, seconds: float, output: str | None = None) -> DataFrame:
        """Reports, enriches, writes and saves results of rows that have their hashes."""
        results = materialise(results.select(*_RESULT, "opened_ms"), "results")
        shown = results.drop("opened_ms")
        report_batch(shown, seconds, self.sink, self.logger)
        if self.processors:
            payload = incoming.select(F.col("snapshot_id").alias("query_id"), F.struct(*incoming.columns).alias("incoming")).dropDuplicates(["query_id"])
            shown, failures = enrich(shown.join(payload, "query_id", "left"), self.processors)
            shown = shown.drop("incoming")
            for name, error in failures.items():
                self.logger.warning("post-processor %s failed: %s", name, error)
            self.failures += failures.items()
        if output:
            shown.write.mode("overwrite").parquet(output)
        self._save(incoming, results)
        self._remember(incoming, results, found)
        self.log = shown if self.log is None else self.log.unionByName(shown, allowMissingColumns=True)
        return shown

    def save_again(self, incoming: DataFrame, results: DataFrame) -> None:
        """Saves identified snapshots whose results are known; those that the store holds stay as they are."""
        self._save(materialise(with_hashes(incoming), "arrived"), results)

    def _save(self, incoming: DataFrame, results: DataFrame) -> None:
        """Appends the identified snapshots that the store doesn't hold by their id, so that saving again does nothing."""
        own = results.where(~F.col("cache_hit")).select(F.col("query_id").alias("snapshot_id"), "device_id", F.col("confidence").alias("match_confidence"))
        rows = incoming.drop("device_id", "match_confidence").join(own, "snapshot_id").dropDuplicates(["snapshot_id"])
        held = self.store.scan().select("snapshot_id").distinct()
        self.store.save(materialise(rows.join(held, "snapshot_id", "left_anti").select(SNAPSHOT.fieldNames()), "saved"))

    def _remember(self, incoming: DataFrame, results: DataFrame, found: DataFrame | None) -> None:
        """Keeps the windows that are open, and the links of devices to candidates with the same fonts."""
        window = self.options.dedup_ms
        if window > 0:
            heads = results.where(~F.col("cache_hit")).select(F.col("query_id").alias("snapshot_id"), F.col("device_id").alias("found_device"), "confidence", "is_new_device", "opened_ms")
            opened = incoming.where("signals_hash is not null").select("snapshot_id", "signals_hash").join(heads, "snapshot_id").drop("snapshot_id")
            whole = opened if self.recent is None else opened.unionByName(self.recent)
            last = whole.groupBy("signals_hash").agg(F.max(F.struct("opened_ms", "found_device", "confidence", "is_new_device")).alias("x")).select("signals_hash", "x.*")
            newest = last.agg(F.max("opened_ms")).first()[0]
            self.recent = materialise(last.where(F.col("opened_ms") > (newest or 0) - window), "recent")
        if found is not None:
            asked = incoming.select(F.col("snapshot_id").alias("query_id"), F.col("fingerprint.fonts").alias("fonts_a"), F.col("ts").alias("seen_at")).dropDuplicates(["query_id"])
            a = results.where(~F.col("cache_hit")).select("query_id", F.col("device_id").alias("a")).join(asked, "query_id")
            others = latest(self.store.scan()).select(F.col("device_id").alias("b"), F.col("fingerprint.fonts").alias("fonts_b"))
            met = found.select("query_id", F.col("device_id").alias("b")).join(a, "query_id").join(others, "b")
            links = materialise(graph.font_observations(met), "fonts")
            self.font_links = links if self.font_links is None else self.font_links.unionByName(links)

    def identify_in_order(self, incoming: DataFrame) -> DataFrame:
        """Identifies snapshots one after the other by (ts, snapshot_id): each sees what all earlier ones saved.

        Rows are decided in rounds. A round takes the rows up to the first that shares a
        blocking key or a content hash with an earlier undecided one, identifies them
        together, and keeps those up to the first that has an earlier one's device among its
        candidates; the others wait. So the outcome is that of single steps, while rounds are
        as few as the data allows, and at most as many as rows. Rows without snapshot id don't
        count, of rows of one id one does, rows without time come first. Result: as
        ``identify_many``.
        """
        known = incoming.where("snapshot_id is not null").dropDuplicates(["snapshot_id"])
        undecided = materialise(with_hashes(known).withColumn("_at", F.coalesce(F.unix_micros("ts"), F.lit(-(2**62)))), "waiting")
        place = F.struct("_at", "snapshot_id")
        out: DataFrame | None = None
        while not undecided.isEmpty():
            began = time.perf_counter()
            keyed = self._conflict_keys(undecided)
            second = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("_at", "snapshot_id"))).where("_n = 2")
            cut = second.agg(F.min(place).alias("cut")).first()["cut"]
            before = lambda at: place < F.struct(F.lit(at["_at"]).cast("long").alias("_at"), F.lit(at["snapshot_id"]).alias("snapshot_id"))
            chosen = materialise(undecided.where(before(cut)) if cut else undecided, "round")
            results, found = self._identified(chosen.drop("_at"))
            results = materialise(results, "results")
            at = chosen.select(F.col("snapshot_id").alias("query_id"), place.alias("place"))
            assigned = results.join(at, "query_id").select("device_id", F.col("place").alias("earlier"))
            late = found.select("query_id", "device_id").join(at, "query_id").join(assigned, "device_id").where("earlier < place").agg(F.min("place").alias("cut")).first()["cut"]
            if late:
                chosen = materialise(chosen.where(before(late)), "round")
                results = results.join(chosen.select(F.col("snapshot_id").alias("query_id")), "query_id", "left_semi")
                found = found.join(chosen.select(F.col("snapshot_id").alias("query_id")), "query_id", "left_semi")
            done = self._finish(chosen.drop("_at"), results, found, time.perf_counter() - began)
            out = done if out is None else out.unionByName(done, allowMissingColumns=True)
            undecided = materialise(undecided.join(chosen.select("snapshot_id"), "snapshot_id", "left_anti"), "waiting")
        return out if out is not None else self.identify_many(incoming)

    def _conflict_keys(self, rows: DataFrame) -> DataFrame:
        """(key, _at, snapshot_id): rows that may be each other's candidates, or hits, share a key."""
        keys: list[Column] = [F.concat(F.lit("hash:"), F.col("signals_hash"))]
        if self.options.strategy == "none":
            keys.append(F.lit("any"))
        elif self.options.strategy != "lsh":
            keys += [F.concat(F.lit(f"{k}:"), F.col(f"fingerprint.{k}").cast("string")) for k in HARDWARE_KEYS]
        own = rows.select("_at", "snapshot_id", F.explode(F.array_compact(F.array(*keys))).alias("key"))
        if self.options.strategy == "lsh" or self.options.use_lsh:
            bands = band_table(rows.select("snapshot_id", tokens(F.col("fingerprint")).alias("_t")), "snapshot_id", "_t")
            banded = bands.join(rows.select("snapshot_id", "_at"), "snapshot_id").select("_at", "snapshot_id", F.concat_ws(":", F.lit("band"), "band", "bucket").alias("key"))
            own = own.unionByName(banded)
        return own

    def edges(self) -> DataFrame:
        """The identity graph: shared subnets of the store, and fonts shared with candidates."""
        seen = graph.subnet_observations(self.store.scan())
        if self.font_links is not None:
            fonts = self.font_links.withColumns({"n": F.lit(1).cast("long"), "last_at": F.col("seen_at")})
            seen = seen.unionByName(fonts)
        return graph.fold_edges(seen)

    def related(self, device_id: str) -> DataFrame:
        """The neighbours of one device, heaviest first."""
        return graph.related(self.edges().where((F.col("device_id_a") == device_id) | (F.col("device_id_b") == device_id))).where(F.col("device_id") == device_id).orderBy("place")

    def drift_of(self, incoming: DataFrame, n: int = 10) -> DataFrame:
        """The drift report of each row of ``incoming`` (snapshot_id, device_id, fingerprint) against its device's ``n`` newest snapshots; none without a history."""
        return drift.drift(incoming, self.store.scan(), n)

    def band_index(self) -> BandIndex:
        """The MinHash index of the newest snapshot of each device."""
        return BandIndex.build(latest(self.store.scan()), "device_id", "fingerprint")

    def metrics(self) -> DataFrame | None:
        """Counters and means over all results so far."""
        return None if self.log is None else identify_metrics(self.log)


def identify_stream(stream: DataFrame, manager: DeviceManager, output: str, checkpoint: str) -> StreamingQuery:
    """Runs ``manager.identify_many`` on every micro-batch of snapshots and writes results below ``output``.

    The results of a batch are written before its snapshots are saved. A batch that comes
    again after its results were written isn't identified again, since its own snapshots may
    be in the store by then; they are saved if they aren't there. A batch without results
    saved nothing. So a restart neither loses nor doubles rows.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        at = f"{output}/epoch={epoch}"
        if "_SUCCESS" in names_below(rows.sparkSession, at):
            manager.save_again(rows, rows.sparkSession.read.parquet(at))
        else:
            manager.identify_many(rows, at)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Snapshots per subnet-free window and platform, with late rows within ``delay``."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), F.col("fingerprint.platform").alias("platform")).agg(F.count(F.lit(1)).alias("n"))


def snapshots_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet snapshot files below a folder."""
    return spark.readStream.schema(SNAPSHOT).parquet(path)
