"""Where an engine reports to: a logger and a sink of metrics."""

from __future__ import annotations

import logging
from collections import defaultdict
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Metrics(Protocol):
    """A sink; any object with these methods will do."""

    def increment(self, name: str, by: float = 1) -> None: ...
    def observe(self, name: str, value: float) -> None: ...
    def gauge(self, name: str, value: float) -> None: ...


class MemoryMetrics:
    """Counters, observed values by count and sum, and last values, in this process."""

    def __init__(self) -> None:
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[str, float] = {}
        self._sums: dict[str, tuple[int, float]] = {}

    def increment(self, name: str, by: float = 1) -> None:
        self.counters[name] += by

    def observe(self, name: str, value: float) -> None:
        n, total = self._sums.get(name, (0, 0.0))
        self._sums[name] = (n + 1, total + value)

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def mean(self, name: str) -> float | None:
        n, total = self._sums.get(name, (0, 0.0))
        return total / n if n else None

    def summary(self, spark: SparkSession) -> DataFrame:
        """(kind, name, value) of all that was reported."""
        rows = [("counter", k, float(v)) for k, v in self.counters.items()]
        rows += [("gauge", k, float(v)) for k, v in self.gauges.items()]
        rows += [("mean", k, float(self.mean(k))) for k in self._sums]
        return spark.createDataFrame(rows, "kind string, name string, value double")


def default_logger() -> logging.Logger:
    return logging.getLogger("kenmark")


def report_batch(results: DataFrame, seconds: float, metrics: Metrics, logger: logging.Logger) -> None:
    """Reports one identified batch; its rows are counted in Spark."""
    hit = F.col("cache_hit") if "cache_hit" in results.columns else F.lit(False)
    row = results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_new_device").alias("new"), F.count_if(hit).alias("hits"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates")
    ).first()
    metrics.increment("identify_total", row["n"])
    metrics.increment("identify_new", row["new"])
    metrics.increment("identify_matched", row["n"] - row["new"])
    metrics.increment("identify_cache_hits", row["hits"])
    metrics.increment("candidates_total", row["candidates"])
    metrics.observe("batch_seconds", seconds)
    metrics.gauge("mean_confidence", row["confidence"])
    logger.info("identified %d records in %.1f s: %d new, %d repeated", row["n"], seconds, row["new"], row["hits"])
