"""Match quality over labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = list(range(0, 101, 5))


def threshold_sweep(pairs: DataFrame, thresholds: list[int] | None = None) -> DataFrame:
    """Precision, recall, f1, far, frr, eer (their gap) and attr per threshold, of (score, same_device, is_attractor).

    Pairs are counted per score first, so the thresholds meet at most 101 rows.
    """
    counted = pairs.groupBy("score").agg(
        F.count_if(F.col("same_device")).alias("same"),
        F.count_if(~F.col("same_device")).alias("other"),
        F.count_if(~F.col("same_device") & F.col("is_attractor")).alias("common"),
    )
    limits = F.explode(F.array(*map(F.lit, THRESHOLDS if thresholds is None else thresholds))).alias("threshold")
    above = lambda c: F.sum(F.when(F.col("score") >= F.col("threshold"), F.col(c)).otherwise(0))
    sums = counted.select("*", limits).groupBy("threshold").agg(above("same").alias("tp"), above("other").alias("fp"), above("common").alias("ap"), F.sum("same").alias("p"), F.sum("other").alias("n"), F.sum("common").alias("a"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    rated = sums.select(
        "threshold",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("p")).alias("recall"),
        ratio(F.col("fp"), F.col("n")).alias("far"),
        ratio(F.col("p") - F.col("tp"), F.col("p")).alias("frr"),
        ratio(F.col("ap"), F.col("a")).alias("attr"),
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.select("threshold", "precision", "recall", f1.alias("f1"), "far", "frr", F.abs(F.col("far") - F.col("frr")).alias("eer"), "attr")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the best f1, of equal ones the highest threshold."""
    row = F.max(F.struct("f1", "threshold", "precision", "recall"))
    return sweep.agg(row.alias("x")).select("x.threshold", "x.f1", "x.precision", "x.recall")


# Fixed value: gap of far and frr that a calibrated score keeps at its best threshold.
MOST_GAP = 0.08


def within_gate(sweep: DataFrame, most_gap: float = MOST_GAP) -> bool:
    """Whether false accepts and false rejects are about in balance at the best threshold; False without pairs."""
    best = best_threshold(sweep).select("threshold")
    row = sweep.join(F.broadcast(best), "threshold").select("eer", "recall").first()
    return row is not None and row["recall"] > 0 and row["eer"] <= most_gap


def summary(pairs: DataFrame, by: str, value: Column) -> DataFrame:
    """Count, mean, least and most of a score per scenario, the lowest mean first."""
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score")).orderBy("avg_score", by)
