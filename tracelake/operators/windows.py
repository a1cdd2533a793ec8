"""Ordered computations within an entity: runs, segments, credit roles, offsets and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, entity: list[str], order: str, flag: str) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` holds, as [start, end) positions (gaps and islands)."""
    w = Window.partitionBy(*entity).orderBy(order)
    d = df.withColumn("_pos", F.row_number().over(w) - 1).where(F.col(flag))
    d = d.withColumn("_island", F.col("_pos") - F.row_number().over(w))
    return d.groupBy(*entity, "_island").agg(F.min("_pos").alias("run_start"), (F.max("_pos") + 1).alias("run_end"), F.count("*").alias("run_length")).drop("_island")


def segments(df: DataFrame, entity: list[str], order: str, boundary: str, gamma: float = 0.95, reward: float = 10.0) -> DataFrame:
    """Per row: segment (boundaries strictly before), distance to the next boundary, the decayed reward of
    the historical scheme (0 in the open tail) and the credit role."""
    w = Window.partitionBy(*entity).orderBy(order)
    pos = F.row_number().over(w)
    d = df.withColumn("_i", pos)
    seg = F.coalesce(F.sum(boundary).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nxt = F.first(F.when(F.col(boundary) == 1, F.col("_i")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("segment_id", seg).withColumn("distance", nxt - F.col("_i"))
    return (
        d.withColumn("decayed_reward", F.when(F.col("distance").isNotNull(), F.lit(reward) * F.pow(F.lit(gamma), F.col("distance"))).otherwise(0.0))
        .withColumn("role", F.when(F.col(boundary) == 1, "boundary").when(F.col("distance").isNotNull(), "backfill").otherwise("none")).drop("_i")
    )


def rolling(df: DataFrame, entity: list[str], order: str, value: str, median_span: int = 15, mean_span: int = 10) -> DataFrame:
    """Centred rolling median and trailing rolling mean."""
    w = Window.partitionBy(*entity).orderBy(order)
    h = median_span // 2
    near = F.array_sort(F.collect_list(value).over(w.rowsBetween(-h, h)))  # median_span values at most
    n = F.size("_near")
    middle = (F.element_at("_near", F.expr("int((size(_near) + 1) div 2)")) + F.element_at("_near", F.expr("int(size(_near) div 2 + 1)"))) / 2
    d = df.withColumn("_near", near).withColumn("rolling_median", F.when(n > 0, middle))
    return d.withColumn("rolling_mean", F.avg(value).over(w.rowsBetween(1 - mean_span, 0))).drop("_near")


def recurrences(spikes: DataFrame, entity: list[str], step: str, period: int, tolerance: int = 1) -> DataFrame:
    """Spikes that come back one period later, within a tolerance: a range join made an equi-join on the offsets."""
    a = spikes.select(*entity, F.col(step).alias("step"), F.explode(F.sequence(F.col(step) + period - tolerance, F.col(step) + period + tolerance)).alias("_at"))
    b = spikes.select(*entity, F.col(step).alias("again"))
    return a.join(b.withColumn("_at", F.col("again")), [*entity, "_at"]).select(*entity, "step", "again")


def segment_ends(boundary: str, entity: list[str], order: str):
    """Running count of boundaries up to and including the row."""
    return F.sum(boundary).over(Window.partitionBy(*entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
