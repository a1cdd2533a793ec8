"""Group-relative credit of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def credited(rows: DataFrame, group: str, trajectory: str, order: str, boundary: str, score: str) -> DataFrame:
    """Add to each turn: ``ordinal`` (k at a trajectory's k-th boundary, else null), ``row_baseline`` (mean
    score over the group's rows), ``traj_baseline`` (over its trajectories), ``n_traj`` and ``n_reach``
    (trajectories of the group with a k-th boundary).

    Everything about a group follows from one narrow row a trajectory (its rows, score and boundaries),
    so the turns are windowed once, and no hot group meets in one task.
    """
    traj = rows.groupBy(group, trajectory).agg(F.count("*").alias("_n"), F.max(score).alias("_s"), F.sum(boundary).alias("_b"))
    base = traj.groupBy(group).agg((F.sum(F.col("_s") * F.col("_n")) / F.sum("_n")).alias("row_baseline"), F.avg("_s").alias("traj_baseline"), F.count("*").alias("n_traj"))
    sizes = traj.where("_b > 0").groupBy(group, "_b").agg(F.count("*").alias("_c"))
    reach = sizes.select(group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_b").cast("bigint"))).alias("ordinal"), "_c").groupBy(group, "ordinal").agg(F.sum("_c").alias("n_reach"))
    w = Window.partitionBy(trajectory).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = rows.withColumn("ordinal", F.when(F.col(boundary) == 1, F.sum(boundary).over(w)).cast("bigint"))
    return turns.join(base, group).join(reach, [group, "ordinal"], "left")
