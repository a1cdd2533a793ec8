"""Deterministic splits, samples and top-k choices; every order is total, none uses a random generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_hash(seed: str, *cols: Column) -> Column:
    """Hex sha256 of seed and columns joined by NUL: the rank key of all splits."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *cols), 256)


def stable_split(df: DataFrame, stratum: str, key: str, seed: str, fraction: float) -> DataFrame:
    """Per stratum the first round(n * fraction) keys by hash are holdout, at least 1 and at most n - 1;
    a stratum of one key stays out of the holdout."""
    d = df.select(stratum, key).distinct()
    w = Window.partitionBy(stratum).orderBy(keyed_hash(seed, F.col(stratum), F.col(key)), key)
    n = F.count("*").over(Window.partitionBy(stratum))
    k = F.when(n <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * fraction))))
    return d.withColumn("rank", F.row_number().over(w)).withColumn("split", F.when(F.col("rank") <= k, "holdout").otherwise("proposal")).drop("rank")


def stable_three_way(df: DataFrame, stratum: str, key: str, seed: str, test: float, dev: float) -> DataFrame:
    """Test first, then dev, then proposal.  Three keys or more give each part at least one; two keys go to
    test or dev by the parity of the first hash digit, and proposal; a single key goes to proposal."""
    d = df.select(stratum, key).distinct()
    h = keyed_hash(seed, F.col(stratum), F.col(key))
    d = d.withColumn("_h", h).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    n = F.count("*").over(Window.partitionBy(stratum))
    t = F.greatest(F.lit(1), F.least(n - 2, F.bround(n * test)))
    v = F.greatest(F.lit(1), F.least(n - t - 1, F.bround(n * dev)))
    first = F.first("_h").over(Window.partitionBy(stratum).orderBy("_h", key))
    odd = F.conv(F.substring(first, 1, 1), 16, 10).cast("int") % 2 == 1
    part = (
        F.when(n == 1, "proposal")
        .when(n == 2, F.when(F.col("rank") == 1, F.when(odd, "test").otherwise("dev")).otherwise("proposal"))
        .when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "dev").otherwise("proposal")
    )
    return d.withColumn("split", part).drop("_h", "rank")


def group_fill_split(df: DataFrame, group: str, seed: str, target: int) -> DataFrame:
    """Whole groups in hash order go to validation until ``target`` rows, or a tenth of all rows if that is less, are reached.

    The running total goes over groups, not rows.
    """
    from tracelake.operators.joins import running_total

    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", keyed_hash(seed, F.col(group)))
    cum = running_total(sizes, ["_h", group], "n", "upto")
    goal = cum.agg(F.least(F.lit(target), F.expr("sum(n) div 10")).alias("_goal"))
    return cum.crossJoin(goal).select(group, "n", F.when(F.col("upto") - F.col("n") < F.col("_goal"), "validation").otherwise("train").alias("split"))


def round_robin(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """Rank-0 row of every group in group order, then rank 1, ... up to ``limit``; 0 or less keeps all."""
    d = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    return d.orderBy("rank", group).limit(limit) if limit > 0 else d.orderBy(group, *order)


def outcome_diverse(df: DataFrame, group: str, positive: str, order: list[Column], per_group: int) -> DataFrame:
    """Best positive, best negative, then the rest by order; ``per_group`` rows, 0 or less keeps all."""
    within = F.row_number().over(Window.partitionBy(group, positive).orderBy(*order))
    d = df.withColumn("_k", within).withColumn("_slot", F.when(F.col("_k") == 1, F.when(F.col(positive), 0).otherwise(1)).otherwise(2))
    d = d.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy("_slot", *order)))
    d = d.drop("_k", "_slot")
    return d.where(F.col("slot") <= per_group) if per_group > 0 else d


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark stops each group at k rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def anchors(df: DataFrame, category: str, order: list[Column], per_category: int, limit: int) -> DataFrame:
    """``per_category`` rows of each category, topped up from the rest to ``limit`` rows."""
    d = df.withColumn("_k", F.row_number().over(Window.partitionBy(category).orderBy(*order)))
    return d.withColumn("is_topup", F.col("_k") > per_category).orderBy("is_topup", "_k", category, *order).limit(limit).drop("_k")


def hash_sample(df: DataFrame, key: str, seed: str, one_in: int) -> DataFrame:
    """One in ``one_in`` rows by hash of the key: the same rows whatever the order or partitioning."""
    return df.where(F.conv(F.substring(keyed_hash(seed, F.col(key)), 1, 8), 16, 10).cast("long") % one_in == 0)


def epoch_order(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Seeded permutation of the rows as a global sort by hash."""
    return df.withColumn("order_key", keyed_hash(seed, F.col(key))).orderBy("order_key", key)
