"""Set and multiset operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Copies of each key that were removed or added between two multisets; unchanged keys are left out."""
    a = before.groupBy(key).agg(F.count("*").alias("n_before"))
    b = after.groupBy(key).agg(F.count("*").alias("n_after"))
    j = a.join(b, key, "full_outer").select(key, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return j.where("n_before <> n_after").withColumn("removed", F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0))).withColumn("added", F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0)))


def union_first(sources: list[DataFrame], fingerprint: list[str], order: list[str]) -> DataFrame:
    """Concatenate sources and keep the first row of each fingerprint, by source and then ``order``."""
    all_ = None
    for i, s in enumerate(sources):
        t = s.withColumn("source_index", F.lit(i))
        all_ = t if all_ is None else all_.unionByName(t)
    cols = [c for c in all_.columns if c not in fingerprint]
    g = all_.groupBy(*fingerprint).agg(F.min_by(F.struct(*cols), F.struct("source_index", *order)).alias("_r"))
    return g.select(*fingerprint, *[F.col(f"_r.`{c}`").alias(c) for c in cols])


def set_relation(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes, intersection and whether the sets are equal, disjoint or left within right."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full_outer").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count(F.expr("case when _a = 1 and _b = 1 then 1 end")).alias("n_both"))
    return j.select("*", (F.col("n_both") == 0).alias("is_disjoint"), (F.col("n_both") == F.col("n_left")).alias("is_subset"), ((F.col("n_both") == F.col("n_left")) & (F.col("n_left") == F.col("n_right"))).alias("is_equal"))
