"""Joins that plain equi-joins do not give: last-wins, ordinal, as-of, range and owner resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import drop_materialized, materialize


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``; ``n_versions`` tells how many there were.

    A partial aggregation, so a hot key costs no window over its rows.  Null keys form one group.
    """
    cols = [c for c in df.columns if c != key]
    o = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    g = df.groupBy(key).agg(F.max_by(F.struct(*cols), o).alias("_r"), F.count("*").alias("n_versions"))
    return g.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in cols], "n_versions")


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor blank: a join key with fallbacks."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def ordinal_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], how: str = "left") -> DataFrame:
    """Match the k-th left row of a key with the k-th right row of it (first in, first out)."""
    lw, rw = Window.partitionBy(*keys).orderBy(*left_order), Window.partitionBy(*keys).orderBy(*right_order)
    return left.withColumn("ordinal", F.row_number().over(lw)).join(right.withColumn("ordinal", F.row_number().over(rw)), [*keys, "ordinal"], how)


def anchor_asof(df: DataFrame, entity: list[str], source: str, order: list[str], turn: str, never: Column) -> DataFrame:
    """``anchor``: the row's own turn, else the last known before it in its source, else the first after
    it, else the entity's largest; rows where ``never`` holds keep only their own turn."""
    w = Window.partitionBy(*entity, source).orderBy(*order)
    before = F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(turn, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    most = F.max(turn).over(Window.partitionBy(*entity))
    return df.withColumn("anchor", F.when(never, F.col(turn)).otherwise(F.coalesce(turn, before, after, most)))


def resolve_owner(edges: DataFrame, max_hops: int = 30) -> DataFrame:
    """(id, parent, owner or null) -> (id, owner, hops): the nearest owner on the way up, itself included.

    Pointer doubling: after round k a node without an owner has looked 2**k hops up, so five rounds
    cover 30 hops whatever the number of rows, and cycles just end without an owner.
    """
    cur = materialize(
        edges.select("id", F.col("parent").alias("jump"), F.col("owner"), F.when(F.col("owner").isNotNull(), F.lit(0)).alias("hops"), F.lit(1).alias("reach")), "owners"
    )
    reach = 1
    while reach <= max_hops:
        up = cur.select(F.col("id").alias("_i"), F.col("jump").alias("_j"), F.col("owner").alias("_o"), F.col("hops").alias("_h"))
        nxt = cur.join(up, F.col("jump") == F.col("_i"), "left")
        known = F.col("owner").isNotNull()
        new = nxt.select(
            "id",
            F.when(known, F.lit(None)).otherwise(F.col("_j")).alias("jump"),
            F.coalesce("owner", "_o").alias("owner"),
            F.coalesce("hops", F.col("_h") + reach).alias("hops"),
            F.lit(reach * 2).alias("reach"),
        )
        new = materialize(new, "owners")
        drop_materialized(cur)
        cur, reach = new, reach * 2
    ok = F.col("hops") <= max_hops
    return cur.select("id", F.when(ok, F.col("owner")).alias("owner"), F.when(ok, F.col("hops")).alias("hops"))


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum over the whole table in ``order`` (which must be unique) without one big task.

    Rows are spread by range; each partition sums its own rows, and what lies before a partition is
    the sum of the partitions before it (one row a partition).
    """
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(before, "_p").withColumn(name, F.col("_b") + F.sum(value).over(w)).drop("_p", "_b")


def range_bucket(df: DataFrame, upto: str, step: int) -> DataFrame:
    """Row -> the fixed-size step its running total falls in (lo < total <= hi): a range join in closed form."""
    return df.withColumn("step", F.expr(f"cast(({upto} - 1) div {step} as bigint)")).withColumn("is_aligned", F.col(upto) % step == 0)


def set_difference_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side); empty when both sides hold the same keys."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def merge_by_precedence(sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """Full outer merge of (key, value) sources; earlier sources win, differing values are flagged."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.select(*key, F.col(value), F.lit(i).alias("_i"))
        tagged = t if tagged is None else tagged.unionByName(t)
    present = tagged.where(F.col(value).isNotNull())
    out = present.groupBy(*key).agg(F.min(F.struct("_i", value)).alias("_first"), (F.min(value) < F.max(value)).alias("_differ"))
    out = out.select(*key, F.col(f"_first.`{value}`").alias(value), "_differ")
    return tagged.select(*key).distinct().join(out, key, "left").select(*key, value, F.coalesce("_differ", F.lit(False)).alias("is_conflict"))


def with_instance(rows: DataFrame, instances: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Left join on ``key`` with an ``error`` column: ``no_key``, ``no_instance`` or null.

    Instances have unique keys; with ``strict`` a row without its instance raises when it is read.
    """
    j = rows.join(instances.withColumn("_found", F.lit(True)), key, "left")
    error = F.when(F.col(key).isNull(), "no_key").when(F.col("_found").isNull(), "no_instance")
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("no instance for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).cast("string")
    return j.withColumn("error", error).drop("_found")
