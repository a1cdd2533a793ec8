"""Group-relative advantages and segment credit over orders (trajectories) and line items (turns).

Adapter: trajectory = order, prompt group = customer, turn = position of the line item under a
total order, boundary = returned item, score = order total scaled by a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.operators.credit import credited

SCORE_SCALE = 499979.0  # a constant keeps the score free of a global aggregate; prime, so that no mean ends on a rounding tie
GAMMA = 0.95
WEIGHT = 0.5


def turn_rows(spark, d) -> DataFrame:
    """Turns with their prompt group; orders without items drop out (inner join)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    turns = li.withColumn("turn", F.row_number().over(w)).withColumn("is_boundary", (F.col("l_returnflag") == "R").cast("int"))
    return turns.join(od, turns.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("prompt_id"),
        F.col("o_orderkey").alias("trajectory_id"),
        "turn",
        "is_boundary",
        (F.col("o_totalprice") / SCORE_SCALE).alias("score"),
    )


def advantages(rows: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """Outcome, local and combined advantage of every turn.

    outcome: score minus the row-weighted mean of the prompt group.
    local:   at the k-th boundary of a trajectory, 1 minus the share of the group's trajectories
             that reach a k-th boundary; 0 on other turns.
    total:   outcome + weight * local, so weight 0 gives the outcome exactly.
    """
    before = Window.partitionBy("trajectory_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("segment_id", F.coalesce(F.sum("is_boundary").over(before), F.lit(0)))
    out = credited(rows, "prompt_id", "trajectory_id", "turn", "is_boundary", "score")
    local = F.when(F.col("is_boundary") == 1, 1 - F.col("n_reach") / F.col("n_traj")).otherwise(F.lit(0.0))
    return out.select(
        "prompt_id",
        "trajectory_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("segment_id").cast("long").alias("segment_id"),
        F.col("is_boundary").cast("long").alias("is_boundary"),
        F.col("ordinal").cast("long").alias("boundary_ordinal"),
        (F.round("row_baseline", 6) + 0.0).alias("row_baseline"),
        (F.round("traj_baseline", 6) + 0.0).alias("traj_baseline"),
        (F.round(F.col("score") - F.col("row_baseline"), 6) + 0.0).alias("outcome_adv"),
        (F.round(local, 6) + 0.0).alias("local_adv"),
        (F.round(F.col("score") - F.col("row_baseline") + weight * local, 6) + 0.0).alias("total_adv"),
    )


def _flagship(spark, d):
    return advantages(turn_rows(spark, d))


TURNS_SQL = f"""
turns as (
  select o_custkey prompt_id, o_orderkey trajectory_id, o_totalprice / {SCORE_SCALE} score,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) turn,
         case when l_returnflag = 'R' then 1 else 0 end is_boundary
  from lineitem join orders on l_orderkey = o_orderkey)"""

FLAGSHIP_SQL = f"""
with {TURNS_SQL},
seg as (
  select *, coalesce(sum(is_boundary) over (partition by trajectory_id order by turn rows between unbounded preceding and 1 preceding), 0) segment_id,
         case when is_boundary = 1 then sum(is_boundary) over (partition by trajectory_id order by turn) end ordinal
  from turns),
g as (select prompt_id, avg(score) row_baseline from seg group by 1),
t as (select prompt_id, count(*) n_traj, avg(s) traj_baseline
      from (select prompt_id, trajectory_id, max(score) s from seg group by 1, 2) group by 1),
r as (select prompt_id, ordinal, count(*) n_reach from seg where ordinal is not null group by 1, 2)
select seg.prompt_id, trajectory_id, cast(turn as bigint) turn, cast(segment_id as bigint) segment_id, cast(is_boundary as bigint) is_boundary,
       cast(seg.ordinal as bigint) boundary_ordinal, round(row_baseline, 6) + 0.0 row_baseline, round(traj_baseline, 6) + 0.0 traj_baseline,
       round(score - row_baseline, 6) + 0.0 outcome_adv,
       round(case when is_boundary = 1 then 1 - n_reach / n_traj else 0.0 end, 6) + 0.0 local_adv,
       round(score - row_baseline + {WEIGHT} * (case when is_boundary = 1 then 1 - n_reach / n_traj else 0.0 end), 6) + 0.0 total_adv
from seg join g using (prompt_id) join t using (prompt_id) left join r on r.prompt_id = seg.prompt_id and r.ordinal = seg.ordinal
"""


def queries():
    return {"grpo_advantage_flagship": _flagship}


def oracle_sql():
    return {"grpo_advantage_flagship": FLAGSHIP_SQL}
