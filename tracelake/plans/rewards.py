"""Rollouts, rewards and cases: joins, funnels, turn credit and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.operators import aggregates as A
from tracelake.operators import joins as J
from tracelake.operators import windows as W
from tracelake.operators.credit import credited
from tracelake.plans.common import REWARDS, ROLLOUTS, rewards, rollouts

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {REWARDS} select request_id, round(score, 6) score, cast(n_versions as bigint) n_versions from re")
def reward_last_wins(spark, d):
    return rewards(spark, d).select("request_id", F.round("score", 6).alias("score"), "n_versions")


@query(f"with {ROLLOUTS}, {REWARDS} select ro.request_id, case_id, domain, round(score, 6) score, benchmark_overall_pass overall_pass from ro join re using (request_id)")
def rollout_reward_join(spark, d):
    return rollouts(spark, d).join(rewards(spark, d), "request_id").select("request_id", "case_id", "domain", F.round("score", 6).alias("score"), F.col("benchmark_overall_pass").alias("overall_pass"))


@query(f"with {ROLLOUTS}, {REWARDS} select domain, count(*) n_unmatched from ro where request_id not in (select request_id from re) group by 1")
def rollouts_without_reward(spark, d):
    return rollouts(spark, d).join(rewards(spark, d).select("request_id"), "request_id", "left_anti").groupBy("domain").agg(F.count("*").alias("n_unmatched"))


@query(f"with {ROLLOUTS}, {REWARDS} select request_id from re where request_id not in (select request_id from ro)")
def rewards_without_rollout(spark, d):
    return rewards(spark, d).select("request_id").join(rollouts(spark, d).select("request_id"), "request_id", "left_anti")


@query(f"""with {ROLLOUTS} select ro.request_id, ro.case_id, coalesce(c.metadata.skill_domain, ro.domain) skill_domain, coalesce(c.metadata.difficulty, 'unset') difficulty, c.case_id is not null is_listed
from ro left join dataset_cases c on ro.case_id = c.case_id""")
def rollout_case_left_join(spark, d):
    c = table(spark, d, "dataset_cases").select("case_id", F.col("metadata.skill_domain").alias("sd"), F.col("metadata.difficulty").alias("df"), F.lit(True).alias("listed"))
    return rollouts(spark, d).join(c, "case_id", "left").select(
        "request_id", "case_id", F.coalesce("sd", "domain").alias("skill_domain"), F.coalesce("df", F.lit("unset")).alias("difficulty"), F.coalesce("listed", F.lit(False)).alias("is_listed")
    )


@query("""with m as (select case_id, map_concat(map {'difficulty': coalesce(metadata.difficulty, 'none'), 'dataset': coalesce(dataset_name, 'none')}, map {'difficulty': coalesce(metadata.difficulty, 'unset')}) m from dataset_cases)
select case_id, m['difficulty'] difficulty, m['dataset'] dataset from m""")
def metadata_last_wins_map(spark, d):
    c = table(spark, d, "dataset_cases")
    base = F.create_map(F.lit("difficulty"), F.coalesce("metadata.difficulty", F.lit("none")), F.lit("dataset"), F.coalesce("dataset_name", F.lit("none")))
    over = F.create_map(F.lit("difficulty"), F.coalesce("metadata.difficulty", F.lit("unset")))
    # Later maps win: keys of the first that the second has are dropped before they are joined.
    m = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return c.select("case_id", m.alias("m")).select("case_id", F.col("m")["difficulty"].alias("difficulty"), F.col("m")["dataset"].alias("dataset"))


_DIMS = [f"benchmark_d{i}_pass" for i in range(1, 6)]


@query(f"with {REWARDS} select request_id, round(0.7 * coalesce(benchmark_overall_pass, 0) + 0.3 * ({' + '.join(f'coalesce({c}, 0)' for c in _DIMS)}) / 5, 6) reward from re")
def scalar_reward(spark, d):
    dims = sum((F.coalesce(c, F.lit(0.0)) for c in _DIMS), F.lit(0.0)) / 5
    return rewards(spark, d).select("request_id", F.round(0.7 * F.coalesce("benchmark_overall_pass", F.lit(0.0)) + 0.3 * dims, 6).alias("reward"))


_FUNNEL = [
    ("no_reward", "n_versions is null", lambda: F.col("n_versions").isNull()),
    ("judge_error", "benchmark_judge_error is not null", lambda: F.col("benchmark_judge_error").isNotNull()),
    ("no_score", "score is null", lambda: F.col("score").isNull()),
    ("no_calls", "coalesce(model_calls, 0) = 0", lambda: F.coalesce("model_calls", F.lit(0)) == 0),
    ("failed", "benchmark_overall_pass <> 1", lambda: F.col("benchmark_overall_pass") != 1),
    ("low_coverage", "milestone_tool_mapping_coverage < 0.5", lambda: F.col("milestone_tool_mapping_coverage") < 0.5),
]


@query(f"""with {ROLLOUTS}, {REWARDS} select case {' '.join(f"when {s} then '{n}'" for n, s, _ in _FUNNEL)} else 'kept' end reason, count(*) n from ro left join re using (request_id) group by 1""")
def funnel_first_reason(spark, d):
    reason = None
    for name, _, cond in _FUNNEL:
        reason = F.when(cond(), name) if reason is None else reason.when(cond(), name)
    return rollouts(spark, d).join(rewards(spark, d).drop("ingested_at"), "request_id", "left").select(reason.otherwise("kept").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""with {ROLLOUTS}, {REWARDS}, f as (select case {' '.join(f"when {s} then {i}" for i, (n, s, _) in enumerate(_FUNNEL))} else {len(_FUNNEL)} end stage from ro left join re using (request_id))
select i stage, cast(count_if(stage >= i) as bigint) n_left from f, range(0, {len(_FUNNEL) + 1}) t(i) group by 1""")
def funnel_accounting(spark, d):
    reason = None
    for i, (_, _, cond) in enumerate(_FUNNEL):
        reason = F.when(cond(), i) if reason is None else reason.when(cond(), i)
    s = rollouts(spark, d).join(rewards(spark, d).drop("ingested_at"), "request_id", "left").select(reason.otherwise(len(_FUNNEL)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    # One row a stage: whoever reached stage s was still there at every stage up to it.
    return s.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s").cast("bigint"))).alias("stage"), "n").groupBy("stage").agg(F.sum("n").alias("n_left"))


@query(f"""with {ROLLOUTS}, {REWARDS} select coalesce(domain, '*') domain, coalesce(milestone_judge_status, '*') status, count(*) n, count(*) filter (where benchmark_overall_pass = 1) n_pass,
round(avg(score), 6) mean_score, round((count(*) filter (where milestone_tool_mapping_coverage >= 0.9))::double / nullif(count(milestone_tool_mapping_coverage), 0), 6) coverage_rate
from (select domain, coalesce(milestone_judge_status, 'none') milestone_judge_status, benchmark_overall_pass, score, milestone_tool_mapping_coverage from ro join re using (request_id))
group by grouping sets ((), (domain), (domain, milestone_judge_status))""")
def replay_report(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").withColumn("status", F.coalesce("milestone_judge_status", F.lit("none")))
    g = j.groupingSets([[], [F.col("domain")], [F.col("domain"), F.col("status")]], "domain", "status").agg(
        F.count("*").alias("n"), F.count_if(F.col("benchmark_overall_pass") == 1).alias("n_pass"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.try_divide(F.count_if(F.col("milestone_tool_mapping_coverage") >= 0.9).cast("double"), F.count("milestone_tool_mapping_coverage")), 6).alias("coverage_rate"),
    )
    return g.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("status", F.lit("*")).alias("status"), "n", "n_pass", "mean_score", "coverage_rate")


def turn_table(spark, d) -> DataFrame:
    """One row per model call of a rewarded rollout; a boundary is a turn that completes a state."""
    r = rollouts(spark, d).join(rewards(spark, d).drop("ingested_at"), "request_id").where("model_calls > 0 and score is not null and case_id is not null")
    ev = F.from_json("milestone_state_events_json", "array<struct<turn_index: int, state_ids: array<string>>>")
    r = r.select("request_id", "case_id", "domain", "score", "model_calls", F.transform(F.filter(ev, lambda e: F.size(e["state_ids"]) > 0), lambda e: e["turn_index"]).alias("done"))
    t = r.select("*", F.explode(F.sequence(F.lit(0), F.col("model_calls").cast("int") - 1)).alias("turn"))
    return t.withColumn("is_boundary", F.coalesce(F.array_contains("done", F.col("turn")).cast("int"), F.lit(0))).drop("done")


TURNS = f"""{ROLLOUTS}, {REWARDS},
tt as (
  select request_id, case_id, domain, score, model_calls, cast(t.turn as int) turn,
         coalesce(list_contains(list_transform(list_filter(from_json(milestone_state_events_json, '[{{"turn_index":"INTEGER","state_ids":["VARCHAR"]}}]'), lambda e: len(e.state_ids) > 0), lambda e: e.turn_index), t.turn)::int, 0) is_boundary
  from (select * exclude (ingested_at) from ro join (select * exclude (ingested_at, trace_id, iid) from re) using (request_id)), unnest(range(0, model_calls)) t(turn)
  where model_calls > 0 and score is not null and case_id is not null)"""


@query(f"""with {TURNS}, s as (select *, coalesce(sum(is_boundary) over (partition by request_id order by turn rows between unbounded preceding and 1 preceding), 0) segment_id,
min(case when is_boundary = 1 then turn end) over (partition by request_id order by turn rows between current row and unbounded following) - turn distance from tt)
select request_id, turn, cast(segment_id as bigint) segment_id, cast(distance as bigint) distance, round(case when distance is not null then 10 * pow(0.95, distance) else 0 end, 6) decayed_reward,
case when is_boundary = 1 then 'boundary' when distance is not null then 'backfill' else 'none' end "role" from s""")
def segment_credit_roles(spark, d):
    s = W.segments(turn_table(spark, d), ["request_id"], "turn", "is_boundary")
    return s.select("request_id", "turn", F.col("segment_id").cast("bigint").alias("segment_id"), F.col("distance").cast("bigint").alias("distance"), F.round("decayed_reward", 6).alias("decayed_reward"), "role")


@query(f"""with {TURNS}, s as (select *, coalesce(sum(is_boundary) over (partition by request_id order by turn rows between unbounded preceding and 1 preceding), 0) segment_id,
min(case when is_boundary = 1 then turn end) over (partition by request_id order by turn rows between current row and unbounded following) - turn distance from tt)
select case_id, cast(segment_id as bigint) segment_id, count(*) n_turns, count(distinct request_id) n_trajectories, round(avg(case when distance is not null then 10 * pow(0.95, distance) else 0 end), 9) segment_baseline from s group by 1, 2""")
def segment_baselines(spark, d):
    s = W.segments(turn_table(spark, d), ["request_id"], "turn", "is_boundary")
    return s.groupBy("case_id", F.col("segment_id").cast("bigint").alias("segment_id")).agg(
        F.count("*").alias("n_turns"), F.count_distinct("request_id").alias("n_trajectories"), F.round(F.avg("decayed_reward"), 9).alias("segment_baseline")
    )


def _credited(spark, d) -> DataFrame:
    """Turns with both group baselines and what their group reaches at the same boundary."""
    return credited(turn_table(spark, d), "case_id", "request_id", "turn", "is_boundary", "score")


CREDIT = f"""{TURNS}, oo as (select *, case when is_boundary = 1 then sum(is_boundary) over (partition by request_id order by turn) end ordinal from tt),
gr as (select case_id, avg(score) row_baseline from oo group by 1),
tr as (select case_id, avg(s) traj_baseline, count(*) n_traj from (select case_id, request_id, max(score) s from oo group by 1, 2) group by 1),
rc as (select case_id, ordinal, count(*) n_reach from oo where ordinal is not null group by 1, 2),
cr as (select oo.*, row_baseline, traj_baseline, n_traj, n_reach from oo join gr using (case_id) join tr using (case_id) left join rc on rc.case_id = oo.case_id and rc.ordinal = oo.ordinal)"""

_STD = "sqrt(n_reach * (n_traj - n_reach) / (n_traj * (n_traj - 1.0)))"


@query(f"""with {CREDIT} select request_id, turn, round(score - row_baseline, 9) + 0.0 outcome_adv, round(score - traj_baseline, 9) + 0.0 outcome_adv_by_trajectory,
round(case when is_boundary = 1 then 1 - n_reach / n_traj::double else 0 end, 9) + 0.0 local_adv,
round(case when is_boundary = 1 then (1 - n_reach / n_traj::double) / case when n_traj > 1 then {_STD} + 1e-6 else 1 end else 0 end, 9) + 0.0 local_adv_scaled,
round(score - row_baseline + 0.5 * case when is_boundary = 1 then 1 - n_reach / n_traj::double else 0 end, 9) + 0.0 total_adv from cr""")
def grpo_rollout_advantages(spark, d):
    c = _credited(spark, d)
    local = F.when(F.col("is_boundary") == 1, 1 - F.col("n_reach") / F.col("n_traj")).otherwise(F.lit(0.0))
    # Unbiased deviation of zeros and ones in closed form; the group pads missing boundaries with zeros.
    std = F.sqrt(F.col("n_reach") * (F.col("n_traj") - F.col("n_reach")) / (F.col("n_traj") * (F.col("n_traj") - F.lit(1.0))))
    scale = F.when(F.col("n_traj") > 1, std + 1e-6).otherwise(F.lit(1.0))
    out = F.col("score") - F.col("row_baseline")
    return c.select(
        "request_id", "turn", (F.round(out, 9) + 0.0).alias("outcome_adv"), (F.round(F.col("score") - F.col("traj_baseline"), 9) + 0.0).alias("outcome_adv_by_trajectory"), (F.round(local, 9) + 0.0).alias("local_adv"),
        (F.round(F.when(F.col("is_boundary") == 1, local / scale).otherwise(0.0), 9) + 0.0).alias("local_adv_scaled"), (F.round(out + 0.5 * local, 9) + 0.0).alias("total_adv"),
    )


@query(f"""with {CREDIT}, s as (select *, case when score - row_baseline > 1e-9 then 1 when score - row_baseline < -1e-9 then -1 else 0 end s_row, case when score - traj_baseline > 1e-9 then 1 when score - traj_baseline < -1e-9 then -1 else 0 end s_traj from cr)
select domain, count(*) n_turns, count(distinct request_id) n_trajectories, cast(count_if(s_row * s_traj < 0) as bigint) n_sign_flips, cast(count_if(turn < model_calls - 1) as bigint) n_non_final,
cast(count_if(is_boundary = 1) as bigint) n_boundaries, round(count(*)::double / count(distinct request_id), 6) fan_out from s group by 1""")
def misattribution_summary(spark, d):
    c = _credited(spark, d)
    sign = lambda x: F.when(x > 1e-9, 1).when(x < -1e-9, -1).otherwise(0)
    c = c.withColumn("_f", sign(F.col("score") - F.col("row_baseline")) * sign(F.col("score") - F.col("traj_baseline")) < 0)
    return c.groupBy("domain").agg(
        F.count("*").alias("n_turns"), F.count_distinct("request_id").alias("n_trajectories"), F.count_if("_f").alias("n_sign_flips"), F.count_if(F.col("turn") < F.col("model_calls") - 1).alias("n_non_final"),
        F.count_if(F.col("is_boundary") == 1).alias("n_boundaries"), F.round(F.count("*").cast("double") / F.count_distinct("request_id"), 6).alias("fan_out"),
    )


@query(f"with {ROLLOUTS}, {REWARDS} select round(score, 1) score_bucket, least(coalesce(model_calls, 0) // 5, 5) length_bucket, count(*) n, cast(sum(coalesce(model_calls, 0)) as bigint) n_calls from ro join re using (request_id) where score is not null group by 1, 2")
def score_length_buckets(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").where("score is not null").withColumn("c", F.coalesce("model_calls", F.lit(0)))
    return j.groupBy(F.round("score", 1).alias("score_bucket"), F.least(F.expr("c div 5"), F.lit(5)).alias("length_bucket")).agg(F.count("*").alias("n"), F.sum("c").alias("n_calls"))


@query(f"with {ROLLOUTS}, g as (select case_id, count(*) n from ro where case_id is not null group by 1) select n group_size, count(*) n_groups, n = (select n from g group by 1 order by count(*) desc, n desc limit 1) is_typical, n = 8 is_complete from g group by 1")
def group_sizes(spark, d):
    g = rollouts(spark, d).where("case_id is not null").groupBy("case_id").agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))
    best = g.agg(F.max_by("group_size", F.struct("n_groups", "group_size")).alias("_b"))
    return g.crossJoin(best).select("group_size", "n_groups", (F.col("group_size") == F.col("_b")).alias("is_typical"), (F.col("group_size") == 8).alias("is_complete"))  # one row


@query(f"""with {ROLLOUTS}, {REWARDS}, g as (select case_id, domain, count(*) n, sum(benchmark_overall_pass) k from ro join re using (request_id) where case_id is not null and benchmark_overall_pass is not null group by 1, 2)
select domain, count(*) n_cases, round(avg((k = 0 or k = n)::int), 6) unanimous_rate, round(avg(greatest(k, n - k) / n), 6) mean_agreement from g group by 1""")
def judge_consistency(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").where("case_id is not null and benchmark_overall_pass is not null")
    g = j.groupBy("case_id", "domain").agg(F.count("*").alias("n"), F.sum("benchmark_overall_pass").alias("k"))
    return g.groupBy("domain").agg(
        F.count("*").alias("n_cases"), F.round(F.avg(((F.col("k") == 0) | (F.col("k") == F.col("n"))).cast("int")), 6).alias("unanimous_rate"),
        F.round(F.avg(F.greatest(F.col("k"), F.col("n") - F.col("k")) / F.col("n")), 6).alias("mean_agreement"),
    )


@query(f"""with {ROLLOUTS}, c as (select request_id, model_calls, sum(model_calls) over (order by finished_us, request_id) upto from ro where model_calls > 0)
select request_id, model_calls, cast(upto as bigint) upto, cast((upto - 1) // 512 as bigint) step, upto % 512 = 0 is_aligned from c""")
def train_step_alignment(spark, d):
    r = rollouts(spark, d).where("model_calls > 0").select("request_id", "model_calls", "finished_us")
    return J.range_bucket(J.running_total(r, ["finished_us", "request_id"], "model_calls", "upto"), "upto", 512).select("request_id", "model_calls", "upto", "step", "is_aligned")


_D = ["d1", "d2", "d3", "d4", "d5"]
VERDICTS = f"""{ROLLOUTS}, {REWARDS}, vv as (select domain, case_id item_id, max(benchmark_d1_pass) > 0 v_before, max(benchmark_d4_pass) > 0 v_after, min(benchmark_d2_pass) > 0 v_c from ro join re using (request_id) where case_id is not null group by 1, 2)"""


def _verdicts(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").where("case_id is not null")
    return j.groupBy("domain", F.col("case_id").alias("item_id")).agg((F.max("benchmark_d1_pass") > 0).alias("v_before"), (F.max("benchmark_d4_pass") > 0).alias("v_after"), (F.min("benchmark_d2_pass") > 0).alias("v_c"))


PAIRED = f"""{VERDICTS}, pp as (select domain, count(*) n, count_if(v_c) passes_before, count_if(v_after) passes_after, count_if(not v_c and v_after) gains, count_if(v_c and not v_after) losses from vv where v_c is not null and v_after is not null group by 1),
mc as (select *, case when gains + losses = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2))) from range(0, cast(least(gains, losses) as int) + 1) t(i))) end p from pp)"""


@query(f"""with {PAIRED}, h as (select *, least(1.0, (count(*) over () - row_number() over (order by round(p, 12), domain) + 1) * p) s, row_number() over (order by round(p, 12), domain) k from mc)
select domain, n, cast(passes_before as bigint) passes_before, cast(passes_after as bigint) passes_after, cast(gains as bigint) gains, cast(losses as bigint) losses, round(100.0 * (passes_after - passes_before) / n, 6) delta_pp, round(p, 6) p, round(max(s) over (order by k), 6) p_holm from h""")
def paired_eval_mcnemar_holm(spark, d):
    p = A.paired_outcomes(_verdicts(spark, d), ["domain"], "v_c", "v_after").withColumn("p", A.mcnemar_exact(F.col("gains"), F.col("losses"))).withColumn("_pr", F.round("p", 12))
    h = A.holm(p, [], "_pr", "domain")
    return h.select("domain", "n", "passes_before", "passes_after", "gains", "losses", F.round(100.0 * (F.col("passes_after") - F.col("passes_before")) / F.col("n"), 6).alias("delta_pp"), F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(f"""with {PAIRED} select cast(sum(n) as bigint) n, round(100.0 * sum(passes_after) / sum(n), 6) micro_after, round(avg(100.0 * passes_after / n), 6) macro_after, round(avg(100.0 * (passes_after - passes_before) / n), 6) mean_delta_pp from mc""")
def micro_macro_average(spark, d):
    p = A.paired_outcomes(_verdicts(spark, d), ["domain"], "v_c", "v_after")
    return p.agg(
        F.sum("n").alias("n"), F.round(100.0 * F.sum("passes_after") / F.sum("n"), 6).alias("micro_after"), F.round(F.avg(100.0 * F.col("passes_after") / F.col("n")), 6).alias("macro_after"),
        F.round(F.avg(100.0 * (F.col("passes_after") - F.col("passes_before")) / F.col("n")), 6).alias("mean_delta_pp"),
    )


@query(f"""with {VERDICTS}, s as (select item_id, v_before v, 0 i from vv union all select item_id, v_c, 1 from vv union all select item_id, v_after, 2 from vv)
select item_id, arg_min(v, i * 2 + v::int) filter (where v is not null) verdict, count(distinct v) > 1 is_conflict from s group by 1""")
def verdict_merge(spark, d):
    v = _verdicts(spark, d)
    src = [v.select("item_id", F.col(c).alias("verdict")) for c in ("v_before", "v_c", "v_after")]
    return J.merge_by_precedence(src, ["item_id"], "verdict")


@query(f"""with {ROLLOUTS}, {REWARDS}, j as (select domain, milestone_judge_status = 'ok' pred, benchmark_overall_pass = 1 truth, case when model_calls > 15 then 'long' else 'short' end family from ro join re using (request_id) where benchmark_overall_pass is not null and milestone_judge_status is not null and model_calls is not null)
select domain, family, case grouping(domain, family) when 3 then '' when 1 then 'domain' else 'domain,family' end "level", cast(count_if(truth and pred) as bigint) tp, cast(count_if(not truth and pred) as bigint) fp, cast(count_if(truth and not pred) as bigint) fn,
round(coalesce(count_if(truth and pred) / nullif(count_if(pred), 0)::double, 1.0), 6) "precision", round(coalesce(count_if(truth and pred) / nullif(count_if(truth), 0)::double, 1.0), 6) recall from j group by grouping sets ((), (domain), (domain, family))""")
def precision_recall_sets(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").where("benchmark_overall_pass is not null and milestone_judge_status is not null and model_calls is not null")
    j = j.select("domain", (F.col("milestone_judge_status") == "ok").alias("pred"), (F.col("benchmark_overall_pass") == 1).alias("truth"), F.when(F.col("model_calls") > 15, "long").otherwise("short").alias("family"))
    return A.precision_recall(j, [[], ["domain"], ["domain", "family"]], "truth", "pred")


_STATE_ROWS = f"""{REWARDS}, st as (select re.request_id, e.turn_index turn, unnest(e.state_ids) state from re, unnest(from_json(milestone_state_events_json, '[{{"turn_index":"INTEGER","state_ids":["VARCHAR"]}}]')) t(e))"""


def state_rows(spark, d) -> DataFrame:
    ev = F.from_json("milestone_state_events_json", "array<struct<turn_index: int, state_ids: array<string>>>")
    return rewards(spark, d).select("request_id", F.explode(ev).alias("e")).select("request_id", F.col("e.turn_index").alias("turn"), F.explode("e.state_ids").alias("state"))


@query(f"""with {_STATE_ROWS}, s as (select distinct request_id, state from st), g as (select state, lag(state) over (order by state) parent from (select distinct state from s where state is not null)), p as (select a.state state_a, b.state state_b, count(*) n_units from s a join s b on a.request_id = b.request_id and a.state < b.state group by 1, 2)
select state_a, state_b, n_units, g.parent is not null is_dependent from p left join g on g.state = state_b and g.parent = state_a""")
def cofire_pairs(spark, d):
    """States that hold in the same request; here a state depends on the one before it in the order of names (a few states)."""
    s = state_rows(spark, d)
    names = s.select(F.col("state").alias("child")).where("child is not null").distinct()
    edges = names.withColumn("parent", F.lag("child").over(Window.orderBy("child"))).where("parent is not null")
    return A.cofire(s, ["request_id"], "state", edges)


@query(f"""with {_STATE_ROWS}, {ROLLOUTS}, v as (select case_id, request_id voter, state, min(turn) p from st join ro using (request_id) where case_id is not null group by 1, 2, 3),
n as (select case_id, count(distinct voter) n_voters from v group by 1), g as (select case_id, state, count(*) n_votes, list_sort(list(p))[count(*) // 2 + 1] position from v group by 1, 2)
select case_id, state, n_votes, n_voters, position from g join n using (case_id) where n_votes >= n_voters // 2 + 1""")
def consensus_vote(spark, d):
    v = state_rows(spark, d).join(rollouts(spark, d).select("request_id", "case_id").where("case_id is not null"), "request_id")
    return A.vote_consensus(v, ["case_id"], "request_id", "state", "turn")


@query(f"""with {ROLLOUTS}, {REWARDS}, c as (select case_id, milestone_judge_status l, count(*) n, case milestone_judge_status when 'error' then 2 when 'skipped' then 1 when 'ok' then 0 end s from ro join re using (request_id) where case_id is not null and milestone_judge_status is not null group by 1, 2)
select case_id, arg_max(l, n * 10 + s) consensus, max(n) n_for, cast(sum(n) as bigint) n_votes from c group by 1""")
def label_consensus(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").where("case_id is not null")
    return A.label_consensus(j, ["case_id"], "milestone_judge_status", {"ok": 0, "skipped": 1, "error": 2})


@query(f"""with {_STATE_ROWS}, f as (select request_id, state, min(turn) turn from st group by 1, 2) select f.request_id, f.state, f.turn from f
where not exists (select 1 from (values ('s2','s1'),('s3','s2')) e(child, parent) where e.child = f.state and not exists (select 1 from f g where g.request_id = f.request_id and g.state = e.parent and g.turn <= f.turn
  and not exists (select 1 from (values ('s2','s1')) e2(child, parent) where e2.child = g.state and not exists (select 1 from f h where h.request_id = g.request_id and h.state = e2.parent and h.turn <= g.turn))))""")
def approval_pruning(spark, d):
    from tracelake.operators.graphs import prune_to_fixpoint

    first = state_rows(spark, d).groupBy("request_id", "state").agg(F.min("turn").alias("turn"))
    edges = spark.createDataFrame([("s2", "s1"), ("s3", "s2")], "child string, parent string")
    return prune_to_fixpoint(first, edges, ["request_id"]).select("request_id", "state", "turn")


@query(f"""with {ROLLOUTS}, {REWARDS}, m as (select strftime(to_timestamp(finished_us / 1000000), '%Y-%m') run, domain, avg(score) s from ro join re using (request_id) where score is not null group by 1, 2)
select domain, count(*) n_runs, round(avg(s), 6) mean, round(stddev_samp(s), 6) std from m group by 1""")
def run_aggregation(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d), "request_id").where("score is not null")
    month = F.expr("date_format(convert_timezone(current_timezone(), 'UTC', cast(timestamp_micros(finished_us) as timestamp_ntz)), 'yyyy-MM')")
    m = j.groupBy(month.alias("run"), "domain").agg(F.avg("score").alias("s"))
    return m.groupBy("domain").agg(F.count("*").alias("n_runs"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_samp("s"), 6).alias("std"))


_GATES = [("pass_rate", "pass_rate", ">=", 0.2), ("coverage", "coverage", ">=", 0.5), ("errors", "error_rate", "<=", 0.05), ("volume", "n", ">=", 100.0), ("versions", "max_versions", "<=", 2.0)]
_GATE_SQL = " union all ".join(f"select '{n}' gate, round(cast({c} as double), 6) value, {c} {o} {t} is_met from k" for n, c, o, t in _GATES)


@query(f"""with {REWARDS}, k as (select avg(benchmark_overall_pass) pass_rate, avg(milestone_tool_mapping_coverage) coverage, avg((benchmark_judge_error is not null)::int) error_rate, count(*) n, max(n_versions) max_versions from re) {_GATE_SQL}""")
def acceptance_gates(spark, d):
    k = rewards(spark, d).agg(
        F.avg("benchmark_overall_pass").alias("pass_rate"), F.avg("milestone_tool_mapping_coverage").alias("coverage"), F.avg(F.col("benchmark_judge_error").isNotNull().cast("int")).alias("error_rate"),
        F.count("*").alias("n"), F.max("n_versions").alias("max_versions"),
    )
    rows = [F.struct(F.lit(n).alias("gate"), F.round(F.col(c).cast("double"), 6).alias("value"), (F.col(c) >= t if o == ">=" else F.col(c) <= t).alias("is_met")) for n, c, o, t in _GATES]
    return k.select(F.inline(F.array(*rows)))


@query("select request_id, case when benchmark_judge_error is not null and score is not null then 'score_despite_error' when score < 0 or score > 1 then 'score_out_of_range' end violation from rewards where (benchmark_judge_error is not null and score is not null) or score < 0 or score > 1")
def reward_expectations(spark, d):
    bad = F.when(F.col("benchmark_judge_error").isNotNull() & F.col("score").isNotNull(), "score_despite_error").when((F.col("score") < 0) | (F.col("score") > 1), "score_out_of_range")
    return table(spark, d, "rewards").select("request_id", bad.alias("violation")).where("violation is not null")


@query(f"""with {TURNS}, o as (select request_id, turn, model_calls, is_boundary, sum(is_boundary) over (partition by request_id order by turn) done from tt)
select request_id, turn, cast(done as bigint) n_completed, turn = model_calls - 1 is_final, is_boundary = 1 is_boundary, case when turn = model_calls - 1 then 1.0 else 0.0 end::double terminal_weight from o""")
def milestone_annotations(spark, d):
    t = turn_table(spark, d)
    done = W.segment_ends("is_boundary", ["request_id"], "turn")
    last = F.col("turn") == F.col("model_calls") - 1
    return t.select("request_id", "turn", done.cast("bigint").alias("n_completed"), last.alias("is_final"), (F.col("is_boundary") == 1).alias("is_boundary"), F.when(last, 1.0).otherwise(0.0).alias("terminal_weight"))


@query(f"""with {TURNS} select domain, round(sum(score * model_calls) / sum(model_calls), 6) by_turn, round(avg(score), 6) by_row from (select distinct request_id, domain, score, model_calls from tt) group by 1""")
def weighted_mean(spark, d):
    """Normalising by all supervised units is not the mean of means."""
    r = turn_table(spark, d).select("request_id", "domain", "score", "model_calls").distinct()
    return r.groupBy("domain").agg(F.round(F.sum(F.col("score") * F.col("model_calls")) / F.sum("model_calls"), 6).alias("by_turn"), F.round(F.avg("score"), 6).alias("by_row"))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
