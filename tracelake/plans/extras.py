"""Call statistics, credit comparison, runs with provenance, record expansion and request shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.operators import aggregates as A
from tracelake.operators import selection as P
from tracelake.operators import windows as W
from tracelake.plans.common import CHATS, EVENTS, REWARDS, ROLLOUTS, chats, events, rewards, rollouts
from tracelake.plans.rewards import TURNS, turn_table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {ROLLOUTS}, s as (select domain, list_sort(list(model_calls)) v, count(*) n, sum(model_calls) t from ro where model_calls is not null group by 1) select domain, n, v[(n - 1) * 50 // 100 + 1] p50, v[(n - 1) * 90 // 100 + 1] p90, v[1] min_value, v[-1] max_value, cast(t as bigint) total, round(t / n, 6) mean from s")
def model_call_stats(spark, d):
    q = A.quantiles_lower(rollouts(spark, d).where("model_calls is not null").select("domain", "model_calls"), ["domain"], "model_calls")
    return q.select("domain", "n", "p50", "p90", "min_value", "max_value", "total", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query(f"""with {TURNS}, s as (select *, min(case when is_boundary = 1 then turn end) over (partition by request_id order by turn rows between current row and unbounded following) - turn distance from tt),
r as (select domain, case when is_boundary = 1 then 'boundary' when distance is not null then 'backfill' else 'none' end "role", score >= 0.8 good from s)
select domain, "role", count(*) n, count(*) filter (where good) n_good, round((count(*) filter (where good)) / count(*)::double, 6) "precision", round((count(*) filter (where good)) / nullif(sum(count(*) filter (where good)) over (partition by domain), 0)::double, 6) recall from r group by 1, 2""")
def credit_role_comparison(spark, d):
    s = W.segments(turn_table(spark, d), ["request_id"], "turn", "is_boundary")
    g = s.groupBy("domain", "role").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.8).alias("n_good"))
    whole = F.sum("n_good").over(Window.partitionBy("domain"))  # three rows a domain
    return g.select("domain", "role", "n", "n_good", F.round(F.col("n_good") / F.col("n"), 6).alias("precision"), F.round(F.try_divide(F.col("n_good"), whole), 6).alias("recall"))


@query("""with u as (select 0 run_index, request_id, score from rewards where score >= 0.5 union all select 1, request_id, score from rewards where score < 0.5 or score is null)
select request_id, count(*) n_rows, count(distinct run_index) n_runs, min(run_index) first_run, count(distinct run_index) > 1 is_duplicate from u group by 1""")
def run_union_provenance(spark, d):
    r = table(spark, d, "rewards").select("request_id", "score")
    u = r.where("score >= 0.5").withColumn("run_index", F.lit(0)).unionByName(r.where("score < 0.5 or score is null").withColumn("run_index", F.lit(1)))
    g = u.groupBy("request_id").agg(F.count("*").alias("n_rows"), F.count_distinct("run_index").alias("n_runs"), F.min("run_index").alias("first_run"))
    return g.withColumn("is_duplicate", F.col("n_runs") > 1)


@query(f"""with {CHATS}, c as (select record_id, msg_pos, msg_role, md5(coalesce(content, '')) m from ch), a as (select record_id, msg_pos, row_number() over (partition by record_id order by msg_pos) call_index, lead(msg_pos) over (partition by record_id order by msg_pos) nxt from c where msg_role = 'assistant'),
n as (select a.record_id, a.call_index, count(*) n_context, sum(('0x' || substr(m, 1, 7))::bigint) fp from a join c on c.record_id = a.record_id and c.msg_pos < a.msg_pos group by 1, 2)
select a.record_id, a.call_index, coalesce(n_context, 0) n_context, cast(coalesce(fp, 0) as bigint) context_key, a.nxt is null is_last from a left join n using (record_id, call_index)""")
def model_call_expansion(spark, d):
    """One row per model call with the size and a running key of the context before it; a context extends the
    one before it, so its key only adds to it."""
    w = Window.partitionBy("record_id").orderBy("msg_pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    part = F.conv(F.substring(F.md5(F.coalesce("content", F.lit(""))), 1, 7), 16, 10).cast("bigint")
    c = chats(spark, d, "content").withColumn("_k", part)
    c = c.withColumn("n_context", F.row_number().over(w) - 1).withColumn("context_key", F.coalesce(F.sum("_k").over(before), F.lit(0))).where("msg_role = 'assistant'")
    return c.select(
        "record_id", F.row_number().over(w).cast("bigint").alias("call_index"), F.col("n_context").cast("bigint").alias("n_context"), "context_key", F.lead("msg_pos").over(w).isNull().alias("is_last")
    )


@query(f"""with {CHATS}, c as (select message_id, content from ch where msg_role = 'tool_call' and coalesce(json_valid(content), false)) select message_id, content->>'$.name' "name", '{{"type":"function","function":{{"name":"' || (content->>'$.name') || '"}}}}' wrapped, json_exists(content, '$.arguments') has_arguments from c""")
def tool_call_wrapping(spark, d):
    """Calls in the wrapped form that renderers expect; already wrapped ones stay."""
    c = chats(spark, d, "content").where("msg_role = 'tool_call'").where(F.try_parse_json("content").isNotNull())
    name = F.coalesce(F.get_json_object("content", "$.function.name"), F.get_json_object("content", "$.name"))
    wrapped = F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name")).alias("function")))
    return c.select("message_id", name.alias("name"), wrapped.alias("wrapped"), F.get_json_object("content", "$.arguments").isNotNull().alias("has_arguments"))


@query(f"""with {ROLLOUTS}, {REWARDS}, {EVENTS}, e as (select request_id, count(*) k, count(distinct tool) u from ev group by 1), j as (select domain, benchmark_overall_pass = 1 p, k, u from ro join re using (request_id) left join e using (request_id))
select domain, count(*) attempts, count(*) filter (where p) passed, count(*) filter (where p and k > 0) harvested, count(*) filter (where p and k > 0 and k <= 3 * u) clean from j group by 1""")
def harvest_funnel(spark, d):
    k = events(spark, d).groupBy("request_id").agg(F.count("*").alias("k"), F.count_distinct("tool").alias("u"))
    j = rollouts(spark, d).join(rewards(spark, d).drop("ingested_at"), "request_id").join(k, "request_id", "left")
    p, h = F.col("benchmark_overall_pass") == 1, F.col("k") > 0
    return j.groupBy("domain").agg(F.count("*").alias("attempts"), F.count_if(p).alias("passed"), F.count_if(p & h).alias("harvested"), F.count_if(p & h & (F.col("k") <= 3 * F.col("u"))).alias("clean"))


@query("select coalesce(metadata.difficulty, 'none') subtype, count(*) n, count(*) filter (where len(coalesce(seed_files, [])) > 0) n_immutable, greatest(0, 6 - count(*) filter (where len(coalesce(seed_files, [])) > 0)) budget from dataset_cases group by 1")
def state_budgets(spark, d):
    c = table(spark, d, "dataset_cases").select(F.coalesce("metadata.difficulty", F.lit("none")).alias("subtype"), (F.size(F.coalesce("seed_files", F.array())) > 0).alias("f"))
    g = c.groupBy("subtype").agg(F.count("*").alias("n"), F.count_if("f").alias("n_immutable"))
    return g.withColumn("budget", F.greatest(F.lit(0).cast("bigint"), 6 - F.col("n_immutable")))


@query(f"with {CHATS}, t as (select record_id, msg_pos, content from ch where msg_role = 'system') select record_id, msg_pos, starts_with(content, lag(content) over (partition by record_id order by msg_pos)) or lag(content) over (partition by record_id order by msg_pos) is null is_extension from t")
def prefix_check(spark, d):
    return P.prefix_compatible(chats(spark, d, "content").where("msg_role = 'system'"), ["record_id"], "msg_pos", "content").select("record_id", "msg_pos", "is_extension")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
