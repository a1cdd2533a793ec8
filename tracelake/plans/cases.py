"""Cases: splits, samples, top-k choices, tags, coverage and selectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.operators import aggregates as A
from tracelake.operators import sampling as S
from tracelake.operators import sets as U
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


_CA = "ca as (select case_id, coalesce(metadata.skill_domain, regexp_extract(case_id, '^([a-z]+)-', 1)) stratum, coalesce(metadata.difficulty, 'none') difficulty, metadata.tags tags, dataset_name, created_at, try_cast(regexp_extract(case_id, '([0-9]+)$', 1) as bigint) position from dataset_cases)"


def cases(spark, d):
    c = table(spark, d, "dataset_cases")
    return c.select(
        "case_id", F.coalesce("metadata.skill_domain", F.regexp_extract("case_id", "^([a-z]+)-", 1)).alias("stratum"), F.coalesce("metadata.difficulty", F.lit("none")).alias("difficulty"),
        F.col("metadata.tags").alias("tags"), "dataset_name", F.regexp_extract("case_id", "([0-9]+)$", 1).try_cast("bigint").alias("position"),
    )


@query(f"""with {_CA}, h as (select stratum, case_id, sha256('seed-7' || chr(0) || stratum || chr(0) || case_id) h from ca), k as (select *, row_number() over (partition by stratum order by h, case_id) r, count(*) over (partition by stratum) n from h)
select stratum, case_id, case when n > 1 and r <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) then 'holdout' else 'proposal' end split from k""")
def stable_split_2way(spark, d):
    return S.stable_split(cases(spark, d), "stratum", "case_id", "seed-7", 0.2)


@query(f"""with {_CA}, x as (select stratum || '/' || difficulty s, case_id from ca), h as (select s, case_id, sha256('seed-9' || chr(0) || s || chr(0) || case_id) h from x), k as (select *, row_number() over (partition by s order by h, case_id) r, count(*) over (partition by s) n, first_value(h) over (partition by s order by h, case_id) fh from h),
t as (select *, greatest(1, least(n - 2, round_even(n * 0.1, 0))) t from k), v as (select *, greatest(1, least(n - t - 1, round_even(n * 0.15, 0))) v from t)
select s, case_id, case when n = 1 then 'proposal' when n = 2 then case when r = 1 then case when ord(fh[1]) % 2 = case when fh[1] >= 'a' then 0 else 1 end then 'test' else 'dev' end else 'proposal' end when r <= t then 'test' when r <= t + v then 'dev' else 'proposal' end split from v""")
def stable_split_3way(spark, d):
    c = cases(spark, d).select(F.concat_ws("/", "stratum", "difficulty").alias("s"), "case_id")
    return S.stable_three_way(c, "s", "case_id", "seed-9", 0.1, 0.15)


_PR = f"{ROLLOUTS}, {REWARDS}, jj as (select ro.request_id, case_id, domain, coalesce(score, -1) score, coalesce(benchmark_overall_pass, 0) = 1 passed, coalesce(model_calls, 0) calls from ro join re using (request_id) where case_id is not null)"


def judged(spark, d):
    j = rollouts(spark, d).join(rewards(spark, d).drop("ingested_at"), "request_id").where("case_id is not null")
    return j.select("request_id", "case_id", "domain", F.coalesce("score", F.lit(-1.0)).alias("score"), (F.coalesce("benchmark_overall_pass", F.lit(0.0)) == 1).alias("passed"), F.coalesce("model_calls", F.lit(0)).alias("calls"))


@query(f"with {_PR}, r as (select *, row_number() over (partition by case_id order by request_id) - 1 k from jj) select case_id, request_id, k \"rank\" from r order by k, case_id limit 100")
def round_robin_sample(spark, d):
    return S.round_robin(judged(spark, d).select("case_id", "request_id"), "case_id", ["request_id"], 100).select("case_id", "request_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""with {_PR}, w as (select *, row_number() over (partition by case_id, passed order by score desc, request_id) k from jj), s as (select *, row_number() over (partition by case_id order by case when k = 1 then case when passed then 0 else 1 end else 2 end, score desc, request_id) slot from w)
select case_id, request_id, passed, slot from s where slot <= 3""")
def outcome_diverse_sample(spark, d):
    o = S.outcome_diverse(judged(spark, d), "case_id", "passed", [F.desc("score"), F.asc("request_id")], 3)
    return o.select("case_id", "request_id", "passed", F.col("slot").cast("bigint").alias("slot"))


@query(f"""with {_PR}, f as (select *, row_number() over (partition by case_id, passed order by score desc, request_id) k from jj), s as (select *, row_number() over (partition by case_id order by case when k = 1 then case when passed then 0 else 1 end else 2 end, score desc, request_id) slot from f),
t as (select * from s where slot <= 2), r as (select *, row_number() over (partition by domain, case_id order by slot) - 1 g from t), o as (select *, row_number() over (partition by domain order by g, case_id) n from r) select domain, case_id, request_id, n from o where n <= 12""")
def evaluation_composition(spark, d):
    """Outcome-diverse rows per case, then round robin over the cases of each domain."""
    o = S.outcome_diverse(judged(spark, d), "case_id", "passed", [F.desc("score"), F.asc("request_id")], 2)
    from pyspark.sql import Window

    g = o.withColumn("g", F.row_number().over(Window.partitionBy("domain", "case_id").orderBy("slot")) - 1)
    return S.top_k(g, ["domain"], [F.asc("g"), F.asc("case_id")], 12).select("domain", "case_id", "request_id", F.col("rank").cast("bigint").alias("n"))


@query(f"with {_PR} select domain, request_id, k from (select *, row_number() over (partition by domain order by passed desc, score desc, calls desc, request_id) k from jj) where k <= 5")
def quota_topk(spark, d):
    return S.top_k(judged(spark, d), ["domain"], [F.desc("passed"), F.desc("score"), F.desc("calls"), F.asc("request_id")], 5).select("domain", "request_id", F.col("rank").cast("bigint").alias("k"))


@query(f"""with {_CA}, k as (select *, row_number() over (partition by difficulty order by case_id) k from ca) select case_id, difficulty, k > 2 is_topup from k order by k > 2, k, difficulty, case_id limit 12""")
def regression_anchors(spark, d):
    return S.anchors(cases(spark, d), "difficulty", [F.asc("case_id")], 2, 12).select("case_id", "difficulty", "is_topup")


@query(f"with {_CA} select case_id from ca where cast('0x' || substr(sha256('k11' || chr(0) || case_id), 1, 8) as bigint) % 10 = 0")
def hash_mod_sample(spark, d):
    return S.hash_sample(cases(spark, d), "case_id", "k11", 10).select("case_id")


@query(f"with {_CA} select case_id, sha256('epoch-1' || chr(0) || case_id) order_key from ca")
def shuffled_epoch(spark, d):
    return S.epoch_order(cases(spark, d).select("case_id"), "case_id", "epoch-1")


@query(f"with {_CA}, {ROLLOUTS}, o as (select case_id, min(position) p from ca group by 1), r as (select distinct ro.case_id, o.p from ro left join o using (case_id) where ro.case_id is not null) select case_id, row_number() over (order by p nulls last, case_id) case_rank from r")
def case_ordering(spark, d):
    from tracelake.operators.joins import running_total

    c = cases(spark, d).groupBy("case_id").agg(F.min("position").alias("p"))
    r = rollouts(spark, d).where("case_id is not null").select("case_id").distinct().join(c, "case_id", "left")
    r = r.withColumn("_k", F.coalesce("p", F.lit(2**62))).withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(r, ["_k", "case_id"], "_one", "case_rank").select("case_id", "case_rank")


@query(f"with {_CA}, t as (select count(distinct case_id) t from ca), e as (select distinct case_id, unnest(tags) label from ca) select label, count(*) n, round(100.0 * count(*) / any_value(t), 6) pct from e, t group by 1")
def tag_distribution(spark, d):
    return A.multilabel_distribution(cases(spark, d), "case_id", "tags")


@query(f"with {_CA} select difficulty, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 6) pct from ca group by 1")
def difficulty_distribution(spark, d):
    return A.distribution(cases(spark, d), "difficulty")


@query("select count(*) n, count(distinct case_id) n_cases, count(distinct author_id) n_authors, count(distinct origin_trace_id) n_traces, count(distinct dataset_name) n_datasets from dataset_cases")
def distinct_counts(spark, d):
    c = table(spark, d, "dataset_cases")
    return c.agg(F.count("*").alias("n"), *[F.count_distinct(x).alias(n) for x, n in (("case_id", "n_cases"), ("author_id", "n_authors"), ("origin_trace_id", "n_traces"), ("dataset_name", "n_datasets"))])


@query(f"with {_CA} select case_id, coalesce(len(tags), 0) > 0 has_tags, greatest(coalesce(len(tags), 0) - 2, 0) n_dropped, array_to_string(tags[1:2], ',') head, case when tags is not null then array_to_string(list_concat(tags[1:1], tags[-1:]), ',') end head_tail from ca")
def capped_lists(spark, d):
    """Lists capped at their first two items, and at first and last; how many items were dropped."""
    n = F.coalesce(F.size("tags"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    last = F.when(F.size("tags") > 0, F.slice("tags", -1, 1)).otherwise(F.col("tags"))
    return cases(spark, d).select("case_id", (n > 0).alias("has_tags"), F.greatest(n - 2, F.lit(0)).cast("bigint").alias("n_dropped"), F.array_join(F.slice("tags", 1, 2), ",").alias("head"), F.array_join(F.concat(F.slice("tags", 1, 1), last), ",").alias("head_tail"))


@query("""with c as (select case_id, case_input.question question, coalesce(metadata.skill_domain, 'general') "domain" from dataset_cases where not coalesce(case_input.multi_turn, false) and case_id is not null)
select case_id, question, "domain" from c""")
def loaded_cases(spark, d):
    """Cases of a single turn with their domain; a case id that comes twice is an error."""
    from tracelake.sources.readers import load_cases

    return load_cases(table(spark, d, "dataset_cases")).select("case_id", "question", "domain")


@query(f"""with {ROLLOUTS}, i as (select iid, count(distinct request_id) n_requests from tool_events where iid is not null group by 1)
select request_id, ro.iid, n_requests, case when ro.iid is null then 'no_key' when i.iid is null then 'no_instance' end error from ro left join i on i.iid = ro.iid""")
def instance_join(spark, d):
    """Rollouts with the instance of their iid; a row without one carries an error instead of being dropped."""
    from tracelake.operators.joins import with_instance

    i = table(spark, d, "tool_events").where("iid is not null").groupBy("iid").agg(F.count_distinct("request_id").alias("n_requests"))
    return with_instance(rollouts(spark, d).select("request_id", "iid"), i, "iid")


@query(f"""with {_CA}, a as (select distinct unnest(tags) t from ca where stratum = 'docs'), b as (select distinct unnest(tags) t from ca where stratum = 'drive'), j as (select a.t a, b.t b from a full join b on a.t = b.t where a.t is not null or b.t is not null)
select count(a) n_left, count(b) n_right, count(*) filter (where a is not null and b is not null) n_both, count(*) filter (where a is not null and b is not null) = 0 is_disjoint, count(*) filter (where a is not null and b is not null) = count(a) is_subset, count(*) filter (where a is not null and b is not null) = count(a) and count(a) = count(b) is_equal from j""")
def tag_set_relation(spark, d):
    e = cases(spark, d).select("stratum", F.explode("tags").alias("t")).where("t is not null")
    return U.set_relation(e.where("stratum = 'docs'").select("t"), e.where("stratum = 'drive'").select("t"), "t")


@query(f"with {_CA} select stratum, count(*) n_cases, count(*) filter (where list_has_any(tags, ['share', 'format'])) n_overlap, count(*) filter (where len(list_filter(tags, lambda x: x not in ('read', 'write'))) > 0) n_other from ca group by 1")
def tag_overlap(spark, d):
    c = cases(spark, d)
    return c.groupBy("stratum").agg(
        F.count("*").alias("n_cases"), F.count_if(F.arrays_overlap("tags", F.array(F.lit("share"), F.lit("format")))).alias("n_overlap"), F.count_if(F.size(F.array_except("tags", F.array(F.lit("read"), F.lit("write")))) > 0).alias("n_other")
    )


@query(f"with {_CA}, {_PR} select stratum family, count(distinct ca.case_id) n_cases, count(jj.request_id) n_rollouts, count(*) filter (where jj.passed) n_passed from ca left join jj on jj.case_id = ca.case_id group by 1")
def family_statistics(spark, d):
    j = cases(spark, d).select("case_id", F.col("stratum").alias("family")).join(judged(spark, d).select("case_id", "request_id", "passed"), "case_id", "left")
    return j.groupBy("family").agg(F.count_distinct("case_id").alias("n_cases"), F.count("request_id").alias("n_rollouts"), F.count_if("passed").alias("n_passed"))


@query(f"with {_PR} select case_id, case when passed then 'verified' else 'negative' end status, request_id, row_number() over (partition by case_id, passed order by request_id) position from jj")
def verified_manifest(spark, d):
    """Ids of verified and failed rollouts of each case, one a row, so that a case of any size stays spread."""
    from pyspark.sql import Window

    j = judged(spark, d)
    pos = F.row_number().over(Window.partitionBy("case_id", "passed").orderBy("request_id"))
    return j.select("case_id", F.when(F.col("passed"), "verified").otherwise("negative").alias("status"), "request_id", pos.cast("bigint").alias("position"))


@query("select case_id, seed, regexp_replace(regexp_replace(lower(seed), '\\.[a-z0-9]{1,5}$', ''), '[^a-z0-9]+', '', 'g') \"key\" from (select case_id, unnest(seed_files) seed from dataset_cases)")
def resource_names(spark, d):
    from tracelake.functions.text import resource_key

    c = table(spark, d, "dataset_cases").select("case_id", F.explode("seed_files").alias("seed"))
    return c.select("case_id", "seed", resource_key(F.col("seed")).alias("key"))


@query("""with r as (select request_id, lower(question) q, seed_summary from rollouts qualify row_number() over (partition by request_id order by ingested_at) = 1), f as (select request_id, q, unnest(from_json(seed_summary::json->'drive_files', '[{"filename":"VARCHAR"}]')).filename f from r),
t as (select request_id, f, case when contains(q, lower(f)) then 0 when contains(regexp_replace(q, '[^a-z0-9]+', '', 'g'), regexp_replace(regexp_replace(lower(f), '\\.[a-z0-9]{1,5}$', ''), '[^a-z0-9]+', '', 'g')) then 1 when contains(q, split_part(lower(f), '_', 1)) then 2 else 3 end tier from f where f is not null)
select request_id, min(tier) tier, count(*) n_files, count(*) filter (where tier < 3) n_matched from t group by 1""")
def resource_match_cascade(spark, d):
    """Seed files named in the question: exactly, without punctuation, by their first word, or not at all."""
    from tracelake.core import delivered_once

    r = delivered_once(table(spark, d, "rollouts").select("request_id", "question", "seed_summary", "ingested_at"), "request_id")
    files = F.from_json(F.get_json_object("seed_summary", "$.drive_files"), "array<struct<filename: string>>")
    e = r.select("request_id", F.lower("question").alias("q"), F.explode(files).alias("x")).select("request_id", "q", F.lower("x.filename").alias("f")).where("f is not null")
    loose = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    tier = (
        F.when(F.contains("q", "f"), 0).when(F.contains(loose("q"), loose(F.regexp_replace("f", r"\.[a-z0-9]{1,5}$", ""))), 1)
        .when(F.contains("q", F.split_part("f", F.lit("_"), F.lit(1))), 2).otherwise(3)
    )
    t = e.withColumn("tier", tier)
    return t.groupBy("request_id").agg(F.min("tier").alias("tier"), F.count("*").alias("n_files"), F.count_if(F.col("tier") < 3).alias("n_matched"))


def parse_checkpoints(expression: str, available: list[int]) -> list[int]:
    """``all``, a list ``1,5`` or inclusive ranges ``10-20``; everything asked for must be available."""
    if expression.strip() == "all":
        return sorted(set(available))
    out: set[int] = set()
    for part in expression.split(","):
        lo, _, hi = part.strip().partition("-")
        wanted = {int(lo)} if not hi else {x for x in available if int(lo) <= x <= int(hi)}
        if not wanted or wanted - set(available):
            raise ValueError(f"not available: {part.strip()}")
        out |= wanted
    return sorted(out)


@query(f"with {_CA} select case_id, position from ca where position = 3 or position between 10 and 20 or position = 50")
def checkpoint_selector(spark, d):
    picks = parse_checkpoints("3,10-20,50", list(range(0, 1001)))
    return cases(spark, d).where(F.col("position").isin(picks)).select("case_id", "position")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
