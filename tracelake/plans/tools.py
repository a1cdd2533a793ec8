"""Tool events: names, order, matching of events and slots, profiles, and verification of state graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators import aggregates as A
from tracelake.operators import graphs as G
from tracelake.operators import joins as J
from tracelake.operators import sets as S
from tracelake.plans.common import EVENTS, ROLLOUTS, events, rollouts

Q: dict = {}
SQL: dict[str, str] = {}
ORDER = ["started_us", "event_id"]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {EVENTS} select tool, count(*) n, count(distinct tool_name) n_spellings, cast(count_if(successful) as bigint) n_ok from ev group by 1")
def tool_usage(spark, d):
    return events(spark, d).groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("tool_name").alias("n_spellings"), F.count_if("successful").alias("n_ok"))


@query(f"with {EVENTS}, l as (select tool, lead(tool) over (partition by request_id order by started_us, event_id) nxt from ev) select tool, nxt next_tool, count(*) n from l where nxt is not null group by 1, 2")
def tool_bigrams(spark, d):
    nxt = F.lead("tool").over(Window.partitionBy("request_id").orderBy(*ORDER))
    return events(spark, d).select("tool", nxt.alias("next_tool")).where("next_tool is not null").groupBy("tool", "next_tool").agg(F.count("*").alias("n"))


@query(f"with {EVENTS} select first_tool, last_tool, count(*) n from (select request_id, arg_min(tool, (started_us, event_id)) first_tool, arg_max(tool, (started_us, event_id)) last_tool from ev group by 1) group by 1, 2")
def entry_exit_tools(spark, d):
    o = F.struct(*ORDER)
    return events(spark, d).groupBy("request_id").agg(F.min_by("tool", o).alias("first_tool"), F.max_by("tool", o).alias("last_tool")).groupBy("first_tool", "last_tool").agg(F.count("*").alias("n"))


@query(f"with {EVENTS} select request_id, n_events, n_tools from (select request_id, cast(sum(n) as bigint) n_events, count(*) n_tools, max(n) m from (select request_id, tool, count(*) n from ev group by 1, 2) group by 1) where m <= 2")
def redundant_call_filter(spark, d):
    c = events(spark, d).groupBy("request_id", "tool").agg(F.count("*").alias("n"))
    return c.groupBy("request_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_tools"), F.max("n").alias("m")).where("m <= 2").drop("m")


_CHAIN = "actual_outcome.sandbox_execution_chain"


@query(f"""with {EVENTS}, a as (select request_id, tool, event_id, row_number() over (partition by request_id, tool order by started_us, event_id) k from ev where event_origin <> '{_CHAIN}'),
b as (select request_id, tool, event_id slot_id, row_number() over (partition by request_id, tool order by started_us, event_id) k from ev where event_origin = '{_CHAIN}')
select a.request_id, a.tool, a.event_id, slot_id, k ordinal from a left join b using (request_id, tool, k)""")
def tool_slot_match(spark, d):
    e = events(spark, d)
    a = e.where(F.col("event_origin") != _CHAIN).select("request_id", "tool", "event_id", "started_us")
    b = e.where(F.col("event_origin") == _CHAIN).select("request_id", "tool", F.col("event_id").alias("slot_id"), F.col("started_us").alias("slot_us"))
    m = J.ordinal_join(a, b, ["request_id", "tool"], ["started_us", "event_id"], ["slot_us", "slot_id"])
    return m.select("request_id", "tool", "event_id", "slot_id", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"""with {EVENTS}, w as (select *, last_value(cast(event_index as bigint) ignore nulls) over (partition by request_id, event_origin order by started_us, event_id rows between unbounded preceding and current row) b,
first_value(cast(event_index as bigint) ignore nulls) over (partition by request_id, event_origin order by started_us, event_id rows between current row and unbounded following) a, max(cast(event_index as bigint)) over (partition by request_id) m from ev)
select request_id, event_id, case when event_origin <> '{_CHAIN}' then cast(event_index as bigint) else coalesce(b, a, m) end anchor from w""")
def anchor_turn_asof(spark, d):
    e = events(spark, d).withColumn("event_index", F.col("event_index").cast("bigint"))
    return J.anchor_asof(e, ["request_id"], "event_origin", ORDER, "event_index", F.col("event_origin") != _CHAIN).select("request_id", "event_id", "anchor")


@query(f"""with {EVENTS}, u as (select *, row_number() over (partition by request_id, tool, args, response order by (event_origin = '{_CHAIN}')::int, started_us, event_id) k from ev where args is not null and response is not null)
select request_id, tool, event_id, (event_origin = '{_CHAIN}')::int source_index from u where k = 1""")
def event_union_dedupe(spark, d):
    e = events(spark, d, "args", "response").where("args is not null and response is not null").withColumn("fp", F.sha2(F.concat_ws("\0", "args", "response"), 256))
    e = e.select("request_id", "tool", "fp", "event_id", "started_us", "event_origin")
    u = S.union_first([e.where(F.col("event_origin") != _CHAIN), e.where(F.col("event_origin") == _CHAIN)], ["request_id", "tool", "fp"], ORDER)
    return u.select("request_id", "tool", "event_id", "source_index")


@query(r"""select event_id, bool_or(coalesce(json_extract_string(case when json_valid(response) then response end, '$.error') is not null, false) or coalesce(regexp_matches(response, '^\s*(?:http\s+[45]\d\d|error\b|exception\b|traceback\b|timed? ?out\b)', 'i'), false)) is_error from tool_events group by 1""")
def error_responses(spark, d):
    from tracelake.core import table

    return table(spark, d, "tool_events").groupBy("event_id").agg(F.bool_or(X.looks_like_error(F.col("response"))).alias("is_error"))


@query(f"""with {EVENTS}, c as (select request_id, count(*) n from ev group by 1), b as (select case when n <= 0 then '0' when n <= 5 then '1-5' when n <= 10 then '6-10' when n <= 20 then '11-20' else '21+' end bin, min(n) lo, count(*) n_requests from c group by 1)
select bin, n_requests, round(100.0 * sum(n_requests) over (order by lo) / sum(n_requests) over (), 6) cumulative_pct from b""")
def call_count_bins(spark, d):
    c = events(spark, d).groupBy("request_id").agg(F.count("*").alias("n"))
    b = c.groupBy(A.binned(F.col("n"), [0, 5, 10, 20]).alias("bin")).agg(F.min("n").alias("lo"), F.count("*").alias("n_requests"))
    return b.select("bin", "n_requests", F.round(100.0 * F.sum("n_requests").over(Window.orderBy("lo")) / F.sum("n_requests").over(Window.partitionBy()), 6).alias("cumulative_pct"))  # five rows


@query(f"with {EVENTS}, c as (select request_id, count(*) n_calls from ev group by 1) select n_calls, count(*) n_requests from c group by 1")
def call_histogram(spark, d):
    return events(spark, d).groupBy("request_id").agg(F.count("*").alias("n_calls")).groupBy("n_calls").agg(F.count("*").alias("n_requests"))


_LAT = f"{EVENTS}, la as (select tool, (ended_us - started_us) // 1000 ms from ev where ended_us is not null)"


def _latency(spark, d):
    return events(spark, d).where("ended_us is not null").select("tool", F.expr("(ended_us - started_us) div 1000").alias("ms"))


@query(f"with {_LAT}, s as (select tool, list_sort(list(ms)) v, count(*) n, min(ms) min_value, max(ms) max_value, sum(ms) t from la group by 1) select tool, n, {', '.join(f'v[least(n - 1, n * {p} // 100) + 1] p{p}' for p in (50, 90, 99))}, min_value, max_value, cast(t as bigint) total from s")
def latency_quantiles_upper(spark, d):
    return A.quantiles_upper(_latency(spark, d), ["tool"], "ms")


@query(f"with {_LAT}, s as (select tool, list_sort(list(ms)) v, count(*) n, min(ms) min_value, max(ms) max_value, sum(ms) t from la group by 1) select tool, n, {', '.join(f'v[(n - 1) * {p} // 100 + 1] p{p}' for p in (50, 90, 99))}, min_value, max_value, cast(t as bigint) total, round(t / n, 6) mean from s")
def latency_quantiles_lower(spark, d):
    return A.quantiles_lower(_latency(spark, d), ["tool"], "ms").withColumn("mean", F.round(F.col("total") / F.col("n"), 6))


@query(f"with {_LAT} select tool, count(*) n, {', '.join(f'round(quantile_cont(ms, {p / 100}), 3) p{p}, cast(trunc(quantile_cont(ms, {p / 100})) as bigint) p{p}_int' for p in (50, 90, 99))} from la group by 1")
def latency_quantiles_linear(spark, d):
    q = A.quantiles_linear(_latency(spark, d), ["tool"], "ms")
    return q.select("tool", "n", *[c for p in (50, 90, 99) for c in (F.round(f"p{p}", 3).alias(f"p{p}"), F.col(f"p{p}").cast("bigint").alias(f"p{p}_int"))])


@query(f"""with {EVENTS}, {ROLLOUTS}, t as (select request_id, count(*) n_events, count(distinct tool) n_tools, count_if(not successful) n_failed, max(event_index) max_index, max(ended_us) - min(started_us) span, list_sort(list(distinct tool)) tools, bool_or(tool = 'grant_access') shares from ev group by 1)
select case_id, count(*) n_requests, cast(sum(n_events) as bigint) n_events, cast(sum(n_failed) as bigint) n_failed, cast(max(max_index) as bigint) max_index, bool_or(shares) any_share, array_to_string(list_sort(list_distinct(flatten(list(tools)))), ',') tools from t join ro using (request_id) where case_id is not null group by 1""")
def session_rollup(spark, d):
    t = events(spark, d).groupBy("request_id").agg(
        F.count("*").alias("n_events"), F.count_if(~F.col("successful")).alias("n_failed"), F.max("event_index").alias("max_index"), F.collect_set("tool").alias("tools"), F.bool_or(F.col("tool") == "grant_access").alias("shares")
    )  # a set of tool names is as small as the catalog
    j = t.join(rollouts(spark, d).select("request_id", "case_id").where("case_id is not null"), "request_id")
    tools = j.select("case_id", F.explode("tools").alias("tool")).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"))
    s = j.groupBy("case_id").agg(F.count("*").alias("n_requests"), F.sum("n_events").alias("n_events"), F.sum("n_failed").alias("n_failed"), F.max("max_index").cast("bigint").alias("max_index"), F.bool_or("shares").alias("any_share"))
    return s.join(tools, "case_id")


_RULES = [("^(doc|sheet|deck)_", "content"), ("^(file|folder)_", "storage"), ("^mail_", "mail"), ("_access$", "sharing")]


@query(f"""with {EVENTS} select request_id, {', '.join(f"cast(count_if(f = '{x}') as bigint) n_{x}" for x in ('content', 'storage', 'mail', 'sharing', 'other'))},
case when count_if(f = 'sharing') > 0 then 'sharing' when count_if(f = 'content') > 0 then 'content' when count_if(f <> 'other') > 0 then 'lookup' else 'none' end form
from (select request_id, case {' '.join(f"when regexp_matches(tool, '{p}') then '{x}'" for p, x in _RULES)} else 'other' end f from ev) group by 1""")
def form_classification(spark, d):
    f = events(spark, d).select("request_id", X.first_family(F.col("tool"), _RULES, "other").alias("f"))
    g = f.groupBy("request_id").agg(*[F.count_if(F.col("f") == x).alias(f"n_{x}") for x in ("content", "storage", "mail", "sharing", "other")])
    form = F.when(F.col("n_sharing") > 0, "sharing").when(F.col("n_content") > 0, "content").when(F.col("n_storage") + F.col("n_mail") > 0, "lookup").otherwise("none")
    return g.withColumn("form", form)


@query(f"with {EVENTS} select tool, tool glob 'doc_*' or tool glob '*_access' or tool = 'note_add' is_mutation, tool glob 's?eet_[fp]*' is_sheet, count(*) n from ev group by all")
def glob_predicates(spark, d):
    t = F.col("tool")
    return events(spark, d).groupBy("tool", X.matches_any(t, ["doc_*", "*_access", "note_add"]).alias("is_mutation"), X.matches_any(t, ["s?eet_[fp]*"]).alias("is_sheet")).agg(F.count("*").alias("n"))


@query(f"with {EVENTS}, t as (select distinct request_id, tool from ev), n as (select count(distinct request_id) t from ev) select d.tool, count(t.request_id) n_records, cast(coalesce(any_value(c.k), 0) as bigint) n_calls, round(100.0 * count(t.request_id) / any_value(n.t), 4) pct from (select unnest(['doc_patch', 'note_add', 'mail_scan', 'never_used']) tool) d left join t on t.tool = d.tool left join (select tool, count(*) k from ev group by 1) c on c.tool = d.tool, n group by 1")
def tool_coverage(spark, d):
    dim = spark.createDataFrame([("doc_patch",), ("note_add",), ("mail_scan",), ("never_used",)], "tool string")
    return A.coverage(events(spark, d).select("request_id", "tool"), dim, "request_id", "tool")


@query(f"with {EVENTS}, f as (select request_id, bool_or(tool = 'file_find') a, bool_or(tool = 'doc_patch') b from ev group by 1) select case when a and b then 'both' when a then 'find_only' when b then 'patch_only' else 'neither' end cell, count(*) n from f group by 1")
def cooccurrence_2x2(spark, d):
    f = events(spark, d).groupBy("request_id").agg(F.bool_or(F.col("tool") == "file_find").alias("a"), F.bool_or(F.col("tool") == "doc_patch").alias("b"))
    cell = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "find_only").when(F.col("b"), "patch_only").otherwise("neither")
    return f.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


#: Configuration of a small graph of states for the verifier queries.
STATES = [
    {"id": "located", "depends_on": [], "pattern": "^(file_find|folder_list|mail_scan)$", "min_count": 1},
    {"id": "read", "depends_on": ["located"], "pattern": "^(file_open|sheet_peek|deck_outline)$", "min_count": 1},
    {"id": "changed", "depends_on": ["read"], "pattern": "^(doc_patch|sheet_fill|note_add)$", "min_count": 2},
    {"id": "shared", "depends_on": ["read"], "pattern": "^grant_access$", "min_count": 1},
    {"id": "finished", "depends_on": ["changed", "shared"], "pattern": "^(file_open|note_add)$", "min_count": 1},
]
_TURNS = f"{EVENTS}, te as (select request_id, tool, successful ok, row_number() over (partition by request_id order by started_us, event_id) - 1 turn from ev)"


def _state_sql() -> str:
    parts, seen = [f"with {_TURNS}"], []
    for s in STATES:
        deps = s["depends_on"]
        ready = "select distinct request_id, 0::bigint ready from te" if not deps else f"select request_id, max(turn) ready from ({' union all '.join(f'select * from st_{p}' for p in deps)}) group by 1 having count(*) = {len(deps)}"
        parts.append(f"st_{s['id']} as (select request_id, '{s['id']}' state, cast(turn as bigint) turn from (select te.request_id, turn, row_number() over (partition by te.request_id order by turn, tool) k from te join ({ready}) r using (request_id) where ok and regexp_matches(tool, '{s['pattern']}') and turn >= ready) where k = {s['min_count']})")
        seen.append(f"select * from st_{s['id']}")
    return ",\n".join(parts) + "\n" + " union all ".join(seen)


def _turns(spark, d):
    e = events(spark, d)
    return e.select("request_id", "tool", F.col("successful").alias("ok"), (F.row_number().over(Window.partitionBy("request_id").orderBy(*ORDER)) - 1).alias("turn"))


@query(_state_sql())
def milestone_first_turns(spark, d):
    return G.verify_states(_turns(spark, d), STATES, ["request_id"]).select("request_id", "state", "turn")


@query(f"""with {_TURNS}, c as (select request_id, {', '.join(f"count_if(ok and regexp_matches(tool, '{s['pattern']}')) >= {s['min_count']} {s['id']}" for s in STATES)} from te group by 1),
p as (select request_id, located, located and read as read_, located and read and changed changed_, located and read and shared shared_, located and read and changed and shared and finished finished_ from c)
select request_id, unnest(['located', 'read', 'changed', 'shared', 'finished']) state, unnest([located, read_, changed_, shared_, finished_]) is_passed from p""")
def milestone_replay(spark, d):
    return G.replay_states(_turns(spark, d), STATES, ["request_id"])


@query(f"with {EVENTS}, {ROLLOUTS} select side, key from (select 'left' side, request_id key from ro where request_id not in (select request_id from ev) union all select 'right', request_id from (select distinct request_id from ev) where request_id not in (select request_id from ro))")
def key_set_equality(spark, d):
    a, b = rollouts(spark, d).select(F.col("request_id").alias("key")), events(spark, d).select(F.col("request_id").alias("key"))
    return J.set_difference_report(a, b, "key").select("side", "key")


@query(f"""with {EVENTS}, g as (select request_id, count(*) n, count(*) filter (where event_index is null) n_without_index, count(event_index) c, count(distinct event_index) u from ev group by 1)
select request_id, n, n_without_index, case when n_without_index > 0 then 'index_missing' else 'index_repeated' end violation from g where n_without_index > 0 or c <> u""")
def event_index_expectations(spark, d):
    g = events(spark, d).groupBy("request_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_index").isNull()).alias("n_without_index"), F.count("event_index").alias("c"), F.count_distinct("event_index").alias("u")
    )
    return g.select("request_id", "n", "n_without_index", F.when(F.col("n_without_index") > 0, "index_missing").when(F.col("c") != F.col("u"), "index_repeated").alias("violation")).where("violation is not null")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
