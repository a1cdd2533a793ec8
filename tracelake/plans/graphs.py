"""Span forests, dependency graphs, overlays and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.operators import graphs as G
from tracelake.operators import joins as J
from tracelake.operators import selection as P
from tracelake.plans.common import CHATS, ROLLOUTS, chats, rollouts

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with recursive e as (select event_id id, case when event_id > 0 then event_id // 3 end parent, case when event_type = 'purchase' then user_id end own from events),
up as (select id, id at_, parent, own, 0 hops from e union all select up.id, e.id, e.parent, e.own, up.hops + 1 from up join e on up.parent = e.id where up.own is null and up.hops < 30)
select id, max(own) "owner", cast(min(case when own is not null then hops end) as bigint) hops from up group by 1""")
def owner_resolution(spark, d):
    """Nearest ancestor of type purchase in the forest parent = id div 3, at most 30 hops up."""
    e = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.expr("event_id div 3")).alias("parent"), F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("owner")
    )
    return J.resolve_owner(e, 30).select("id", "owner", F.col("hops").cast("bigint").alias("hops"))


@query("""select user_id, count(*) n, count(distinct event_type) n_types, round(sum(value), 4) total, round(max(value), 6) max_value, arg_max(event_id, (value, event_id)) last_of_max, cast(max(cast(json_extract_string(props, '$.k') as int)) as bigint) max_k from events group by 1""")
def span_session_rollup(spark, d):
    """Profile per session; among equal maxima the last row counts."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct("event_type").alias("n_types"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("max_value"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("last_of_max"), F.max(F.get_json_object("props", "$.k").try_cast("bigint")).alias("max_k"),
    )


_EDGES = "ed as (select distinct p_partkey child, p_partkey // 2 parent from part where p_partkey > 1 union select distinct p_partkey, p_partkey // 3 from part where p_partkey > 2), nd as (select distinct p_partkey node from part where p_partkey >= 1)"


def _edges(spark, d):
    p = table(spark, d, "part").select("p_partkey").where("p_partkey >= 1")
    e = p.where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent")).unionByName(p.where("p_partkey > 2").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent")))
    return e.distinct(), p.select(F.col("p_partkey").alias("node")).distinct()


@query(f"with recursive {_EDGES}, cl as (select child node, parent ancestor, 1 distance from ed union select cl.node, ed.parent, cl.distance + 1 from cl join ed on cl.ancestor = ed.child) select node, ancestor, cast(min(distance) as bigint) distance from cl group by 1, 2")
def dag_closure(spark, d):
    e, _ = _edges(spark, d)
    return G.closure(e).select("node", "ancestor", F.col("distance").cast("bigint").alias("distance"))


@query(f"with {_EDGES} select node from nd where node not in (select parent from ed)")
def dag_sinks(spark, d):
    e, n = _edges(spark, d)
    return G.sinks(n, e)


@query(f"with {_EDGES} select child, parent from ed where parent not in (select node from nd)")
def dag_unknown_dependencies(spark, d):
    e, n = _edges(spark, d)
    return G.unknown_dependencies(n, e)


@query(f"with recursive {_EDGES}, e2 as (select * from ed union select 7, 29), cl as (select child node, parent ancestor from e2 union select cl.node, e2.parent from cl join e2 on cl.ancestor = e2.child) select distinct node from cl where node = ancestor")
def dag_cycles(spark, d):
    e, _ = _edges(spark, d)
    return G.cyclic_nodes(e.unionByName(spark.createDataFrame([(7, 29)], "child bigint, parent bigint")))


@query(f"with recursive {_EDGES}, w as (select child, parent from ed union select w.child, ed.parent from w join ed on w.parent = ed.child where w.parent % 5 = 0) select child, parent from w where parent % 5 <> 0 and child % 5 <> 0 and parent in (select node from nd)")
def dag_effective_parents(spark, d):
    """Dependencies with every node divisible by five hidden."""
    e, n = _edges(spark, d)
    return G.effective_parents(e, n.where("node % 5 <> 0"))


@query(f"with recursive {_EDGES}, l as (select node, 0 lv from nd union select ed.child, l.lv + 1 from l join ed on ed.parent = l.node) select node, cast(max(lv) as bigint) \"level\" from l where node in (select node from nd) group by 1")
def dag_levels(spark, d):
    e, n = _edges(spark, d)
    return G.levels(n, e).select("node", F.col("level").cast("bigint").alias("level"))


@query(f"with recursive {_EDGES}, dn as (select 9::bigint node union select ed.child from dn join ed on ed.parent = dn.node) select node from nd where node not in (select node from dn)")
def dag_branch(spark, d):
    """What is left of the graph without one node and all that depends on it."""
    e, n = _edges(spark, d)
    return G.without_descendants(n, e, spark.createDataFrame([(9,)], "node bigint"))


@query(f"""with {_EDGES}, i as (select node, case when node % 4 = 0 then unnest(['a', 'b']) end res from nd where node % 4 = 0 union all select node, null from nd where node % 4 <> 0), n as (select node, case when res is null then node::varchar else node::varchar || '@' || res end inst from i)
select distinct c.inst child, p.inst parent from ed join n c on c.node = ed.child join n p on p.node = ed.parent""")
def dag_fan_out(spark, d):
    """Every fourth node becomes two instances; dependencies are rewired to all instances."""
    e, n = _edges(spark, d)
    inst = n.where("node % 4 = 0").select("node", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("resource"))
    return G.fan_out(n, e, inst)[1]


@query(f"with {_EDGES} select distinct case when child = 12 then 'new' else child::varchar end child, parent::varchar parent from ed union select '12', 'new'")
def dag_insert_node(spark, d):
    e, _ = _edges(spark, d)
    return G.insert_before(e.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")), "12", "new")


_OV = """cu as (select p_partkey k, p_brand brand, p_size size, case p_partkey % 3 when 0 then 'free' when 1 then 'shared' else 'kept' end m from part where p_size <= 30 qualify row_number() over (partition by p_partkey order by p_name) = 1),
pr as (select p_partkey k, 'X-' || p_brand brand, p_size + 1 size from part where p_size >= 15 qualify row_number() over (partition by p_partkey order by p_name) = 1)"""


def _versions(spark, d):
    one = lambda cond: table(spark, d, "part").where(cond).groupBy(F.col("p_partkey").alias("k")).agg(F.min_by(F.struct("p_brand", "p_size"), "p_name").alias("r"))
    m = F.when(F.col("k") % 3 == 0, "free").when(F.col("k") % 3 == 1, "shared").otherwise("kept")
    cu = one("p_size <= 30").select("k", F.col("r.p_brand").alias("brand"), F.col("r.p_size").alias("size"), m.alias("m"))
    return cu, one("p_size >= 15").select("k", F.concat(F.lit("X-"), "r.p_brand").alias("brand"), (F.col("r.p_size") + 1).alias("size"))


@query(f"""with {_OV}, j as (select coalesce(cu.k, pr.k) k, cu.k ck, pr.k pk, cu.brand cb, pr.brand pb, cu.size cs, pr.size ps, m from cu full join pr on cu.k = pr.k)
select k, case when pk is not null and (ck is null or m = 'free') then pb else cb end brand, case when pk is not null and (ck is null or m in ('free', 'shared')) then ps else cs end size from j where ck is null or m <> 'free' or pk is not null""")
def protected_overlay(spark, d):
    cu, pr = _versions(spark, d)
    return P.overlay(cu, pr, "k", ["brand"], "m")


@query(f"""with {_OV} select coalesce(cu.k, pr.k) k, case when cu.k is null then 'added' when pr.k is null then 'removed' else 'changed' end change from cu full join pr on cu.k = pr.k where cu.k is null or pr.k is null or cu.brand <> pr.brand or cu.size <> pr.size""")
def version_changes(spark, d):
    cu, pr = _versions(spark, d)
    return P.changed_rows(cu.drop("m"), pr, "k")


@query(f"with {ROLLOUTS}, n as (select request_id, row_number() over (order by finished_us, request_id) - 1 n from ro) select request_id, cast(n // 64 as bigint) batch, cast(n % 64 as bigint) position from n")
def audit_batches(spark, d):
    return P.batches(rollouts(spark, d).select("request_id", "finished_us"), ["finished_us", "request_id"], 64).select("request_id", "batch", "position")


@query()
def prompt_cards(spark, d):
    """Greedy choice of up to eight cards a domain."""
    r = rollouts(spark, d).where("case_id is not null and domain is not null").select("domain", "case_id", F.concat_ws("-", F.coalesce("model_calls", F.lit(0)) % 5, F.substring("case_id", -1, 1)).alias("signature"), "request_id")
    return P.greedy_cards(r, "domain", "case_id", "signature", "request_id", 8)


@query("select epoch_us(time_bucket(interval '1 day', started_at, timestamptz '2000-01-01 00:00:00+00')) // 1000000 day_s, successful, count(distinct event_id) n from tool_events group by 1, 2")
def stream_daily_counts(spark, d):
    """Daily counts of a stream: deliveries are deduplicated within a week, and only that week's keys are held as state.

    What the stream has let through is a table, which is counted; so no day waits for a watermark to pass.
    """
    from tracelake.streaming import events as E

    s = E.read_events(spark, f"{d}/tool_events.parquet*").select("event_id", "started_at", "successful").where("started_at is not null")
    once = E.run_available(E.deduplicated(s, "event_id", "started_at", "7 days"), "daily")
    day = F.window("started_at", "1 day")
    return once.groupBy(day.alias("w"), "successful").agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start")).alias("day_s"), "successful", "n")


@query(f"with {CHATS}, w as (select record_id, content from ch where msg_role = 'user' and content is not null) select record_id, len(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda x: x in ('please', 'find', 'open', 'share', 'move'))) n_verbs, regexp_matches(lower(content), '^(yes|ok|okay|sure|confirm(ed)?|go ahead)[.! ]*$') is_confirmed, regexp_matches(lower(content), '^(no|stop|cancel|don.t)\\b') is_rejected from w")
def intent_flags(spark, d):
    c = chats(spark, d, "content").where("msg_role = 'user' and content is not null")
    words = F.split(F.lower("content"), "[^a-z]+")
    return c.select(
        "record_id", F.size(F.filter(words, lambda x: x.isin("please", "find", "open", "share", "move"))).cast("bigint").alias("n_verbs"),
        F.lower("content").rlike(r"^(yes|ok|okay|sure|confirm(ed)?|go ahead)[.! ]*$").alias("is_confirmed"), F.lower("content").rlike(r"^(no|stop|cancel|don.t)\b").alias("is_rejected"),
    )


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
