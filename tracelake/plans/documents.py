"""Documents and logs: fingerprints, multiset differences, training logs and their series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.functions import hashing as H
from tracelake.operators import sets as U
from tracelake.operators import windows as W
from tracelake.sources.readers import parse_training_log

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with b as (select sha256(text) fp, count(*) n from documents where doc_kind is not null group by 1), a as (select sha256(text) fp, count(*) n from documents where source <> 'train-log' group by 1),
j as (select coalesce(b.fp, a.fp) fp, coalesce(b.n, 0) n_before, coalesce(a.n, 0) n_after from b full join a on b.fp = a.fp) select fp, n_before, n_after, greatest(n_before - n_after, 0) removed, greatest(n_after - n_before, 0) added from j where n_before <> n_after""")
def multiset_diff(spark, d):
    """Documents of a known kind against documents outside the training log, copies counted on both sides."""
    t = table(spark, d, "documents").select("source", "doc_kind", F.sha2("text", 256).alias("fp"))
    m = U.multiset_diff(t.where("doc_kind is not null").select("fp"), t.where("source <> 'train-log'").select("fp"), "fp")
    return m.select("fp", "n_before", "n_after", "removed", "added")


@query("select sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) fp, min(doc_id) doc_id, count(*) n_copies, count(distinct source) n_sources from documents where text is not null group by 1")
def doc_exact_dedupe(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256).alias("fp"))
    return t.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.count_distinct("source").alias("n_sources"))


@query("select doc_id, md5(coalesce(title, '') || coalesce(text, '')) assistant_md5, substr(sha256(coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 20) card_id from documents")
def row_fingerprints(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", H.texts_md5(F.array("title", "text")).alias("assistant_md5"), H.short_id(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("card_id"))


@query("with r as (select md5(text) m from documents where doc_kind = 'heading') select doc_id from documents where md5(text) not in (select m from r where m is not null)")
def fingerprint_removal(spark, d):
    t = table(spark, d, "documents").select("doc_id", "doc_kind", F.md5("text").alias("m"))
    return t.join(t.where("doc_kind = 'heading'").select("m").distinct(), "m", "left_anti").where("m is not null").select("doc_id")


@query("""with e as (select event_id, args::json a from tool_events where args is not null), o as (select distinct event_id, a->>'file_id' f, a->>'page' p from e) select event_id, sha256('{"file_id":' || case when f is null then 'null' else '"' || f || '"' end || ',"page":' || case when p is null then 'null' else '"' || p || '"' end || '}') canonical from o""")
def canonical_json_hash(spark, d):
    t = table(spark, d, "tool_events").where("args is not null").select("event_id", F.get_json_object("args", "$.file_id").alias("f"), F.get_json_object("args", "$.page").alias("p")).distinct()
    q = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"')))
    # Written with the keys in the other order; the hash does not see it.
    return t.select("event_id", H.canonical_json_sha(F.concat(F.lit('{"page": '), q("p"), F.lit(', "file_id": '), q("f"), F.lit("}"))).alias("canonical"))


@query("select coalesce(source, '') source, sha256(array_to_string(list_sort(list_distinct(list(coalesce(doc_kind, 'none')))), chr(0))) fingerprint from documents group by 1")
def set_fingerprints(spark, d):
    kinds = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("doc_kind", F.lit("none")).alias("k")).distinct()
    return kinds.groupBy("source").agg(H.set_fingerprint(F.collect_list("k")).alias("fingerprint"))  # the few kinds of a source


_LOG = r"""ll as (select doc_id, unnest(string_split(text, chr(10))) line from documents where source = 'train-log'),
lg as (select doc_id, cast(regexp_extract(line, 'iteration\s+(\d+)\s*/', 1) as bigint) step, cast(regexp_extract(line, 'iteration\s+\d+\s*/\s*(\d+)', 1) as bigint) planned_steps, cast(regexp_extract(line, 'consumed samples:\s*(\d+)', 1) as bigint) consumed, cast(regexp_extract(line, 'lm loss:\s*([-+0-9.]+(?:[eE][-+]?\d+)?)', 1) as double) loss,
cast(nullif(regexp_extract(line, 'grad norm:\s*([-+0-9.]+(?:[eE][-+]?\d+)?)', 1), '') as double) grad_norm, cast(nullif(regexp_extract(line, 'skipped iterations:\s*(\d+)', 1), '') as bigint) skipped, cast(nullif(regexp_extract(line, 'nan iterations:\s*(\d+)', 1), '') as bigint) nan_ from ll where regexp_matches(line, 'iteration\s+\d+\s*/\s*\d+.*consumed samples:\s*\d+.*lm loss:\s*[0-9.]+E[-+]\d+'))"""


def log_rows(spark, d):
    lines = table(spark, d, "documents").where("source = 'train-log'").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return parse_training_log(lines.where(F.col("value").rlike(r"iteration\s+\d+\s*/\s*\d+.*consumed samples:\s*\d+.*lm loss:\s*[0-9.]+E[-+]\d+")))


@query(f"with {_LOG} select doc_id, step, planned_steps, consumed, loss, grad_norm, skipped, nan_ \"nan\", round(consumed / 1000.0, 6) epoch from lg")
def training_log_series(spark, d):
    return log_rows(spark, d).select("doc_id", "step", "planned_steps", "consumed", "loss", "grad_norm", "skipped", "nan", F.round(F.col("consumed") / 1000.0, 6).alias("epoch"))


@query(f"with {_LOG}, u as (select distinct * from lg) select doc_id, count(*) n, round(avg(loss), 9) mean_loss, round(median(loss), 9) median_loss, arg_min(loss, step * 1000 + planned_steps) first_loss, arg_max(loss, step * 1000 + planned_steps) last_loss, max(grad_norm) max_grad, count(*) filter (where grad_norm > 10) n_over_10, round((count(*) filter (where grad_norm > 10))::double / count(*), 9) share_over_10 from u group by 1")
def training_summary(spark, d):
    o = F.col("step") * 1000 + F.col("planned_steps")
    return log_rows(spark, d).distinct().groupBy("doc_id").agg(
        F.count("*").alias("n"), F.round(F.avg("loss"), 9).alias("mean_loss"), F.round(F.median("loss"), 9).alias("median_loss"), F.min_by("loss", o).alias("first_loss"), F.max_by("loss", o).alias("last_loss"),
        F.max("grad_norm").alias("max_grad"), F.count_if(F.col("grad_norm") > 10).alias("n_over_10"), F.round(F.count_if(F.col("grad_norm") > 10).cast("double") / F.count("*"), 9).alias("share_over_10"),
    )


@query(f"with {_LOG}, l as (select doc_id, step, step - lag(step) over (partition by doc_id order by step, planned_steps) g from lg) select doc_id, count(*) n_steps, count(*) filter (where g <> 1) n_breaks from l group by 1")
def contiguous_steps(spark, d):
    from pyspark.sql import Window

    g = F.col("step") - F.lag("step").over(Window.partitionBy("doc_id").orderBy("step", "planned_steps"))
    return log_rows(spark, d).withColumn("g", g).groupBy("doc_id").agg(F.count("*").alias("n_steps"), F.count_if(F.col("g") != 1).alias("n_breaks"))


@query(f"""with {_LOG}, u as (select doc_id, step, min(loss) loss from lg group by 1, 2) select doc_id, step, round(median(loss) over (partition by doc_id order by step rows between 7 preceding and 7 following), 9) rolling_median, round(avg(loss) over (partition by doc_id order by step rows between 9 preceding and current row), 9) rolling_mean from u""")
def rolling_smooth(spark, d):
    u = log_rows(spark, d).groupBy("doc_id", "step").agg(F.min("loss").alias("loss"))
    return W.rolling(u, ["doc_id"], "step", "loss").select("doc_id", "step", F.round("rolling_median", 9).alias("rolling_median"), F.round("rolling_mean", 9).alias("rolling_mean"))


@query(f"with {_LOG}, s as (select distinct doc_id, step from lg where grad_norm > 20) select a.doc_id, a.step, b.step again from s a join s b on a.doc_id = b.doc_id and b.step between a.step + 2 and a.step + 4")
def spike_recurrence(spark, d):
    s = log_rows(spark, d).where("grad_norm > 20").select("doc_id", "step").distinct()
    return W.recurrences(s, ["doc_id"], "step", 3)


@query("select doc_id, case when source is null then 'no_source' when coalesce(length(text), 0) < 40 then 'short' when source in ('old-import', 'pilot-forms') then 'source' when doc_kind is null then 'no_kind' else 'kept' end reason from documents")
def mining_filter(spark, d):
    t = table(spark, d, "documents")
    reason = F.when(F.col("source").isNull(), "no_source").when(F.coalesce(F.length("text"), F.lit(0)) < 40, "short").when(F.col("source").isin("old-import", "pilot-forms"), "source").when(F.col("doc_kind").isNull(), "no_kind").otherwise("kept")
    return t.select("doc_id", reason.alias("reason"))


@query("with d as (select case_id, doc_id, length(text) n, created_at from documents where case_id is not null) select case_id, arg_max(doc_id, (created_at, doc_id)) doc_id, arg_max(n, (created_at, doc_id)) n_chars, count(*) n_calls from d group by 1")
def last_call_harvest(spark, d):
    t = table(spark, d, "documents").where("case_id is not null")
    o = F.struct("created_at", "doc_id")
    return t.groupBy("case_id").agg(F.max_by("doc_id", o).alias("doc_id"), F.max_by(F.length("text").cast("bigint"), o).alias("n_chars"), F.count("*").alias("n_calls"))


@query("with n as (select coalesce(lang, 'none') lang, doc_kind, count(*) n from documents group by 1, 2) select lang, doc_kind, n, round(100.0 * n / sum(n) over (partition by lang), 6) pct from n where doc_kind is not null".replace("from n where doc_kind is not null", "from n"))
def kind_by_language(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_kind").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
