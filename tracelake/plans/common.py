"""Clean views of the test tables, in Spark and in SQL: each delivery once, keys in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.core import delivered_once, table
from tracelake.functions.text import tool_name
from tracelake.operators.joins import first_present, last_wins


def rollouts(spark, d) -> DataFrame:
    r = table(spark, d, "rollouts").select("request_id", "trace_id", "iid", "case_id", "domain", "model_calls", "training_samples", "finished_at", "ingested_at")
    r = delivered_once(r, "request_id")
    key = first_present(F.col("case_id"), F.regexp_extract("iid", r"^benchmark-[^:]*:(.+)$", 1))
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), r"^benchmark-[^:]*:\s*", ""), r"[\s_]+", "-")
    return r.withColumn("case_id", key).withColumn("domain", F.lower(F.trim("domain"))).withColumn("model_calls", F.col("model_calls").cast("bigint")).withColumn("finished_us", F.unix_micros("finished_at"))


def rewards(spark, d) -> DataFrame:
    """Latest reward of each request, with its number of versions."""
    r = table(spark, d, "rewards").select(
        "request_id", "score", "benchmark_overall_pass", *[f"benchmark_d{i}_pass" for i in range(1, 6)], "milestone_state_events_json", "benchmark_judge_error", "milestone_judge_status",
        "milestone_tool_mapping_coverage", "ingested_at",
    )
    return last_wins(r, "request_id", ["ingested_at"])


def events(spark, d, *extra: str) -> DataFrame:
    e = table(spark, d, "tool_events").select("event_id", "request_id", "event_index", "tool_name", "event_origin", "successful", "started_at", "ended_at", "ingested_at", *extra)
    e = delivered_once(e, "event_id")
    return e.withColumn("tool", tool_name(F.col("tool_name"))).withColumn("started_us", F.unix_micros("started_at")).withColumn("ended_us", F.unix_micros("ended_at"))


def chats(spark, d, *texts: Column | str) -> DataFrame:
    """Messages once each, with the columns of ``texts``; the content itself goes through the shuffle only where it is asked for."""
    c = table(spark, d, "chat_messages").select("message_id", "record_id", "msg_pos", "msg_role", "loss", "tool_call_id", "provider_id", "ingested_at", *texts)
    return delivered_once(c, "message_id")


def n_chars(name: str = "n_chars") -> Column:
    """Length of a message's content, 0 for none."""
    return F.coalesce(F.length("content"), F.lit(0)).alias(name)


ROLLOUTS = r"""
ro as (
  select request_id, trace_id, iid, training_samples, ingested_at, cast(model_calls as bigint) model_calls, lower(trim(domain)) "domain", epoch_us(finished_at) finished_us,
         regexp_replace(regexp_replace(lower(trim(coalesce(nullif(trim(case_id), ''), nullif(trim(regexp_extract(iid, '^benchmark-[^:]*:(.+)$', 1)), '')))), '^benchmark-[^:]*:\s*', ''), '[\s_]+', '-', 'g') case_id
  from rollouts qualify row_number() over (partition by request_id order by ingested_at) = 1)"""
REWARDS = """
re as (
  select *, count(*) over (partition by request_id) n_versions from rewards
  qualify row_number() over (partition by request_id order by ingested_at desc) = 1)"""
EVENTS = r"""
ev as (
  select *, epoch_us(started_at) started_us, epoch_us(ended_at) ended_us,
         regexp_replace(regexp_replace(regexp_replace(lower(trim(tool_name)), '^(?:proxy\.|workspace\.)+', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') tool
  from tool_events qualify row_number() over (partition by event_id order by ingested_at) = 1)"""
CHATS = """
ch as (select * from chat_messages qualify row_number() over (partition by message_id order by ingested_at) = 1)"""
