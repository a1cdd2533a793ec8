"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tracelake.core import table
from tracelake.llm import chunking, leaks, packing, pairs, pii, repeats, splits, truncation
from tracelake.plans.common import ROLLOUTS


def _p1_found(spark, d):
    return pairs.found(table(spark, d, "rollouts"))


def _p1_judged(spark, d):
    return pairs.judge_pairs(table(spark, d, "rollouts"))


def _p2_found(spark, d):
    return repeats.found(table(spark, d, "tool_events"))


def _p2_collapsed(spark, d):
    return repeats.collapse_repeats(table(spark, d, "tool_events"))


def _p2_kept(spark, d):
    return repeats.kept_events(_p2_collapsed(spark, d))


def _p3_found(spark, d):
    return chunking.found(table(spark, d, "chat_messages"), table(spark, d, "seq_providers"))


def _p3_pieces(spark, d):
    return chunking.split_oversized(table(spark, d, "chat_messages"), table(spark, d, "seq_providers"))


def _p3_reassembled(spark, d):
    return chunking.reassembled(_p3_pieces(spark, d))


def _p4_found(spark, d):
    return splits.tied_pairs(table(spark, d, "dataset_cases"))


def _p4_components(spark, d):
    return splits.component_members(table(spark, d, "dataset_cases"))


def _p4_assignment(spark, d):
    return splits.assign_splits(table(spark, d, "rollouts"), table(spark, d, "dataset_cases"))


def _p4_component_records(spark, d):
    return splits.component_records(_p4_assignment(spark, d))


def _p4_shares(spark, d):
    return splits.split_report(_p4_assignment(spark, d))


def _p5_found(spark, d):
    return pii.found(table(spark, d, "chat_messages"), table(spark, d, "tool_events"))


def _p5_redacted(spark, d):
    return pii.redacted(table(spark, d, "chat_messages"), table(spark, d, "tool_events"))


def _p6_filling(spark, d):
    return packing.fill_windows(table(spark, d, "documents"), table(spark, d, "seq_providers"))


def _p6_windows(spark, d):
    return packing.windows(_p6_filling(spark, d))


def _p6_faults(spark, d):
    return packing.filling_faults(_p6_filling(spark, d))


def _p6_report(spark, d):
    return packing.window_report(_p6_filling(spark, d))


def _p7_found(spark, d):
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p7_report(spark, d):
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p7_reparameterised(spark, d):
    return leaks.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p8_found(spark, d):
    return truncation.found(table(spark, d, "documents"))


def _p8_rates(spark, d):
    return truncation.rates(table(spark, d, "documents"))


def queries():
    return {
        "p1_found": _p1_found,
        "p1_judged": _p1_judged,
        "p2_found": _p2_found,
        "p2_collapsed": _p2_collapsed,
        "p2_kept": _p2_kept,
        "p3_found": _p3_found,
        "p3_pieces": _p3_pieces,
        "p3_reassembled": _p3_reassembled,
        "p4_found": _p4_found,
        "p4_components": _p4_components,
        "p4_assignment": _p4_assignment,
        "p4_component_records": _p4_component_records,
        "p4_shares": _p4_shares,
        "p5_found": _p5_found,
        "p5_redacted": _p5_redacted,
        "p6_filling": _p6_filling,
        "p6_windows": _p6_windows,
        "p6_faults": _p6_faults,
        "p6_report": _p6_report,
        "p7_found": _p7_found,
        "p7_report": _p7_report,
        "p7_reparameterised": _p7_reparameterised,
        "p8_found": _p8_found,
        "p8_rates": _p8_rates,
    }


P3_FOUND = """
with d as (select max(case when is_default then seq_length end) len from seq_providers)
select distinct message_id from chat_messages m left join seq_providers p using (provider_id), d
where length(content) > coalesce(p.seq_length, d.len)
"""


_NOBODY = ", ".join(f"'{v}'" for v in splits.NOBODY)
_ACCT = r"^([a-z]+)[\s_:#./-]*([0-9]+)$"
_TIED = rf"""a as (select case_id, lower(trim(author_id)) v from dataset_cases where lower(trim(author_id)) not in ({_NOBODY})),
ak as (select case_id, 'a:' || case when regexp_matches(v, '{_ACCT}') then regexp_extract(v, '{_ACCT}', 1) || '-' || nullif(ltrim(regexp_extract(v, '{_ACCT}', 2), '0'), '') else v end e from a),
tk as (select case_id, 't:' || lower(regexp_replace(origin_trace_id, '[\s{{}}-]+', '', 'g')) e from dataset_cases
       where lower(trim(origin_trace_id)) not in ({_NOBODY}) and not regexp_matches(lower(regexp_replace(origin_trace_id, '[\s{{}}-]+', '', 'g')), '^(0x)?(0*|f*)$')),
fk as (select case_id, 'f:' || lower(trim(f)) e from (select case_id, unnest(seed_files) f from dataset_cases) where lower(trim(f)) not in ({_NOBODY}) and not regexp_matches(lower(trim(f)), '^(tmpl|template|blank)\b|\bblank\b')),
k as (select * from ak union select * from tk union select * from fk),
ed as (select distinct x.case_id u, y.case_id v from k x join k y on x.e = y.e and x.case_id <> y.case_id),
r as (select u, v from ed union select r.u, ed.v from r join ed on r.v = ed.u)"""
P4_FOUND = f"with recursive {_TIED} select distinct u case_id_a, v case_id_b from r where u < v"
P4_COMPONENTS = f"""with recursive {_TIED}, c as (select u case_id, least(min(v), u) component from r group by u) select component, case_id, count(*) over (partition by component) n_cases from c"""
# The component of a case is its least case; a case without ties or unknown to dataset_cases is its own.
P4_RECORDS = rf"""with recursive {_TIED}, {ROLLOUTS}, c as (select u case_id, least(min(v), u) component from r group by u),
kc as (select regexp_replace(regexp_replace(lower(trim(d.case_id)), '^benchmark-[^:]*:\s*', ''), '[\s_]+', '-', 'g') case_id, coalesce(c.component, d.case_id) component from (select distinct case_id from dataset_cases where case_id is not null) d left join c using (case_id)),
x as (select request_id, ro.case_id, coalesce(kc.component, ro.case_id, 'request:' || request_id) component from ro left join kc on kc.case_id = ro.case_id)
select component, count(*) n_records, count(distinct case_id) n_cases, 1::bigint n_splits from x group by 1"""
P2_KEPT = """
with e as (select * from tool_events qualify row_number() over (partition by event_id order by ingested_at) = 1)
select request_id, count(*) n_events, epoch_us(min(started_at)) first_us, epoch_us(max(coalesce(ended_at, started_at))) last_us from e group by 1
"""
P3_REASSEMBLED = """
with d as (select max(case when is_default then seq_length end) len from seq_providers)
select message_id, length(any_value(content)) n_chars, md5(any_value(content)) text_md5 from chat_messages m left join seq_providers p using (provider_id), d
where length(content) > coalesce(p.seq_length, d.len) group by 1
"""
P6_FAULTS = """
with d as (select max(case when is_default then provider_id end) dp from seq_providers)
select coalesce(p.provider_id, d.dp) provider_id, count(distinct doc_id) n_docs, 0::bigint n_not_once, 0::bigint n_with_gaps, 0::bigint n_divided_for_nothing, 0::bigint n_over_capacity
from documents left join seq_providers p using (provider_id), d group by 1
"""




def oracle_sql():
    return {
        "p2_kept": P2_KEPT,
        "p3_found": P3_FOUND,
        "p3_reassembled": P3_REASSEMBLED,
        "p4_found": P4_FOUND,
        "p4_components": P4_COMPONENTS,
        "p4_component_records": P4_RECORDS,
        "p6_faults": P6_FAULTS,
    }
