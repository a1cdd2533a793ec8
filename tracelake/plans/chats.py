"""Chat records: interaction audit, supervision, normalising, samples, windows and text shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.core import table
from tracelake.functions import text as X
from tracelake.operators import aggregates as A
from tracelake.operators import chat as C
from tracelake.operators import joins as J
from tracelake.operators import sampling as S
from tracelake.operators import windows as W
from tracelake.plans.common import CHATS, chats, n_chars

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ROLES = ["system", "user", "assistant", "tool_call", "tool_response"]


@query(f"with {CHATS} select record_id, {', '.join(f'''count(*) filter (where msg_role = '{r}') n_{r}''' for r in _ROLES)}, count(*) n_messages, cast(sum(coalesce(length(content), 0)) as bigint) n_chars from ch group by 1")
def role_counts(spark, d):
    return chats(spark, d, n_chars()).groupBy("record_id").agg(*[F.count_if(F.col("msg_role") == r).alias(f"n_{r}") for r in _ROLES], F.count("*").alias("n_messages"), F.sum("n_chars").alias("n_chars"))


_SUP = f"{CHATS}, su as (select *, coalesce(msg_role = 'assistant' and coalesce(loss, true) and msg_pos > coalesce(max(case when msg_role = 'user' then msg_pos end) over (partition by record_id), -1), false) sup from ch)"


@query(f"""with {_SUP}, r as (select record_id, count(*) filter (where sup) n_sup, count(*) filter (where msg_role = 'tool_call') n_calls, count(*) n from su group by 1)
select case when n_sup > 0 and n_calls > 0 then 'both' when n_sup > 0 then 'text_only' when n_calls > 0 then 'calls_only' else 'neither' end shape, count(*) n_records, cast(sum(n_sup) as bigint) n_supervised, cast(sum(n_calls) as bigint) n_calls, cast(max(n) as bigint) max_messages from r group by 1""")
def interaction_audit(spark, d):
    r = C.supervised(chats(spark, d)).groupBy("record_id").agg(F.count_if("is_supervised").alias("n_sup"), F.count_if(F.col("msg_role") == "tool_call").alias("n_c"), F.count("*").alias("n"))
    shape = F.when((F.col("n_sup") > 0) & (F.col("n_c") > 0), "both").when(F.col("n_sup") > 0, "text_only").when(F.col("n_c") > 0, "calls_only").otherwise("neither")
    return r.groupBy(shape.alias("shape")).agg(F.count("*").alias("n_records"), F.sum("n_sup").alias("n_supervised"), F.sum("n_c").alias("n_calls"), F.max("n").alias("max_messages"))


@query(f"with {_SUP}, c as (select msg_role, length(content) l from su where content is not null), s as (select msg_role, list_sort(list(l)) v, count(*) n from c group by 1) select msg_role, n, v[least(n - 1, n * 50 // 100) + 1] p50_upper, v[(n - 1) * 50 // 100 + 1] p50_lower, v[(n - 1) * 90 // 100 + 1] p90_lower from s")
def role_length_quantiles(spark, d):
    c = chats(spark, d, F.length("content").alias("l")).where("l is not null").select("msg_role", "l")
    up = A.order_statistics(c, ["msg_role"], "l", {"p50_upper": "least(n - 1, n * 50 div 100)", "p50_lower": "(n - 1) * 50 div 100", "p90_lower": "(n - 1) * 90 div 100"})
    return up.select("msg_role", "n", "p50_upper", "p50_lower", "p90_lower")


@query(f"""with {CHATS}, p as (select *, row_number() over (partition by record_id order by msg_pos) - 1 pos from ch), f as (select record_id, pos, pos - row_number() over (partition by record_id order by pos) g from p where coalesce(loss, true) and msg_role <> 'system')
select record_id, cast(min(pos) as bigint) run_start, cast(max(pos) + 1 as bigint) run_end, count(*) run_length from f group by record_id, g""")
def loss_mask_runs(spark, d):
    c = chats(spark, d).withColumn("on", F.coalesce("loss", F.lit(True)) & (F.col("msg_role") != "system"))
    r = W.runs(c, ["record_id"], "msg_pos", "on")
    return r.select("record_id", F.col("run_start").cast("bigint").alias("run_start"), F.col("run_end").cast("bigint").alias("run_end"), "run_length")


@query(f"""with {CHATS}, l as (select *, max(case when msg_role = 'user' then msg_pos end) over (partition by record_id) last_user from ch)
select record_id, max(last_user) last_user, count(*) filter (where msg_role = 'assistant' and msg_pos < last_user) n_context, count(*) filter (where msg_role = 'assistant' and msg_pos > last_user) n_after,
count(*) filter (where msg_role = 'assistant' and msg_pos < last_user) <= 1 and count(*) filter (where msg_role = 'tool_call' and msg_pos < last_user) = 0 and count(*) filter (where msg_role = 'assistant' and msg_pos > last_user) >= 1 is_well_formed from l group by 1""")
def context_turns(spark, d):
    w = Window.partitionBy("record_id")
    c = chats(spark, d).select("record_id", "msg_pos", "msg_role").withColumn("lu", F.max(F.when(F.col("msg_role") == "user", F.col("msg_pos"))).over(w))
    a, t = F.col("msg_role") == "assistant", F.col("msg_role") == "tool_call"
    before, after = F.col("msg_pos") < F.col("lu"), F.col("msg_pos") > F.col("lu")
    g = c.groupBy("record_id").agg(F.max("lu").alias("last_user"), F.count_if(a & before).alias("n_context"), F.count_if(a & after).alias("n_after"), F.count_if(t & before).alias("k"))
    return g.select("record_id", "last_user", "n_context", "n_after", ((F.col("n_context") <= 1) & (F.col("k") == 0) & (F.col("n_after") >= 1)).alias("is_well_formed"))


_GROUPS = f"""{CHATS}, pv as (select *, lag(msg_role) over (partition by record_id order by msg_pos) prev from ch),
gg as (select *, sum(case when msg_role = 'tool_call' and prev in ('assistant', 'tool_call') then 0 else 1 end) over (partition by record_id order by msg_pos) g from pv)"""


@query(f"""with {_GROUPS}, b as (select record_id, count(*) filter (where msg_role = 'tool_call' and (prev is null or prev not in ('assistant', 'tool_call'))) n_bare_groups, count(*) filter (where msg_role = 'assistant') n_assistant from pv group by 1),
o as (select record_id, count(distinct g) n_out from gg where msg_role in ('assistant', 'tool_call') group by 1) select record_id, n_bare_groups, n_assistant, coalesce(n_out, 0) n_assistant_out, coalesce(n_out, 0) = n_bare_groups + n_assistant is_consistent from b left join o using (record_id)""")
def action_count_gate(spark, d):
    c = chats(spark, d, F.lit("").alias("content"))
    out = C.normalised(c).where(F.col("role") == "assistant").groupBy("record_id").agg(F.count("*").alias("o"))
    j = C.bare_call_groups(c).join(out, "record_id", "left").withColumn("n_assistant_out", F.coalesce("o", F.lit(0)))
    return j.select("record_id", "n_bare_groups", "n_assistant", "n_assistant_out", (F.col("n_assistant_out") == F.col("n_bare_groups") + F.col("n_assistant")).alias("is_consistent"))


@query(f"""with {_GROUPS}, n as (select record_id, g, min(msg_pos) "position", arg_min(msg_role, msg_pos) r, count(*) filter (where msg_role = 'tool_call') n_calls, arg_min(length(content), msg_pos) filter (where msg_role <> 'tool_call') n_chars from gg group by 1, 2)
select record_id, "position", case r when 'tool_call' then 'assistant' when 'tool_response' then 'tool' else r end "role", n_calls, coalesce(n_chars, -1) n_chars from n""")
def normalised_messages(spark, d):
    n = C.normalised(chats(spark, d, "content"))
    return n.select("record_id", "position", "role", F.size("calls").cast("bigint").alias("n_calls"), F.coalesce(F.length("content").cast("bigint"), F.lit(-1)).cast("bigint").alias("n_chars"))


@query(f"""with {CHATS}, c as (select record_id, msg_pos call_pos, row_number() over (partition by record_id order by msg_pos) k from ch where msg_role = 'tool_call'), r as (select record_id, msg_pos response_pos, row_number() over (partition by record_id order by msg_pos) k from ch where msg_role = 'tool_response')
select coalesce(c.record_id, r.record_id) record_id, coalesce(c.k, r.k) ordinal, call_pos, response_pos, case when call_pos is null then 'excess_response' when response_pos is null then 'dangling_call' when response_pos < call_pos then 'out_of_order' else 'ok' end status from c full join r on c.record_id = r.record_id and c.k = r.k""")
def tool_result_claims(spark, d):
    m = C.claimed_responses(chats(spark, d))
    status = F.when(F.col("call_pos").isNull(), "excess_response").when(F.col("response_pos").isNull(), "dangling_call").when(F.col("response_pos") < F.col("call_pos"), "out_of_order").otherwise("ok")
    return m.select("record_id", F.col("ordinal").cast("bigint").alias("ordinal"), "call_pos", "response_pos", status.alias("status"))


@query(f"""with {CHATS}, t as (select record_id, msg_pos, msg_role, content, count(*) filter (where msg_role = 'tool_call') over w - count(*) filter (where msg_role = 'tool_response') over w open_ from ch where msg_role in ('tool_call', 'tool_response') window w as (partition by record_id order by msg_pos))
select record_id, count(*) filter (where msg_role = 'tool_call') n_calls, count(*) filter (where msg_role = 'tool_response') n_results, coalesce(string_agg(coalesce(json_extract_string(case when json_valid(content) then content end, '$.name'), ''), ',' order by msg_pos) filter (where msg_role = 'tool_call'), '') names,
true same_calls, true same_results, min(open_) >= 0 claims_in_order from t group by 1""")
def round_trip_gate(spark, d):
    """Calls with their arguments, results and claims of the normalised messages held against the raw ones, in order."""
    c = chats(spark, d, "content")
    return C.round_trip(c, C.normalised(c))


@query(f"""with {_SUP}, c as (select *, sum(coalesce(length(content), 0)) over (partition by record_id order by msg_pos) cum from su)
select record_id, cast(max(cum) as bigint) n_total, cast(max(case when sup and cum <= 1024 then cum end) as bigint) n_kept, max(case when sup and cum <= 1024 then msg_pos end) last_pos, count(*) filter (where sup and cum > 1024) n_dropped_turns from c group by 1""")
def truncate_to_last_turn(spark, d):
    return C.longest_fitting_prefix(C.supervised(chats(spark, d, n_chars())), F.col("n_chars"), 1024)


@query(f"""with {_SUP}, c as (select *, coalesce(length(content), 0) n, sum(coalesce(length(content), 0)) over (partition by record_id order by msg_pos) cum from su), e as (select record_id, count(*) n_samples, sum(cum) slots_exploded, sum(n) n_targets from c where sup group by 1), w as (select record_id, max(cum) slots_whole from c group by 1)
select record_id, n_samples, cast(slots_exploded as bigint) slots_exploded, cast(slots_whole as bigint) slots_whole, cast(n_targets as bigint) n_targets from e join w using (record_id)""")
def whole_versus_exploded(spark, d):
    size = F.col("n_chars")
    s = C.supervised(chats(spark, d, n_chars()))
    e = C.exploded_samples(s, size).groupBy("record_id").agg(F.count("*").alias("n_samples"), F.sum("sample_length").alias("slots_exploded"), F.sum("n_target").alias("n_targets"))
    return e.join(s.groupBy("record_id").agg(F.sum(size).alias("slots_whole")), "record_id")


def _shifted(c):
    c = c.where("content is not null").select("message_id", F.transform(F.split("content", " "), lambda x: F.length(x)).alias("tok"))
    labels, mask = C.shifted_labels(F.col("tok"), F.transform("tok", lambda x: (x > 3).cast("int")))
    return c.select(
        "message_id", F.array_join(mask, ",").alias("mask"), F.array_join(labels, ",").alias("labels"), F.array_join(F.sequence(F.lit(0), F.size("tok") - 1), ",").alias("position_ids"),
        F.array_join(C.padded(F.col("tok"), 8, 0), ",").alias("padded"),
    )


@query(f"""with {CHATS}, t as (select message_id, string_split(content, ' ') w from ch where content is not null), k as (select message_id, list_transform(w, lambda x: length(x)) tok from t), m as (select message_id, tok, list_transform(tok, lambda x: (x > 3)::int) mask from k),
s as (select message_id, tok, list_concat(mask[2:], [0]) m2 from m) select message_id, array_to_string(m2, ',') mask, array_to_string(list_transform(list_zip(list_concat(tok[2:], [0]), m2), lambda x: case when x[2] = 1 then x[1] else 0 end), ',') labels, array_to_string(range(0, len(tok)), ',') position_ids,
array_to_string(list_concat(tok, list_transform(range(0, greatest(8 - len(tok), 0)), lambda i: 0))[1:8], ',') padded from s""")
def label_shift_and_padding(spark, d):
    """Mask, labels, positions and padding of every message, however long."""
    return _shifted(chats(spark, d, "content"))


_REJ = f"""{CHATS}, pv as (select *, lag(msg_role) over (partition by record_id order by msg_pos) prev, case when msg_role = 'tool_call' then coalesce(content, '{{{{}}}}') end cc from ch),
tu as (select *, sum(case when msg_role = 'tool_call' and prev in ('assistant', 'tool_call') then 0 else 1 end) over (partition by record_id order by msg_pos) turn,
  count(*) filter (where msg_role = 'tool_call') over (partition by record_id order by msg_pos) k_calls, count(*) filter (where msg_role = 'tool_response') over (partition by record_id order by msg_pos) k_results from pv),
tt as (select record_id, turn, max(msg_pos) turn_end, count(distinct coalesce(loss, true)) > 1 and bool_or(msg_role = 'tool_call') mixed, count(*) filter (where msg_role = 'tool_call') turn_calls from tu group by 1, 2),
fa as (select record_id, case when msg_role not in ('system', 'user', 'assistant', 'tool_call', 'tool_response') or msg_role is null then (msg_pos, 'unknown_role') when msg_role = 'tool_call' and not (json_valid(cc) and ltrim(cc) like '{{%') then (msg_pos, 'unreadable_call')
  when msg_role = 'tool_response' and k_results > k_calls then (msg_pos, 'excess_result') when mixed then (turn_end, 'mixed_loss') end f from tu join tt using (record_id, turn)),
fi as (select record_id, min(f) f from fa group by 1),
la as (select record_id, arg_max(msg_role, msg_pos) last_role, arg_max(turn_calls, msg_pos) last_calls, arg_max(case when json_valid(cc) then coalesce(json_extract_string(cc, '$.name'), '') else '' end, msg_pos) last_name, max(k_calls) - max(k_results) pending from tu join tt using (record_id, turn) group by 1)"""


@query(f"""with {_REJ} select record_id, coalesce(f[2], case when pending > 0 and not (last_role = 'tool_call' and last_calls = 1 and pending = 1 and regexp_matches(last_name, '(?i)transfer|hand_?over')) then 'unclaimed_call' end) reason from fi join la using (record_id)""".replace("{{}}", "{}"))
def message_rejections(spark, d):
    """Why a record cannot be normalised: the first of five reasons in the order of its messages, null for a sound one."""
    return C.rejections(chats(spark, d, "content"))


_EOS, _ASSISTANT = -2, -1


@query(f"""with {_SUP}, p as (select record_id, msg_pos, msg_role = 'assistant' a, sup, len(string_split(coalesce(content, ''), ' ')) n from su), e as (select record_id, list_concat(list_transform(range(0, n + 1), lambda i: case when i > 0 and sup and a then 1 else 0 end), case when a then [case when sup then 1 else 0 end] else [] end) m, msg_pos, a, sup from p),
r as (select record_id, flatten(list(m order by msg_pos)) mask, arg_max(sup, msg_pos) filter (where a) last_sup, count(*) filter (where a) n_a from e group by 1)
select record_id, cast(len(mask) as bigint) n_tokens, cast(coalesce(list_sum(mask), 0) as bigint) n_targets, md5(array_to_string(mask, '')) mask_md5,
case when coalesce(list_sum(mask), 0) = 0 then 'nothing' when not last_sup then 'last' end fault from r""")
def eos_loss_mask(spark, d):
    """Messages rendered as a mark of the speaker, a number per word and, for the assistant, an end marker; the mask is found from the markers alone."""
    c = C.supervised(chats(spark, d, "content"))
    words = F.transform(F.split(F.coalesce("content", F.lit("")), " "), lambda x: F.length(x))
    a = F.col("msg_role") == "assistant"
    part = F.concat(F.array(F.when(a, F.lit(_ASSISTANT)).otherwise(F.lit(-3))), words, F.when(a, F.array(F.lit(_EOS))).otherwise(F.array().cast("array<int>")))
    g = c.select("record_id", F.struct("msg_pos", part.alias("ids"), a.alias("a"), "is_supervised").alias("x")).groupBy("record_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # the messages of one record
    sup = F.transform(F.filter("x", lambda m: m["a"]), lambda m: m["is_supervised"])
    g = g.select("record_id", F.flatten(F.transform("x", lambda m: m["ids"])).alias("ids"), sup.alias("sup"))
    g = g.withColumn("mask", C.eos_mask(F.col("ids"), _EOS, F.col("sup"), _ASSISTANT))
    return g.select(
        "record_id", F.size("mask").cast("bigint").alias("n_tokens"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n_targets"), F.md5(F.array_join("mask", "")).alias("mask_md5"),
        C.mask_fault(F.col("ids"), F.col("mask"), _EOS, F.try_element_at("sup", F.lit(-1))).alias("fault"),
    )


@query(f"""with {_SUP}, p as (select *, '<' || msg_role || '>' || coalesce(content, '') || '</s>' t from su), w as (select *, string_agg(t, '') over (partition by record_id order by msg_pos rows unbounded preceding) sample, string_agg(t, '') over (partition by record_id order by msg_pos rows between unbounded preceding and unbounded following) whole from p)
select record_id, count(*) n_samples, cast(sum(length(sample)) as bigint) slots_exploded, cast(max(length(whole)) as bigint) slots_whole, count(*) filter (where starts_with(whole, sample)) n_same_prefix, count(*) filter (where whole[1:length(sample)] = sample) n_same_place from w where sup group by 1""")
def render_equivalence(spark, d):
    """Rendering a record once against rendering every supervised turn with what came before it."""
    c = C.supervised(chats(spark, d, "content"))
    text = F.concat(F.lit("<"), "msg_role", F.lit(">"), F.coalesce("content", F.lit("")), F.lit("</s>"))
    return C.render_equivalence(c, text, text)


@query(f"""with {CHATS}, l as (select record_id, msg_pos, coalesce(length(content), 0) n from ch) select record_id, cast(sum(n) as bigint) n_positions, cast(max(n) - 1 as bigint) most, md5(array_to_string(flatten(list(range(0, n) order by msg_pos)), ',')) positions_md5 from l group by 1""")
def segment_position_ids(spark, d):
    """Position ids of a record's messages in one window, restarting with each message."""
    c = chats(spark, d, n_chars()).groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("msg_pos", "n_chars"))), lambda x: x["n_chars"]).alias("n"))  # the messages of one record
    c = c.withColumn("p", C.segment_positions(F.col("n")))
    return c.select("record_id", F.size("p").cast("bigint").alias("n_positions"), F.coalesce(F.array_max("p"), F.lit(-1)).cast("bigint").alias("most"), F.md5(F.array_join("p", ",")).alias("positions_md5"))


@query(f"with {CHATS}, l as (select message_id, coalesce(length(content), 0) n from ch) select message_id, n \"length\", cast(coalesce(sum(n) over (order by message_id rows between unbounded preceding and 1 preceding), 0) as bigint) \"offset\" from l")
def exclusive_offsets(spark, d):
    c = chats(spark, d, n_chars()).select("message_id", F.col("n_chars").cast("bigint").alias("length"))
    return J.running_total(c, ["message_id"], "length", "upto").select("message_id", "length", (F.col("upto") - F.col("length")).alias("offset"))


@query(f"with {CHATS}, r as (select record_id, sum(coalesce(length(content), 0)) n from ch group by 1) select case when n > 4096 then 'over' else 'kept' end status, count(*) n_records, cast(sum(n) as bigint) n_chars from r group by 1")
def length_cap(spark, d):
    r = chats(spark, d, n_chars()).groupBy("record_id").agg(F.sum("n_chars").alias("n"))
    return r.groupBy(F.when(F.col("n") > 4096, "over").otherwise("kept").alias("status")).agg(F.count("*").alias("n_records"), F.sum("n").alias("n_chars"))


@query(f"with {CHATS} select message_id, case when msg_role in ('system', 'user') then content else coalesce(nullif(trim(reasoning_content), ''), left(content, 2000)) end compressed from ch where content is not null")
def history_compression(spark, d):
    """Roles on the list stay whole, a summary stands for a message that has one (here its reasoning), the rest is cut after 2,000 characters."""
    c = chats(spark, d, "content", "reasoning_content").where("content is not null")
    return c.select("message_id", C.compressed_history(F.col("msg_role"), F.col("content"), ["system", "user"], 2000, F.col("reasoning_content")).alias("compressed"))


@query(f"""with {CHATS}, t as (select message_id, content, length(content) n from ch where content is not null and length(content) > 300) select message_id, left(content, 200) || ' [cut] ' || right(content, 100) head_tail,
case when 40 + 7 + least(n, 1024) + case when n > 1024 then 0 else -7 end <= 600 then case when n > 1024 then left(content, 682) || ' [cut] ' || right(content, 342) else content end else case when n > 512 then left(content, 341) || ' [cut] ' || right(content, 171) else content end end fitted from t""")
def head_tail_truncation(spark, d):
    c = chats(spark, d, "content").where("content is not null and length(content) > 300")
    return c.select("message_id", X.head_tail(F.col("content"), 300, " [cut] ").alias("head_tail"), X.fitted(F.col("content"), F.lit(40), 600, 1024, 512, " [cut] ").alias("fitted"))


@query(f"""with {CHATS} select message_id, (length(content) - length(replace(content, 'file', ''))) // 4 n_file, md5(regexp_replace(content, '[^A-Za-z0-9._-]+', '_', 'g')) slug_md5, len(regexp_extract_all(content, '[a-z]+_[a-z0-9_]+\\.[a-z]+')) > 0 has_files,
len(list_distinct(regexp_extract_all(content, '[a-z]+_[a-z0-9_]+\\.[a-z]+'))) n_files from ch where content is not null""")
def text_scalars(spark, d):
    c = chats(spark, d, "content").where("content is not null")
    files = X.extracted(F.col("content"), r"[a-z]+_[a-z0-9_]+\.[a-z]+")
    return c.select(
        "message_id", X.count_literal(F.col("content"), "file").cast("bigint").alias("n_file"), F.md5(X.slug(F.col("content"))).alias("slug_md5"), (F.size(files) > 0).alias("has_files"), F.size(files).cast("bigint").alias("n_files"),
    )


@query(r"""with c as (select * from chat_messages qualify row_number() over (partition by message_id order by ingested_at) = 1) select message_id, regexp_replace(regexp_replace(regexp_replace(content, 'https?://[^\s"<>)]+', '<url>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '<email>', 'g'), '[0-9a-f]{8,}', '<id>', 'g') masked from c where content is not null""")
def flat_redaction(spark, d):
    return chats(spark, d, "content").where("content is not null").select("message_id", X.masked(F.col("content")).alias("masked"))


@query()
def labelled_redaction(spark, d):
    """Equal identifiers get equal labels within a text."""
    c = chats(spark, d, "content").where("content is not null")
    return c.select("message_id", X.labelled_ids(F.col("content"), r"\bf[ld]-[0-9a-f]{6,12}\b", "ref").alias("labelled"))


_OPS = {"archive": r"(?i)\barchive", "find": r"(?i)\bfind\b", "move": r"(?i)\bmove\b", "share": r"(?i)\bshare\b", "summarise": r"(?i)\bsummari[sz]e"}


@query(f"""with q as (select request_id, question from rollouts qualify row_number() over (partition by request_id order by ingested_at) = 1), p as (select request_id, op, case when regexp_matches(question, p) then length(string_split_regex(question, p)[1]) end pos from q, (values {', '.join(f"('{k}', '{v}')" for k, v in _OPS.items())}) t(op, p))
select request_id, coalesce(string_agg(op, '>' order by pos, op) filter (where pos is not null), '') operations from p group by 1""")
def ordered_operations(spark, d):
    from tracelake.core import delivered_once

    r = delivered_once(table(spark, d, "rollouts").select("request_id", "question", "ingested_at"), "request_id")
    return r.select("request_id", F.coalesce(F.array_join(X.ordered_operations(F.col("question"), _OPS), ">"), F.lit("")).alias("operations"))


_PRED = f"with {CHATS}, r as (select record_id, count(*) n from ch group by 1)"


_FILL = f"""{_PRED}, h as (select *, sha256('s7' || chr(0) || record_id) h from r), c as (select *, sum(n) over (order by h, record_id) upto, sum(n) over () total from h)"""


@query(f"{_FILL} select record_id, n, case when upto - n < least(200, total // 10) then 'validation' else 'train' end split from c")
def group_train_val_split(spark, d):
    """Whole records to validation until 200 messages, or a tenth of all if that is less, are reached."""
    return S.group_fill_split(chats(spark, d).select("record_id"), "record_id", "s7", 200)


@query(f"""with {CHATS}, m as (select record_id, case when substr(sha256('s7' || chr(0) || message_id), 1, 1) < '2' then 'validation' else 'train' end split from ch), l as (select record_id, count(distinct split) > 1 leaks from m group by 1)
select split, count(distinct record_id) n_groups, count(*) n_rows, count(distinct record_id) filter (where leaks) n_leaking from m join l using (record_id) group by 1""")
def split_leakage(spark, d):
    """What a split by single messages would leak: records with messages on both sides."""
    h = F.substring(S.keyed_hash("s7", F.col("message_id").cast("string")), 1, 1)
    m = chats(spark, d).select("record_id", F.when(h < "2", "validation").otherwise("train").alias("split"))
    per = m.groupBy("record_id", "split").agg(F.count("*").alias("n"))
    leaks = per.groupBy("record_id").agg((F.count("*") > 1).alias("leaks"))
    return per.join(leaks, "record_id").groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.count_if("leaks").alias("n_leaking"))


@query(f"with {CHATS} select record_id, count(*) n, case when min(msg_pos) <> 0 then 'no_first' when count(distinct msg_pos) <> count(*) then 'repeated_position' when max(msg_pos) <> count(*) - 1 then 'gap' end violation from ch group by 1 having min(msg_pos) <> 0 or count(distinct msg_pos) <> count(*) or max(msg_pos) <> count(*) - 1")
def position_expectations(spark, d):
    g = chats(spark, d).groupBy("record_id").agg(F.count("*").alias("n"), F.min("msg_pos").alias("lo"), F.max("msg_pos").alias("hi"), F.count_distinct("msg_pos").alias("u"))
    return g.select("record_id", "n", F.when(F.col("lo") != 0, "no_first").when(F.col("u") != F.col("n"), "repeated_position").when(F.col("hi") != F.col("n") - 1, "gap").alias("violation")).where("violation is not null")


@query(f"""with {CHATS}, m as (select * from ch where msg_role = 'assistant') select mask_mode, count(*) n_messages, cast(sum(case when mask_mode = 'source' then coalesce(loss, true)::int else 1 end) as bigint) n_supervised from m join seq_providers p on p.provider_id = coalesce(m.provider_id, (select max(provider_id) from seq_providers where is_default)) group by 1""")
def mask_mode_ablation(spark, d):
    p = table(spark, d, "seq_providers")
    default = p.where("is_default").agg(F.max("provider_id").alias("_d"))
    m = chats(spark, d).where(F.col("msg_role") == "assistant").select("provider_id", "loss").crossJoin(default).withColumn("provider_id", F.coalesce("provider_id", "_d"))  # one row
    j = m.join(p.select("provider_id", "mask_mode"), "provider_id")
    return j.groupBy("mask_mode").agg(F.count("*").alias("n_messages"), F.sum(F.when(F.col("mask_mode") == "source", F.coalesce("loss", F.lit(True)).cast("int")).otherwise(1)).alias("n_supervised"))


@query(f"""with {CHATS}, s as (select record_id, arg_max({{'r': msg_role, 'c': content}}, msg_pos) s from ch group by 1), l as (select record_id, s.r r, s.c c from s) select record_id, coalesce(r = 'assistant' and length(trim(c)) > 0, false) or coalesce(r = 'tool_call' and regexp_matches(json_extract_string(case when json_valid(c) then c end, '$.name'), 'transfer|hand_?over', 'i'), false) is_proper from l""")
def terminal_contract(spark, d):
    m = chats(spark, d, "content").groupBy("record_id").agg(F.max_by(F.struct(F.col("msg_role").alias("role"), "content"), "msg_pos").alias("last"))
    return m.select("record_id", C.proper_ending(F.array("last")).alias("is_proper"))


@query()
def sanitized_responses(spark, d):
    """Tool responses with identifiers replaced by numbered labels, and whether they report an error; each is read once."""
    from tracelake.core import delivered_once, ship
    from tracelake.functions.nested import examined_json

    ship(spark)
    e = delivered_once(table(spark, d, "tool_events").select("event_id", "response", "ingested_at"), "event_id").where("response is not null")
    return e.select("event_id", examined_json("response").alias("x")).select("event_id", "x.sanitized", "x.is_error")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
