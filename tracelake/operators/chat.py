"""Chat records: normalising messages, supervision, claims of tool results, samples and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(record: str, order: str):
    return Window.partitionBy(record).orderBy(order)


def bare_call_groups(m: DataFrame, record: str = "record_id", order: str = "msg_pos", role: str = "msg_role") -> DataFrame:
    """Per record: groups of tool calls that follow neither an assistant nor another call."""
    prev = F.lag(role).over(_w(record, order))
    starts = (F.col(role) == "tool_call") & (prev.isNull() | ~prev.isin("assistant", "tool_call"))
    return m.select(record, order, role, starts.alias("_s")).groupBy(record).agg(F.count_if("_s").alias("n_bare_groups"), F.count_if(F.col(role) == "assistant").alias("n_assistant"))


def normalised(m: DataFrame, record: str = "record_id", order: str = "msg_pos", role: str = "msg_role", content: str = "content") -> DataFrame:
    """Merge an assistant text and the tool calls behind it into one assistant message.

    A group starts at every message that is no tool call, and at tool calls that follow neither an
    assistant nor a call.  Output: record, position, role, content, calls (array of call contents).
    """
    w = _w(record, order)
    prev = F.lag(role).over(w)
    joins = (F.col(role) == "tool_call") & F.coalesce(prev.isin("assistant", "tool_call"), F.lit(False))
    g = m.withColumn("_g", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    call = F.when(F.col(role) == "tool_call", F.struct(order, content))
    out = g.groupBy(record, "_g").agg(
        F.min(order).alias("position"),
        F.min_by(role, order).alias("_r"),
        F.min_by(F.when(F.col(role) != "tool_call", F.col(content)), order).alias("content"),
        F.transform(F.array_sort(F.collect_list(call)), lambda c: c[content]).alias("calls"),  # the calls of one turn
    )
    return out.select(record, "position", F.when(F.col("_r") == "tool_call", "assistant").when(F.col("_r") == "tool_response", "tool").otherwise(F.col("_r")).alias("role"), "content", "calls")


def claimed_responses(m: DataFrame, record: str = "record_id", order: str = "msg_pos", role: str = "msg_role") -> DataFrame:
    """Tool responses matched to tool calls first in, first out; unmatched ones have a null partner."""
    from tracelake.operators.joins import ordinal_join

    c = m.where(F.col(role) == "tool_call").select(record, F.col(order).alias("call_pos"))
    r = m.where(F.col(role) == "tool_response").select(record, F.col(order).alias("response_pos"))
    return ordinal_join(c, r, [record], ["call_pos"], ["response_pos"], "full_outer")


def supervised(m: DataFrame, record: str = "record_id", order: str = "msg_pos", role: str = "msg_role", loss: str = "loss") -> DataFrame:
    """``is_supervised``: an assistant message after the last user message whose loss is not switched off.

    An absent flag supervises; only an explicit false does not.
    """
    last_user = F.max(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy(record))
    flag = (F.col(role) == "assistant") & F.coalesce(F.col(loss), F.lit(True)) & (F.col(order) > F.coalesce(last_user, F.lit(-1)))
    return m.withColumn("is_supervised", flag)


def longest_fitting_prefix(m: DataFrame, size: Column, max_len: int, record: str = "record_id", order: str = "msg_pos") -> DataFrame:
    """Per record the longest prefix that ends at a supervised message and fits; needs ``is_supervised``."""
    cum = F.sum(size).over(_w(record, order).rowsBetween(Window.unboundedPreceding, 0))
    d = m.withColumn("_c", cum)
    fit = F.col("is_supervised") & (F.col("_c") <= max_len)
    return d.groupBy(record).agg(F.max("_c").alias("n_total"), F.max(F.when(fit, F.col("_c"))).alias("n_kept"), F.max(F.when(fit, F.col(order))).alias("last_pos"), F.count_if(F.col("is_supervised") & (F.col("_c") > max_len)).alias("n_dropped_turns"))


def exploded_samples(m: DataFrame, size: Column, record: str = "record_id", order: str = "msg_pos") -> DataFrame:
    """One sample per supervised message, holding everything up to it; lengths only."""
    cum = F.sum(size).over(_w(record, order).rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("sample_length", cum).withColumn("n_target", size).where("is_supervised").select(record, order, "sample_length", "n_target")


def shifted_labels(tokens: Column, mask: Column) -> tuple[Column, Column]:
    """Labels shifted left by one and the loss mask with the last position off; masked labels are 0."""
    n = F.size(tokens)
    m = F.concat(F.slice(mask, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(0)))
    following = F.concat(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(0)))
    labels = F.zip_with(following, m, lambda t, k: F.when(k == 1, t).otherwise(F.lit(0)))  # linear in the tokens
    return labels, m


def padded(tokens: Column, length: int, pad: int) -> Column:
    """Tokens cut or padded to a fixed length."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(tokens), F.lit(0)))), 1, length)


def compressed_history(role: Column, content: Column, keep_roles: list[str], limit: int, summary: Column | None = None) -> Column:
    """Roles on the list stay whole; of the rest a summary stands for the message if it has one, else it is cut after ``limit`` characters."""
    short = F.substring(content, 1, limit)
    if summary is not None:
        short = F.coalesce(F.nullif(F.trim(summary), F.lit("")), short)
    return F.when(role.isin(*keep_roles), content).otherwise(short)


def eos_mask(ids: Column, eos: int, supervised: Column, mark: int | None = None) -> Column:
    """Loss mask of a rendered sample: tokens belong to the segment that the next end marker closes, and a
    segment counts if its message is supervised; tokens behind the last marker never do.  With ``mark`` a
    segment counts only behind its last mark of a speaker.

    Null where the number of end markers is not the number of messages.  Linear in the tokens: the mask is
    put together from one run a segment.
    """
    at = lambda v: F.filter(F.transform(ids, lambda t, i: F.when(t == v, i)), lambda i: i.isNotNull())
    row = F.struct(at(eos).alias("ends"), (at(mark) if mark is not None else F.array().cast("array<int>")).alias("marks"))

    def runs(r):
        def one(e, j):
            before = F.when(j == 0, F.lit(-1)).otherwise(F.try_element_at(r["ends"], j))
            last = F.array_max(F.filter(r["marks"], lambda m: (m > before) & (m < e)))
            start = F.coalesce(last, before)
            on = F.coalesce(F.try_element_at(supervised, j + 1).cast("int"), F.lit(0))
            return F.concat(F.array_repeat(F.lit(0), start - before), F.array_repeat(on, e - start))

        tail = F.size(ids) - F.coalesce(F.array_max(r["ends"]), F.lit(-1)) - 1
        return F.when(F.size(r["ends"]) == F.size(supervised), F.concat(F.flatten(F.transform(r["ends"], one)), F.array_repeat(F.lit(0), tail)))

    # One row's positions are found once and handed on.
    return F.element_at(F.transform(F.array(row), runs), 1)


def mask_fault(ids: Column, mask: Column, eos: int, last_supervised: Column) -> Column:
    """Why a masked sample must not be trained on, or null: ``count`` (no mask could be made), ``nothing`` (no token
    counts), ``last`` (the last message does not count), ``back_to_back`` (a run goes on behind an end marker)."""
    beyond = F.exists(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: (F.get(ids, i - 1) == eos) & (F.get(mask, i - 1) == 1) & (F.get(mask, i) == 1))
    return (
        F.when(mask.isNull(), "count").when(F.coalesce(F.array_max(mask), F.lit(0)) == 0, "nothing").when(~F.coalesce(last_supervised, F.lit(False)), "last")
        .when((F.size(ids) > 1) & beyond, "back_to_back")
    )


def rejections(m: DataFrame, record: str = "record_id", order: str = "msg_pos", role: str = "msg_role", content: str = "content", loss: str = "loss", allow_open: bool = False, handover: str = "(?i)transfer|hand_?over") -> DataFrame:
    """(record, reason): the first fault in the order of the messages that keeps a record from being normalised, or null.

    ``unreadable_call``: a call whose content is no JSON object; ``mixed_loss``: the flags within one turn differ;
    ``excess_result``: a result before which no call is left to claim; ``unknown_role``; ``unclaimed_call``: calls
    without a result at the end, but for a lone last call that hands over, or any if ``allow_open``.
    """
    w = _w(record, order)
    call, result = F.col(role) == "tool_call", F.col(role) == "tool_response"
    prev = F.lag(role).over(w)
    joins = call & F.coalesce(prev.isin("assistant", "tool_call"), F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(call, F.get_json_object(content, "$.name"))
    # Reading a call happens row by row; only flags go on.
    bad = call & ~F.coalesce(F.try_parse_json(F.coalesce(F.col(content), F.lit("{}"))).isNotNull() & F.trim(F.coalesce(F.col(content), F.lit("{}"))).startswith("{"), F.lit(False))
    d = m.select(record, F.col(order).alias("_at"), F.col(role).alias("_role"), F.coalesce(F.col(loss), F.lit(True)).alias("_on"), bad.alias("_bad"), call.alias("_call"), result.alias("_result"), name.alias("_name"),
                 F.sum(F.when(joins, 0).otherwise(1)).over(upto).alias("_turn"))
    v = Window.partitionBy(record).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    turn = Window.partitionBy(record, "_turn")
    d = d.withColumns({"_calls": F.count_if("_call").over(v), "_results": F.count_if("_result").over(v), "_turn_end": F.max("_at").over(turn), "_mixed": (F.min("_on").over(turn) != F.max("_on").over(turn)) & F.max("_call").over(turn)})
    known = F.col("_role").isin("system", "user", "assistant", "tool_call", "tool_response")
    fault = (
        F.when(~F.coalesce(known, F.lit(False)), F.struct(F.col("_at").alias("at"), F.lit("unknown_role").alias("reason")))
        .when(F.col("_bad"), F.struct(F.col("_at").alias("at"), F.lit("unreadable_call").alias("reason")))
        .when(F.col("_result") & (F.col("_results") > F.col("_calls")), F.struct(F.col("_at").alias("at"), F.lit("excess_result").alias("reason")))
        .when(F.col("_mixed"), F.struct(F.col("_turn_end").alias("at"), F.lit("mixed_loss").alias("reason")))
    )
    g = d.groupBy(record).agg(
        F.min(fault).alias("_f"), F.count_if("_call").alias("_c"), F.count_if("_result").alias("_r"), F.max_by("_role", "_at").alias("_last"), F.max_by("_name", "_at").alias("_last_name"),
        F.max(F.when(F.col("_call"), F.col("_turn"))).alias("_t"), F.max_by("_turn", "_at").alias("_lt"), F.max_by(F.lit(1), "_at").alias("_one"),
    )
    last_turn = d.where("_call").groupBy(record, F.col("_turn").alias("_lt")).agg(F.count("*").alias("_in_last"))
    g = g.join(last_turn, [record, "_lt"], "left")
    hands = (F.col("_last") == "tool_call") & (F.col("_in_last") == 1) & (F.col("_c") - F.col("_r") == 1) & F.coalesce(F.col("_last_name").rlike(handover), F.lit(False))
    dangling = (F.col("_c") > F.col("_r")) & ~F.coalesce(hands, F.lit(False)) & F.lit(not allow_open)
    return g.select(record, F.when(F.col("_f").isNotNull(), F.col("_f.reason")).when(dangling, "unclaimed_call").alias("reason"))


def round_trip(m: DataFrame, n: DataFrame, record: str = "record_id", order: str = "msg_pos", role: str = "msg_role", content: str = "content") -> DataFrame:
    """Holds normalised messages ``n`` (as ``normalised`` gives them) against the messages ``m`` they came from.

    Per record: the names of the calls in order, and whether names with arguments, results and the order in which
    results claim calls are the same on both sides.  Contents are compared by hash, so texts stay where they are.
    """
    h = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    raw = m.where(F.col(role).isin("tool_call", "tool_response")).select(record, F.col(order).alias("_at"), (F.col(role) == "tool_call").alias("_c"), h(F.col(content)).alias("_h"))
    new = n.where(F.col("role").isin("assistant", "tool")).select(
        record, F.col("position").alias("_at"), (F.col("role") == "assistant").alias("_c"), F.when(F.col("role") == "tool", F.array(F.col("content"))).otherwise(F.col("calls")).alias("_v")
    ).select(record, "_at", "_c", F.posexplode("_v").alias("_k", "_x")).select(record, "_at", "_k", "_c", h(F.col("_x")).alias("_h"), F.when(F.col("_c"), F.coalesce(F.get_json_object("_x", "$.name"), F.lit(""))).alias("_n"))

    def lists(d, keys, prefix):
        key = F.struct(*keys)
        seq = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(*keys, "_h")))), lambda x: x["_h"])  # noqa: E731 - the calls of one record
        # The k-th result claims the k-th call; a result before its call claims out of turn.
        return d.groupBy(record).agg(seq(F.col("_c")).alias(f"{prefix}_calls"), seq(~F.col("_c")).alias(f"{prefix}_results"), F.transform(F.array_sort(F.collect_list(F.struct(*keys, "_c"))), lambda x: x["_c"]).alias(f"{prefix}_order"), *([F.transform(F.array_sort(F.collect_list(F.when(F.col("_c"), F.struct(*keys, "_n")))), lambda x: x["_n"]).alias("names")] if prefix == "new" else []))

    j = lists(raw, ["_at"], "raw").join(lists(new, ["_at", "_k"], "new"), record, "full_outer")
    claims = F.aggregate("new_order", F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok")), lambda a, c: F.struct((a["n"] + F.when(c, 1).otherwise(-1)).alias("n"), (a["ok"] & (c | (a["n"] > 0))).alias("ok")), lambda a: a["ok"])
    same = {"same_calls": F.col("raw_calls").eqNullSafe(F.col("new_calls")), "same_results": F.col("raw_results").eqNullSafe(F.col("new_results")), "claims_in_order": F.coalesce(claims, F.lit(False))}
    return j.select(record, F.coalesce(F.size("new_calls"), F.lit(0)).cast("bigint").alias("n_calls"), F.coalesce(F.size("new_results"), F.lit(0)).cast("bigint").alias("n_results"), F.array_join("names", ",").alias("names"), *[c.alias(k) for k, c in same.items()])


def render_equivalence(m: DataFrame, whole: Column, prefix: Column, record: str = "record_id", order: str = "msg_pos") -> DataFrame:
    """Whether rendering a record once gives the same text and the same supervised places as rendering the prefix up to
    every supervised message by itself; needs ``is_supervised``.

    ``whole`` and ``prefix`` render one message; ``prefix`` may use ``_last``, the position of the sample's last message.
    """
    marked = m.withColumns({"_w": whole, "_up": F.sum(F.length(whole)).over(_w(record, order).rowsBetween(Window.unboundedPreceding, 0))})
    full = marked.groupBy(record).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_w"))), lambda x: x["_w"]), "").alias("_whole"))  # the messages of one record
    ends = marked.where("is_supervised").select(record, F.col(order).alias("_last"), F.col("_up").alias("_end"))
    parts = ends.join(m, record).where(F.col(order) <= F.col("_last")).withColumn("_p", prefix)
    samples = parts.groupBy(record, "_last", "_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_p"))), lambda x: x["_p"]), "").alias("_sample"))
    j = samples.join(full, record)
    same = F.startswith(F.col("_whole"), F.col("_sample"))
    return j.groupBy(record).agg(
        F.count("*").alias("n_samples"), F.sum(F.length("_sample")).alias("slots_exploded"), F.max(F.length("_whole")).cast("bigint").alias("slots_whole"),
        F.count_if(same).alias("n_same_prefix"), F.count_if(F.length("_sample") == F.col("_end")).alias("n_same_place"),
    )


def segment_positions(lengths: Column) -> Column:
    """Position ids of a window: they start again at 0 in each of its segments."""
    return F.flatten(F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n.cast("int") - 1)))


def judged_ok(judges: Column) -> Column:
    """A non-empty map of judges whose severities are all ok."""
    return F.coalesce((F.cardinality(judges) > 0) & F.forall(F.map_values(judges), lambda v: v == "ok"), F.lit(False))


def effort(*fields: Column, default: str = "low", allowed: tuple[str, ...] = ("low", "medium", "high")) -> Column:
    """First field that says something, else the default; null for a value that is not allowed."""
    v = F.coalesce(*[F.nullif(F.lower(F.trim(f)), F.lit("")) for f in fields], F.lit(default))
    return F.when(v.isin(*allowed), v)


def proper_ending(messages: Column, allow_open: bool = False) -> Column:
    """Whether the last message ends a record: a text of the assistant, a lone call to a hand-over tool, or anything if open."""
    last = F.try_element_at(messages, F.lit(-1))
    text = (last["role"] == "assistant") & (F.coalesce(F.length(F.trim(last["content"])), F.lit(0)) > 0)
    handover = (last["role"] == "tool_call") & F.coalesce(F.get_json_object(last["content"], "$.name").rlike("(?i)transfer|hand_?over"), F.lit(False))
    return F.coalesce(text | handover, F.lit(False)) | F.lit(allow_open)
