"""Problem 2: runs of consecutive events that repeat the same call.

Plan
----
1. Every event gets a *call signature*: a digest of the tool name and of its canonical arguments
   without free text, plus the canonical free text (one Arrow pass, narrow rows from here on).
2. One range exchange on (request, start, index, id) puts events in order.  A request of any
   size is spread over as many partitions as it needs, so no hot request meets one task.
   The pass over the sorted partitions drops second deliveries (they lie side by side), and
   marks each event that repeats the event before it.  First and last events of the partitions
   are matched across the borders (two rows a partition).
3. Pointer doubling: a matching event points to its predecessor, every other event to itself.
   Each round a self-join replaces pointers by pointers' pointers, so a run of n events is
   resolved after ceil(log2 n) rounds.
4. One aggregation on the run start gives count and duration.

Defined results: null or unparsable args never repeat anything if null, and compare as
whitespace-collapsed text if unparsable; a null tool name equals nothing; a null started_at sorts
first; a null ended_at counts as the event's start; an event without request_id is a run of one.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracelake.core import drop_materialized, materialize, ship

#: Argument names whose values only label or time the single call.
VOLATILE = frozenset(
    "call_id callid tool_call_id request_id req_id trace_id span_id correlation_id nonce uuid idempotency_key "
    "ts timestamp request_ts requested_at sent_at time_ms attempt retry retries retry_count try_no".split()
)
#: Argument names that hold free text as somebody types it.
FREE_TEXT = frozenset("query q keyword keywords search search_text text body message msg comment note prompt question".split())
#: Edits by which one text may differ from the other and still be the same text typed again.
MAX_TYPOS = 2

_NUM = re.compile(r"[+-]?\d+(\.\d+)?\Z")
_EDGE = " \t\r\n.,;:!?。！？，；：…"


def tool_key(name: str | None) -> str | None:
    """Tool name without namespace, case and separators: ``Proxy.Sheet-Fill `` -> ``sheet_fill``."""
    if name is None:
        return None
    n = unicodedata.normalize("NFKC", name).strip().casefold()
    n = re.split(r"[./:]+", n)[-1]
    return re.sub(r"[\W_]+", "_", n).strip("_") or None


def free_key(text: str) -> str:
    """Free text without case, width, spacing and closing punctuation."""
    t = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(t.split()).strip(_EDGE)


def _canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return int(v) if v == v and abs(v) < 1e15 and float(v).is_integer() else v
    if isinstance(v, str):
        s = v.strip()
        if len(s) < 16 and _NUM.match(s):
            f = float(s)
            return int(f) if f.is_integer() and not (len(s.lstrip("+-")) > 1 and s.lstrip("+-")[0] == "0" and "." not in s) else s
        if s[:1] in "{[" and s[-1:] in "}]":
            try:
                return _canon(json.loads(s))
            except ValueError:
                pass
        return " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    if isinstance(v, list):
        return [_canon(x) for x in v]
    out = {}
    for k, x in v.items():
        if x is None:
            continue
        kk = k.strip().casefold()
        if kk not in VOLATILE:
            out[kk] = _canon(x)
    return out


def call_signature(tool: str | None, args: str | None) -> tuple[bytes | None, str | None]:
    """(digest of everything but free text, canonical free text); (None, None) repeats nothing."""
    if tool is None or args is None:
        return None, None
    free = []
    try:
        o = json.loads(args)
        if isinstance(o, str):
            o = json.loads(o)
        if o is None:
            return None, None
        if isinstance(o, dict):
            rest = {}
            for k, v in o.items():
                kk = k.strip().casefold()
                if isinstance(v, str) and kk in FREE_TEXT:
                    free.append((kk, free_key(v)))
                else:
                    rest[k] = v
            o = rest
        body = json.dumps(_canon(o), sort_keys=True, ensure_ascii=False)
    except (ValueError, RecursionError):
        body = "\0" + " ".join(args.split())
    free.sort()
    h = hashlib.blake2b(digest_size=16)
    h.update(tool.encode())
    h.update(b"\0")
    h.update("\x1f".join(k for k, _ in free).encode())
    h.update(b"\0")
    h.update(body.encode("utf-8", "surrogatepass"))
    return h.digest(), "\x1f".join(v for _, v in free) if free else None


def typo_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most + 1`` as soon as it must exceed ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[max(0, i - 1) : len(a) - j], b[max(0, i - 1) : len(b) - j]
    before, prev = None, list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        cur = [x] + [0] * len(b)
        for y in range(1, len(b) + 1):
            d = min(prev[y] + 1, cur[y - 1] + 1, prev[y - 1] + (a[x - 1] != b[y - 1]))
            if before is not None and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, before[y - 2] + 1)
            cur[y] = d
        if min(cur) > most:
            return most + 1
        before, prev = prev, cur
    return prev[-1]


def same_free_text(a: str | None, b: str | None) -> bool:
    """Whether two canonical free texts are one text typed twice (digits must agree)."""
    if a == b:
        return True
    if not a or not b:
        return False
    most = min(MAX_TYPOS, min(len(a), len(b)) // 5)
    if most == 0 or [c for c in a if c.isdigit()] != [c for c in b if c.isdigit()]:
        return False
    return typo_distance(a, b, most) <= most


def _sign(batches):
    names: dict = {}
    for b in batches:
        tools, sigs, frees = b.column("tool_name").to_pylist(), [], []
        for t, a in zip(tools, b.column("args").to_pylist()):
            k = names[t] if t in names else names.setdefault(t, tool_key(t))
            s, f = call_signature(k, a)
            sigs.append(s)
            frees.append(f)
        yield pa.RecordBatch.from_arrays(
            [b.column(c) for c in ("event_id", "request_id", "event_index", "started_at", "ended_at")]
            + [pa.array(tools, pa.string()), pa.array(sigs, pa.binary()), pa.array(frees, pa.string())],
            names=["event_id", "request_id", "event_index", "started_at", "ended_at", "tool_name", "sig", "free"],
        )


_SIGNED = "event_id long, request_id string, event_index long, started_at long, ended_at long, tool_name string, sig binary, free string"
_MARKED = "pos long, request_id string, tool_name string, event_index long, started_at long, ended_at long, same boolean, border string, sig binary, free string"
_MARKED_ARROW = pa.schema(
    [("pos", pa.int64()), ("request_id", pa.string()), ("tool_name", pa.string()), ("event_index", pa.int64()), ("started_at", pa.int64())]
    + [("ended_at", pa.int64()), ("same", pa.bool_()), ("border", pa.string()), ("sig", pa.binary()), ("free", pa.string())]
)


def _marker(keep_singles: bool):
    def mark(batches):
        part = TaskContext.get().partitionId()
        n, held = 0, None  # held: the last row, kept until it is known whether the next repeats it
        for b in batches:
            rows = []
            cols = [b.column(c).to_pylist() for c in ("event_id", "request_id", "tool_name", "event_index", "started_at", "ended_at", "sig", "free")]
            for eid, req, tool, idx, start, end, sig, free in zip(*cols):
                if held is not None and eid is not None and eid == held[10] and req == held[1]:
                    continue  # second delivery
                same = (
                    held is not None and sig is not None and sig == held[8] and req is not None and req == held[1] and same_free_text(free, held[9])
                )
                if held is not None and (keep_singles or held[6] or same or held[7]):
                    rows.append(held)
                held = ((part << 33) + n, req, tool, idx, start, end, same, "first" if n == 0 else None, sig, free, eid)
                n += 1
            yield _batch(rows)
        if held is not None:
            yield _batch([held[:7] + ("both" if held[7] else "last",) + held[8:]])

    return mark


def _batch(rows):
    """Rows as Arrow; signatures stay only with border rows, as only those are compared again."""
    cols = list(zip(*rows)) if rows else [()] * 11
    inner = [x is None for x in cols[7]]
    cols[8] = [None if i else x for i, x in zip(inner, cols[8])]
    cols[9] = [None if i else x for i, x in zip(inner, cols[9])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols[:10], _MARKED_ARROW)], schema=_MARKED_ARROW)


@F.pandas_udf(BooleanType())
def _border_same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_free_text(x, y) for x, y in zip(a, b)])


def _with_borders(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links): links hold a child and its predecessor, also across partitions."""
    edge = marked.where(F.col("border").isNotNull()).select("pos", "request_id", "sig", "free", "border")
    w = Window.orderBy("pos")  # at most two rows a partition of the range exchange
    across = (
        edge.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("pos", "request_id", "sig", "free")})
        .where(F.col("border").isin("first", "both") & (F.col("sig") == F.col("p_sig")) & (F.col("request_id") == F.col("p_request_id")))
        .where(_border_same("free", "p_free"))
        .select("pos", F.col("p_pos").alias("ptr"))
    )
    inside = marked.where("same").select("pos", (F.col("pos") - 1).alias("ptr"))
    return marked, inside.unionByName(across)


def pointer_doubling(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(pos, ptr) links to predecessors -> (pos, start) for every node of a run, starts included.

    Nodes that are nobody's child point to themselves.  Each round is one self-join; a run of n
    nodes needs ceil(log2 n) rounds, so 64 rounds suffice for any table.
    """
    heads = links.select(F.col("ptr").alias("pos")).join(links.select("pos"), "pos", "left_anti").distinct()
    cur = materialize(links.select("pos", "ptr").unionByName(heads.select("pos", F.col("pos").alias("ptr"))), "ptr")
    for _ in range(max_rounds):
        b = cur.select(F.col("pos").alias("_p"), F.col("ptr").alias("_next"))
        new = materialize(
            cur.join(b, F.col("ptr") == F.col("_p")).select("pos", F.col("_next").alias("ptr"), (F.col("_next") != F.col("ptr")).alias("moved")),
            "ptr",
        )
        drop_materialized(cur)
        moved = new.where("moved").limit(1).count()
        path = new
        cur = new.select("pos", "ptr")
        cur._tracelake_path = path._tracelake_path
        if not moved:
            return cur.withColumnRenamed("ptr", "start")
    raise RuntimeError("pointers did not settle")


def collapse_repeats(events: DataFrame, keep_singles: bool = True) -> DataFrame:
    """Collapse runs of repeated calls.

    Input: the columns of tool_events (others are ignored, so clashing names do no harm).
    Output: request_id, tool_name (of the first event), first_index, last_index, n_events,
    first_started, last_ended, duration_ms.  ``keep_singles=False`` returns runs of two or more only.
    """
    spark = events.sparkSession
    ship(spark)
    src = events.select(
        F.col("event_id").cast("long").alias("event_id"), "request_id", F.col("event_index").cast("long").alias("event_index"), F.unix_micros("started_at").alias("started_at"),
        F.unix_micros("ended_at").alias("ended_at"), "tool_name", "args"
    )
    signed = materialize(src.mapInArrow(_sign, _SIGNED), "signed")
    ordered = signed.repartitionByRange("request_id", "started_at", "event_index", "event_id").sortWithinPartitions(
        "request_id", "started_at", "event_index", "event_id"
    )
    marked = materialize(ordered.mapInArrow(_marker(keep_singles), _MARKED), "marked")
    drop_materialized(signed)
    rows, links = _with_borders(marked)
    run = pointer_doubling(links)
    how = "left" if keep_singles else "inner"
    end = F.coalesce("ended_at", "started_at")
    return (
        rows.join(run, "pos", how)
        .withColumn("start", F.coalesce("start", "pos"))
        .groupBy("start")
        .agg(
            F.max("request_id").alias("request_id"),
            F.min_by("tool_name", "pos").alias("tool_name"),
            F.min_by("event_index", "pos").alias("first_index"),
            F.max_by("event_index", "pos").alias("last_index"),
            F.count("*").alias("n_events"),
            F.min("started_at").alias("first_started"),
            F.max(end).alias("last_ended"),
        )
        .withColumn("duration_ms", F.expr("(last_ended - first_started) div 1000"))
        .withColumns({c: F.timestamp_micros(c) for c in ("first_started", "last_ended")})
        .drop("start")
    )


def found(events: DataFrame) -> DataFrame:
    """Longest runs of two or more events: request_id, first_index, last_index."""
    return collapse_repeats(events, keep_singles=False).where("n_events >= 2").select("request_id", "first_index", "last_index")


def kept_events(collapsed: DataFrame) -> DataFrame:
    """Per request: events in its runs, its first start and last end; as many as before the collapse."""
    return collapsed.groupBy("request_id").agg(
        F.sum("n_events").alias("n_events"), F.unix_micros(F.min("first_started")).alias("first_us"), F.unix_micros(F.max("last_ended")).alias("last_us")
    )
