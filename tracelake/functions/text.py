"""Scalar functions on names and texts, as expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tool_name(c: Column, prefixes: tuple[str, ...] = ("proxy.", "workspace.")) -> Column:
    """Name without wrapping prefix, case and separators."""
    n = F.lower(F.trim(c))
    strip = "|".join(re.escape(p) for p in prefixes)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(n, rf"^(?:{strip})+", ""), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def last_part(c: Column, sep: str = ".") -> Column:
    """Last dotted part of a name."""
    return F.element_at(F.split(c, re.escape(sep)), -1)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a case-sensitive glob (``*``, ``?`` and ``[...]``)."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        j = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif j > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(c: Column, globs: list[str]) -> Column:
    """Whether any glob matches; globs without wildcards become plain comparisons."""
    exact = [g for g in globs if not any(x in g for x in "*?[")]
    out = c.isin(*exact) if exact else F.lit(False)
    for g in globs:
        if g in exact:
            continue
        simple = g[:-1] if g.endswith("*") and not any(x in g[:-1] for x in "*?[") else None
        out = out | (c.startswith(simple) if simple is not None else c.rlike(glob_regex(g)))
    return out


def first_family(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Family of the first rule whose pattern is found; rules are configuration, in order."""
    out = F.when(c.isNull(), F.lit(default))
    for pattern, family in rules:
        out = out.when(c.rlike(pattern), F.lit(family))
    return out.otherwise(F.lit(default))


def head_tail(c: Column, limit: int, marker: str) -> Column:
    """Two thirds of the limit from the head and the rest from the tail, around a marker."""
    head = limit * 2 // 3
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(limit - head)))).otherwise(c)


def fitted(c: Column, size: Column, limit: int, start: int, floor: int, marker: str) -> Column:
    """``head_tail`` with the limit halved until the row's ``size`` plus the text fits, not below ``floor``."""
    out, at = None, start
    while True:
        cut = head_tail(c, at, marker)
        cond = size + F.length(cut) <= limit
        if at <= floor:
            return cut if out is None else out.otherwise(cut)
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
        at = max(floor, at // 2)


def without_tags(c: Column, tags: list[str]) -> Column:
    """Text without the given tags and what they hold."""
    for t in tags:
        c = F.regexp_replace(c, rf"(?s)<{t}\b[^>]*>.*?</{t}>", "")
    return F.trim(c)


def count_literal(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(c.isNull(), F.lit(None)).otherwise(F.regexp_count(c, F.lit(re.escape(needle))))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def resource_key(c: Column) -> Column:
    """Resource name without case, extension, punctuation and spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\.[a-z0-9]{1,5}$", ""), r"[\s\p{Punct}]+", "")


def extracted(c: Column, pattern: str, group: int = 0) -> Column:
    """Distinct matches in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def ordered_operations(c: Column, patterns: dict[str, str]) -> Column:
    """Operations whose pattern occurs, by first position, then name."""
    hits = F.array(*[F.struct(F.regexp_instr(c, F.lit(p)).alias("at"), F.lit(op).alias("op")) for op, p in sorted(patterns.items())])
    return F.transform(F.array_sort(F.filter(hits, lambda h: h["at"] > 0)), lambda h: h["op"])


def masked(c: Column) -> Column:
    """Flat redaction of links, mail addresses and long identifiers."""
    c = F.regexp_replace(c, r"https?://[^\s\"<>)]+", "<url>")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>")
    return F.regexp_replace(c, r"[0-9a-f]{8,}", "<id>")


def labelled_ids(c: Column, pattern: str, label: str) -> Column:
    """Replace each distinct match by a numbered label, equal matches by equal labels (in order of appearance).

    The distinct matches of one text are folded over the text inside the JVM.
    """
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    numbered = F.transform(found, lambda v, i: F.struct(v.alias("v"), F.concat(F.lit(f"<{label}_"), (i + 1).cast("string"), F.lit(">")).alias("l")))
    return F.aggregate(numbered, c, lambda acc, x: F.replace(acc, x["v"], x["l"]))


def verdict(c: Column) -> Column:
    """PASS or FAIL whatever the spelling, else null."""
    v = F.upper(F.trim(c))
    return F.when(v.isin("PASS", "FAIL"), v)


#: Chinese counting words.
ZH_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def zh_count(c: Column) -> Column:
    """Integer of an Arabic or a one-character Chinese number, else null."""
    m = F.create_map(*[F.lit(x) for kv in ZH_DIGITS.items() for x in kv])
    return F.coalesce(F.when(c.rlike(r"^\d{1,9}$"), c.cast("int")), m[c])


def json_text(c: Column, *paths: str) -> Column:
    """First of the given JSON paths that is present."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def looks_like_error(c: Column) -> Column:
    """A response that reports an error: an error key in JSON, or an error status line."""
    return F.coalesce(F.get_json_object(c, "$.error").isNotNull(), F.lit(False)) | F.coalesce(c.rlike(r"(?i)^\s*(?:http\s+[45]\d\d|error\b|exception\b|traceback\b|timed? ?out\b)"), F.lit(False))
