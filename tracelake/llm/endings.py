"""How a text ends: properly, or inside a word, sentence or structure.

``ending(text)`` returns (state, why, token): state is ``empty``, ``closed`` or ``open``; token is the
final run of letters and digits, which the callers hold against the vocabulary of the corpus.
Whether an ``open`` sentence really was cut is for the callers' evidence (neighbours, lengths,
vocabulary); marks of a cut and unclosed structures speak for themselves.
"""

from __future__ import annotations

import re

#: Characters without ink, which may trail any text.
INVISIBLE = "​‌‍⁠﻿­"
_SPACE = " \t\r\n\f\v 　" + INVISIBLE
TERMINAL = ".!?。！？；｡‽✅✔☑👍🎉"
_CLOSERS = "\"'”’»」』)）]】》>*_`~|"
#: Marks that tools leave where they cut a text.
MARK = re.compile(
    r"(?:…|\.\.\.|�+|⋯|[\[(<{（【](?:truncated|cut(?: off)?|more|snip(?:ped)?|cont(?:inued|\.|'d)?|…|\.\.\.|gekürzt|mehr|más|recortado|"
    r"terpotong|selengkapnya|截断|已截断|更多|未完|续|省略)[\])>}）】]|-{1,3} ?(?:more|truncated) ?-{1,3}|(?:read|see) more|<truncated/?>|\[\+\d+ chars?\])\Z",
    re.I,
)
_BULLET = re.compile(r"\A(?:>\s*)*(?:[-*+•·▪–]|\d{1,3}[.)]|#{1,6})(?:\s+|\Z)")
_URL = re.compile(r"(?:https?://|www\.)\S+\Z")
_FILE = re.compile(r"[\w.()-]*\w\.(?:[a-z]{1,4}\d?|[A-Z]{2,4})\Z")
_REF = re.compile(r"(?:\b(?:rev|run|ref|id|no|commit|case|sha|version|ver|build)\.?|版本|运行|编号|用例)[\s:#]*(?:[0-9a-f]{6,40}|[A-Za-z]+-\d+|v?\d+(?:\.\d+)+)\Z", re.I)
_SIGN = re.compile(r"\A(?:--|—|– )\s*\S.*\Z")
#: Last characters of the marks; only texts that end in one are searched.
_MARK_ENDS = tuple("…⋯�])>}）】-") + ("...", "more")
_JSON_HEAD = re.compile(r"(?:\A|\n)[^\n{\[]{0,40}?([{\[])(?=\s*[\"{\[\]}]|\s*\d)")
_STEM = re.compile(r"[a-z]+(?:_[a-z0-9]+)+\.\Z")
_UNIT = re.compile(r"[.!?。！？…]+[\"'”’»」』)）\]】]*(?:\s+|(?<=[。！？])|(?=[(（\[【]))|\n")


def _json_end(t: str, at: int) -> int:
    """Position after the JSON value that starts at ``at``, or -1 if it never closes."""
    depth, quoted, i, n = 0, False, at, len(t)
    while i < n:
        c = t[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


def final_token(t: str) -> str:
    i = len(t)
    while i and t[i - 1].isalnum():
        i -= 1
    return t[i:]


def final_unit(t: str) -> str:
    """What follows the last complete sentence or line; read from the end in steps that double until one is found."""
    back = 1000
    while True:
        at = max(0, len(t) - back)
        ends = [m.end() for m in _UNIT.finditer(t, at) if m.end() < len(t)]
        if ends or not at:
            return t[ends[-1] :] if ends else t
        back *= 2


def has_mark(t: str) -> bool:
    """Whether the text ends in a mark of a cut."""
    return t[-4:].lower().endswith(_MARK_ENDS) and bool(MARK.search(t))


def ending(text: str | None) -> tuple[str, str, str]:
    t = (text or "").rstrip(_SPACE)
    if not t.strip(_SPACE):
        return "empty", "empty", ""
    if has_mark(t):
        return "open", "mark", final_token(MARK.sub("", t).rstrip())
    token = final_token(t)
    if t.count("```") % 2:
        return "open", "structure", token
    if t.endswith("```"):
        return "closed", "fence", ""
    m = _JSON_HEAD.search(t) if "{" in t or "[" in t else None
    if m and (m.group(1) == "[" or '":' in t[m.start() :]):
        end = _json_end(t, m.start(1))
        if end < 0:
            if t[m.start(1) : m.start(1) + 2] in ('{"', '[{', '["', "[["):
                return "open", "structure", token
        elif not t[end:].strip(_SPACE):
            return "closed", "json", ""
    last = t[t.rfind("\n") + 1 :].strip()
    lines = t.splitlines()
    if last.startswith("|") or last.count("|") > 1:
        above = [x for x in lines[-2:-1] if "|" in x]
        whole = last.endswith("|") and (not above or above[0].count("|") == last.count("|"))
        return ("closed", "row", "") if whole else ("open", "structure", token)
    if re.match(r"\s*iteration\s+\d*", last) and len(lines) > 1 and "|" in lines[-2]:
        return "open", "structure", token
    body = _BULLET.sub("", last)
    if not body:
        return "open", "bullet", ""
    if _URL.search(body):
        return "closed", "link", token
    if t.endswith(".") and _STEM.search(body):
        return "open", "stem", token
    core = t.rstrip(_CLOSERS)
    if core and core[-1] in TERMINAL:
        return "closed", "sentence", ""
    unit = _BULLET.sub("", final_unit(t).strip())
    if len(core) < len(t) and unit[:1] in "([（【“\"「『<*_`'" and unit[-1:] in _CLOSERS:
        return "closed", "bracket", ""
    if last.startswith("#") and len(body) <= 80 and not any(c in body for c in TERMINAL[:7]):
        return "closed", "heading", token
    if _SIGN.match(last) or _SIGN.match(unit):
        return "closed", "signature", token
    if _REF.search(last):
        return "closed", "reference", token
    if _FILE.fullmatch(body):
        return "closed", "file", token
    return "open", "sentence", token
