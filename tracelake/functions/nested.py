"""Walks over nested JSON that expressions cannot do: redaction of values and detection of errors."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_URL = re.compile(r"https?://[^\s\"<>)]+")
_ID = re.compile(r"\b[0-9a-f]{8,}\b|\b[a-z]{2}-[0-9a-f]{6,}\b")
#: Keys whose values are masked whole, keys that only describe a schema, and words that report an error.
SECRET_KEYS = frozenset("password token secret authorization api_key cookie".split())
SCHEMA_KEYS = frozenset("schema properties parameters description enum".split())
ERROR_KEYS = frozenset("error errors exception error_message".split())
_ERROR_TEXT = re.compile(r"^\s*(?:http\s+[45]\d\d|error\b|exception\b|traceback\b|timed? ?out\b)", re.I)
MAX_TEXT = 2000


def sanitize(value, labels: dict | None = None):
    """Values with mail addresses, links and identifiers replaced by numbered labels; equal values get equal
    labels within one call, secret keys are masked whole and long texts are cut."""
    labels = {} if labels is None else labels

    def label(kind):
        return lambda m: labels.setdefault((kind, m.group(0)), f"<{kind}_{sum(k == kind for k, _ in labels) + 1}>")

    if isinstance(value, dict):
        return {k: "<masked>" if k.lower() in SECRET_KEYS and v is not None else sanitize(v, labels) for k, v in value.items()}
    if isinstance(value, list):
        return [sanitize(v, labels) for v in value]
    if isinstance(value, str):
        for kind, r in (("url", _URL), ("email", _EMAIL), ("id", _ID)):
            value = r.sub(label(kind), value)
        return value if len(value) <= MAX_TEXT else value[:MAX_TEXT] + "..."
    return value


#: Keys that say how a call went, and what they say of one that failed.
OUTCOME_KEYS = frozenset("success succeeded ok successful".split())
EXIT_KEYS = frozenset("exit_code exitcode returncode return_code".split())
STATUS_KEYS = frozenset("status state outcome result_status".split())
FAILED = frozenset("failed failure error errored".split())


def reports_error(value) -> bool:
    """Whether a nested value reports an error; strings that hold JSON are opened, schemas are not read.

    An error is a non-empty error key, an outcome of false, an exit code other than 0, a status of failure or an
    error message as text.
    """
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                k = k.lower()
                if k in SCHEMA_KEYS:
                    continue
                if k in ERROR_KEYS and v not in (None, "", False, [], {}):
                    return True
                if k in OUTCOME_KEYS and (v is False or isinstance(v, str) and v.strip().lower() == "false"):
                    return True
                if k in EXIT_KEYS and not isinstance(v, bool) and re.fullmatch(r"-?[0-9]+", str(v).strip()) and int(v) != 0:
                    return True
                if k in STATUS_KEYS and isinstance(v, str) and v.strip().lower() in FAILED:
                    return True
                todo.append(v)
        elif isinstance(value, list):
            todo += value
        elif isinstance(value, str):
            opened = _load(value) if value[:1] in ("{", "[") else value
            if opened is not value:
                todo.append(opened)
            elif _ERROR_TEXT.search(value):
                return True
    return False


def _load(s):
    try:
        return json.loads(s)
    except (TypeError, ValueError, RecursionError):
        return s


@F.pandas_udf(StringType())
def sanitized_json(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else json.dumps(sanitize(_load(v)), sort_keys=True, ensure_ascii=False))


@F.pandas_udf(BooleanType())
def is_error_json(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else reports_error(_load(v)))


def _examined(v: str | None) -> tuple[str | None, bool | None]:
    if v is None:
        return None, None
    o = _load(v)
    return json.dumps(sanitize(o), sort_keys=True, ensure_ascii=False), reports_error(o)


@F.pandas_udf(StructType([StructField("sanitized", StringType()), StructField("is_error", BooleanType())]))
def examined_json(s: pd.Series) -> pd.DataFrame:
    """Both of the above from one reading of the JSON."""
    return pd.DataFrame([_examined(v) for v in s], columns=["sanitized", "is_error"])
