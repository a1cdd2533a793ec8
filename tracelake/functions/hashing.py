"""Canonical hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json_sha(c: Column) -> Column:
    """sha256 of JSON with sorted keys and no spaces, in the JVM; for JSON without fractions or exponents."""
    return F.sha2(F.to_json(F.try_parse_json(c)), 256)


@F.pandas_udf(StringType())
def canonical_json_sha_exact(s: pd.Series) -> pd.Series:
    """The same with Python's number format, for JSON with floats; null for what is no JSON."""

    def one(v):
        try:
            o = json.loads(v)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return s.map(one)


def texts_md5(texts: Column) -> Column:
    """md5 of texts joined without separator; null members count as empty."""
    return F.md5(F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), ""))


def set_fingerprint(values: Column) -> Column:
    """Order-independent hash of a set of strings."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\0"), 256)


def short_id(*cols: Column) -> Column:
    """First 20 hex digits of sha256."""
    return F.substring(F.sha2(F.concat_ws("\0", *cols), 256), 1, 20)
