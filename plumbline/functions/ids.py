"""Stable identifiers and keyed hashes."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(source_type: Column, url: Column, title: Column, end: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", source_type, url, title, end.cast("string")), 256), F.lit(20))


def short_sha256(text: Column, size: int) -> Column:
    return F.left(F.sha2(text, 256), F.lit(size))


def short_sha1(text: Column, size: int) -> Column:
    return F.left(F.sha1(text), F.lit(size))


def keyed_hash(secret: bytes):
    """HMAC-SHA256 of a text, first 20 hex digits.  The key travels in the function, so it
    never shows in a plan or an event log."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else hmac.new(secret, t.encode(), hashlib.sha256).hexdigest()[:20]
        )

    return digest
