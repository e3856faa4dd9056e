"""Metric maps, content ids and sizes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(names: list[str], values: list[Column]) -> Column:
    """A metric map of the values that are not null."""
    if not names:
        return F.create_map().cast("map<string,double>")
    return F.map_filter(F.create_map(*[x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v.cast("double"))]), lambda _, v: v.isNotNull())


def content_id(content: Column) -> Column:
    """SHA-256 of bytes in lower-case hex."""
    return F.sha2(content, 256)


def record_bytes(key: Column, payload: Column) -> Column:
    """Estimated stored size of a record: payload, key and a fixed overhead."""
    return F.coalesce(F.octet_length(payload), F.lit(0)) + F.octet_length(key) + 32
