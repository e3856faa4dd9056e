"""Reads of a state: scan, count, get and pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.plans.spec import QuerySpec


def matching(state: DataFrame, spec: QuerySpec) -> DataFrame:
    return state.where(spec.condition(state))


def scan(state: DataFrame, spec: QuerySpec) -> DataFrame:
    """Matching records. With a limit they are the first ones in the spec's order (Catalyst plans a top-k); without one,
    rows are sorted only if an order is asked for."""
    out = matching(state, spec)
    if spec.limit or spec.order_by is not None:
        out = out.orderBy(*spec.ordering(out))
    if spec.limit:
        out = out.limit(spec.limit)
    if spec.omit_text:
        out = out.withColumn("text", F.lit(None).cast("string"))
    return out


def count(state: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row with the number of matching records; order and limit don't count."""
    if spec.after is not None:
        raise ValueError("count takes no keyset cursor")
    return matching(state, spec).agg(F.count(F.lit(1)).alias("n"))


def get(state: DataFrame, key: str) -> DataFrame:
    """The record of a key, or no row. The condition is on the key alone, so it passes below the fold; only the search for
    hot keys does not take it, so a log with increments is better cut to the key before it is resolved, as a store does."""
    return state.where(F.col("key") == key)


def next_page(spec: QuerySpec, last_ts: int, last_key: str) -> QuerySpec:
    """The spec of the page after a page whose last row is given."""
    return replace(spec, after=(last_ts, last_key))
