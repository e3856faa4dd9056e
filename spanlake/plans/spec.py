"""The query: conditions joined by AND, an order, a limit, a keyset cursor and a projection flag."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import contains_all, like


@dataclass(frozen=True)
class OrderBy:
    """By time, or by a metric if ``metric`` is set; ties always go by ascending key."""

    metric: str | None = None
    descending: bool = True


TS_DESC, TS_ASC = OrderBy(), OrderBy(descending=False)


@dataclass(frozen=True)
class QuerySpec:
    """``limit`` 0 means all rows; ``after`` is the (ts, key) of the last row of the page before."""

    time_range: tuple[int, int] | None = None
    labels: Mapping[str, str] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    key_prefix: str | None = None
    text_match: str | None = None
    text_like: str | None = None
    order_by: OrderBy | None = None
    limit: int = 0
    after: tuple[int, str] | None = None
    omit_text: bool = False

    def __post_init__(self) -> None:
        if self.after is not None and self.order_by is not None and self.order_by.metric is not None:
            raise ValueError("a keyset cursor needs an order by time")
        if self.limit < 0:
            raise ValueError("the limit must not be negative")

    @property
    def needs_text(self) -> bool:
        return self.text_match is not None or self.text_like is not None

    def key_condition(self) -> Column:
        """The part that may be applied to writes before they are resolved."""
        return F.col("key").startswith(self.key_prefix) if self.key_prefix else F.lit(True)

    def condition(self, df: DataFrame) -> Column:
        """The conditions over a state, as one Column (null counts as no match); cheap ones come first."""
        test = F.lit(True)
        if self.key_prefix:
            test = test & self.key_condition()
        if self.time_range is not None:
            test = test & F.col("ts").between(*self.time_range)
        for name, value in self.labels.items():
            test = test & (label(df, name) == value)
        for name, (low, high) in self.ranges.items():
            if math.isnan(low) or math.isnan(high):
                return F.lit(False)
            v = metric(df, name)
            test = test & (v >= float(low)) & (v <= float(high)) & ~F.isnan(v)
        if self.after is not None:
            test = test & self._after()
        if self.text_match is not None:
            test = test & contains_all(F.col("text"), self.text_match)
        if self.text_like is not None:
            test = test & like(F.col("text"), self.text_like)
        return test

    def _after(self) -> Column:
        ts, key = self.after
        same = (F.col("ts") == ts) & (F.col("key") > key)
        ascending = self.order_by is not None and not self.order_by.descending
        return ((F.col("ts") > ts) if ascending else (F.col("ts") < ts)) | same

    def ordering(self, df: DataFrame) -> list[Column]:
        by = self.order_by or TS_DESC
        if by.metric is None:
            first = F.col("ts").desc() if by.descending else F.col("ts").asc()
        else:
            v = metric(df, by.metric)
            v = F.when(~F.isnan(v), v)  # a missing value and NaN come last in both directions
            first = v.desc_nulls_last() if by.descending else v.asc_nulls_last()
        return [first, F.col("key").asc()]


def label(df: DataFrame, name: str) -> Column:
    """A label's promoted column if there is one, else its map entry."""
    return F.col(f"`l_{name}`") if f"l_{name}" in df.columns else F.col("labels")[F.lit(name)]


def metric(df: DataFrame, name: str) -> Column:
    return F.col(f"`n_{name}`") if f"n_{name}" in df.columns else F.col("numerics")[F.lit(name)]
