"""Retention by key prefix: the longest matching prefix decides, keys that none matches stay for ever."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """(prefix, nanoseconds) rows; ``everything`` applies where no prefix matches."""

    rows: tuple[tuple[str, int], ...] = ()
    everything: int | None = None

    def ttl(self, key: str) -> int | None:
        found = [(len(p), t) for p, t in self.rows if key.startswith(p)]
        return max(found)[1] if found else self.everything

    def longest_in(self, low: str, high: str) -> int | None:
        """The TTL of every key from ``low`` to ``high`` if one row covers them all, else the longest that can apply;
        None if some key may stay for ever."""
        inside = [t for p, t in self.rows if low.encode() <= p.encode() <= high.encode() or (low.startswith(p) or high.startswith(p))]
        both = [(len(p), t) for p, t in self.rows if low.startswith(p) and high.startswith(p)]
        floor = max(both)[1] if both else self.everything
        return None if floor is None else max([floor, *inside])

    def column(self, key: Column) -> Column:
        """TTL of a key in nanoseconds, null for ever."""
        out = F.lit(self.everything).cast("long")
        for prefix, t in sorted(self.rows, key=lambda r: len(r[0])):
            out = F.when(key.startswith(prefix), F.lit(t).cast("long")).otherwise(out)
        return out


def kept(state: DataFrame, policy: Policy, now: int) -> DataFrame:
    """Records that have not expired. It judges resolved records: an expired winner never uncovers an older version."""
    ttl = policy.column(F.col("key"))
    return state.where(ttl.isNull() | (F.col("ts") >= F.lit(now) - ttl))


def expired(state: DataFrame, policy: Policy, now: int) -> DataFrame:
    ttl = policy.column(F.col("key"))
    return state.where(ttl.isNotNull() & (F.col("ts") < F.lit(now) - ttl))
