"""Groups of rows as pairs of bounded blocks, so that no task and no batch holds a whole group.

A group of n rows is dealt by hash into ceil(n / BLOCK) blocks; each pair of blocks is a unit of work with at
most about 2 * BLOCK rows. Every pair of rows of a group meets in exactly one unit, and pairs are looked at
inside a unit, never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def deal(rows: DataFrame, keys: list[str], count: str, node: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with a column ``unit`` (string-free 64-bit hash), ``block`` and ``alone`` (the unit is one block),
    partitioned and sorted by unit. ``count`` is the number of rows of the group, or more where its rows are large."""
    n = F.ceil(F.col(count) / F.lit(float(block))).cast("int")
    x = rows.withColumn("_n", n).withColumn("block", F.pmod(F.xxhash64(node), F.col("_n")).cast("int"))
    x = x.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    x = x.withColumn("unit", F.struct(*keys, low.alias("low"), high.alias("high"))).withColumn("alone", low == high)
    return x.drop("_n", "_other").repartition("unit").sortWithinPartitions("unit")


def units(batches, names: list[str]) -> Iterator[dict]:
    """Columns of each unit, as lists, from batches sorted by ``unit`` (cast to a comparable first)."""
    held: dict[str, list] = {n: [] for n in names}
    now = None
    for b in batches:
        unit = b.column(b.schema.names.index("unit")).to_pylist()
        if not unit:
            continue
        change = [0, *[k for k in range(1, len(unit)) if unit[k] != unit[k - 1]], len(unit)]
        columns = {n: b.column(b.schema.names.index(n)).to_pylist() for n in names}
        for a, z in zip(change, change[1:], strict=False):
            if unit[a] != now and now is not None:
                yield held
                held = {n: [] for n in names}
            now = unit[a]
            for n in names:
                held[n] += columns[n][a:z]
    if now is not None:
        yield held


def pairs_of(block: list[int], alone: bool, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the true pairs of a unit: each unordered pair once, and only between blocks unless ``alone``."""
    if alone:
        i, j = np.nonzero(np.triu(mask, 1))
    else:
        b = np.asarray(block)
        i, j = np.nonzero(np.triu(mask, 1) & (b[:, None] != b[None, :]))
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the pairs (i, j): at most n - 1."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left = n
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
            left -= 1
            if left == 1:
                break
    return kept
