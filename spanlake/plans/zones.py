"""Zone maps of files and the choice of files that a query must read.

Resolution looks at all writes of a key, so a file whose rows can't match may still hide older rows that do. Files are
pruned by key range always; by other zones only where nothing they could hide is read. A file that can only hide rows is
read with slim columns (key, seq, op). Choices run in n log n steps over the zones.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spec import QuerySpec

#: Distinct values of a label that a zone lists; beyond it the label can't prune.
LABEL_VALUES = 64


@dataclass(frozen=True)
class Zone:
    """What a file holds. ``labels``: values by name, None if over LABEL_VALUES. ``numerics``: (min, max) by name, None if
    all are NaN. ``promoted``: promoted columns that the file has; ``texts``: rows with text; ``index``: the folder of its
    postings, if it has some; ``unique``: no key occurs twice; ``folder_files``: how many files its folder was written with,
    0 if not known."""

    file: str
    id: int
    count: int
    bytes: int
    created: int
    min_ts: int
    max_ts: int
    min_key: str
    max_key: str
    min_seq: int
    max_seq: int
    has_incr: bool = False
    has_del: bool = False
    tier: str = "hot"
    labels: dict[str, list[str] | None] = field(default_factory=dict)
    numerics: dict[str, list[float] | None] = field(default_factory=dict)
    promoted: list[str] = field(default_factory=list)
    texts: int = 0
    index: str | None = None
    unique: bool = False
    folder_files: int = 0


def zone_rows(log: DataFrame, file: str) -> DataFrame:
    """A row per value of column ``file``: counts and ranges."""
    return log.groupBy(file).agg(
        F.count(F.lit(1)).alias("count"),
        *[f(c).alias(f"{n}_{c}") for c in ("ts", "key", "seq") for n, f in (("min", F.min), ("max", F.max))],
        F.max(F.col("op") == "incr").alias("has_incr"),
        F.max(F.col("op") == "del").alias("has_del"),
        F.count("text").alias("texts"),
    )


def zone_entries(log: DataFrame, file: str) -> DataFrame:
    """A row per file and label or metric (``is_label``): sorted label values, null beyond LABEL_VALUES, or min and max.

    Values are counted before any list is made, and a rank limit keeps lists from being longer.
    """
    none = lambda t: F.lit(None).cast(t)
    labels = log.select(file, F.explode("labels").alias("name", "value")).select(file, F.lit(True).alias("is_label"), "name", "value", none("double").alias("v"))
    metrics = log.select(file, F.explode("numerics").alias("name", "v")).select(file, F.lit(False).alias("is_label"), "name", none("string").alias("value"), F.when(~F.isnan("v"), F.col("v")).alias("v"))
    each = labels.unionByName(metrics)
    per = each.groupBy(file, "is_label", "name", "value").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    rank = F.row_number().over(Window.partitionBy(file, "is_label", "name").orderBy("value"))
    per = per.withColumn("_rank", rank).where(F.col("_rank") <= LABEL_VALUES + 1)
    out = per.groupBy(file, "is_label", "name").agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("value")).alias("_values"), F.max("low").alias("low"), F.max("high").alias("high"))
    return out.select(file, "is_label", "name", F.when(F.col("is_label") & (F.col("_n") <= LABEL_VALUES), F.col("_values")).alias("values"), "low", "high")


def zone_maps(log: DataFrame, file: str) -> DataFrame:
    """:func:`zone_rows` with maps of label values and of metric ranges."""
    e = zone_entries(log, file)
    pairs = lambda test, value: F.map_from_entries(F.collect_list(F.when(test, F.struct("name", value))))
    maps = e.groupBy(file).agg(pairs(F.col("is_label"), "values").alias("labels"), pairs(~F.col("is_label"), F.struct(F.col("low").alias("min"), F.col("high").alias("max"))).alias("numerics"))
    return zone_rows(log, file).join(maps, file, "left")


def zones_of(log: DataFrame, file: str, make: Callable[[str], dict]) -> list[Zone]:
    """The zones of the files of a log, by first key. ``make`` gives the fields that the rows don't: id and the like. What
    comes to the driver is a row per file and a row per file and name."""
    names: dict[str, dict[str, dict]] = {}
    for r in zone_entries(log, file).collect():
        own = names.setdefault(r[file], {"labels": {}, "numerics": {}})
        if r["is_label"]:
            own["labels"][r["name"]] = r["values"]
        else:
            own["numerics"][r["name"]] = None if r["low"] is None else [r["low"], r["high"]]
    rows = sorted((r.asDict() for r in zone_rows(log, file).collect()), key=lambda r: r["min_key"].encode())
    return [Zone(file=(f := r.pop(file)), **r, **names.get(f, {}), **make(f)) for r in rows]


#: What :func:`file_zones` reads of each row; ``_name`` and ``_block`` tell the stretch of a file that a task reads.
FILE_COLUMNS = ("_name", "_block", "_size", "key", "ts", "seq", "op", "_text", "labels", "numerics")


def _pairs(maps: Any) -> tuple[Any, Any]:
    """Names and values of an Arrow array of maps, which may be a slice."""
    at, n = maps.offsets[0].as_py(), maps.offsets[-1].as_py()
    return maps.keys.slice(at, n - at), maps.items.slice(at, n - at)


def _stretch(out: dict | None, b: Any) -> dict:
    """Takes rows of one stretch of a file into what is known of it."""
    import pyarrow.compute as pc

    key, op = b["key"], b["op"]
    ends = {n: pc.min_max(b[n]).as_py() for n in ("key", "ts", "seq")}
    rises = pc.all(pc.less(key.slice(0, len(key) - 1), key.slice(1))).as_py() is not False
    if out is None:
        out = {"name": b["_name"][0].as_py(), "bytes": b["_size"][0].as_py(), "count": 0, "has_incr": False, "has_del": False, "texts": 0, "rises": True, "labels": {}, "numerics": {}}
        out |= {f"{m}_{n}": v[m] for n, v in ends.items() for m in ("min", "max")}
    else:
        # Rows come in the file's order, so keys rise all through it if they do in each batch and from one to the next.
        rises = rises and out["max_key"].encode() < ends["key"]["min"].encode()
        _join(out, {f"{m}_{n}": v[m] for n, v in ends.items() for m in ("min", "max")})
    out["rises"] = out["rises"] and rises
    out["count"] += len(key)
    out["texts"] += pc.sum(b["_text"]).as_py() or 0
    out["has_incr"] = out["has_incr"] or pc.any(pc.equal(op, "incr")).as_py() is True
    out["has_del"] = out["has_del"] or pc.any(pc.equal(op, "del")).as_py() is True
    names, values = _pairs(b["labels"])
    for name in pc.unique(names).to_pylist():
        if (known := out["labels"].setdefault(name, [])) is not None:
            found = pc.unique(values.filter(pc.equal(names, name)))
            _add_values(out["labels"], name, known, found.to_pylist() if len(found) <= LABEL_VALUES else None)
    names, values = _pairs(b["numerics"])
    for name in pc.unique(names).to_pylist():
        v = values.filter(pc.equal(names, name)).drop_null()
        span = pc.min_max(v.filter(pc.invert(pc.is_nan(v)))).as_py()
        _add_span(out["numerics"], name, None if span["min"] is None else [span["min"], span["max"]])
    return out


def _add_values(labels: dict, name: str, known: list | None, found: list | None) -> None:
    both = None if known is None or found is None else list({*known, *found})
    labels[name] = both if both is not None and len(both) <= LABEL_VALUES else None


def _add_span(numerics: dict, name: str, span: list | None) -> None:
    had = numerics.get(name)
    numerics[name] = [min(had[0], span[0]), max(had[1], span[1])] if had and span else had or span


def _join(out: dict, more: dict) -> None:
    """Widens the ranges of ``out`` by those of ``more``."""
    raw = lambda v: v.encode() if isinstance(v, str) else v
    for n in ("key", "ts", "seq"):
        out[f"min_{n}"] = min(out[f"min_{n}"], more[f"min_{n}"], key=raw)
        out[f"max_{n}"] = max(out[f"max_{n}"], more[f"max_{n}"], key=raw)


def _stretches(batches: Iterable[Any]) -> Iterator[Any]:
    """A JSON text for each stretch of a file among a task's rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    which, out = None, None
    said = lambda: pa.RecordBatch.from_pydict({"zone": pa.array([json.dumps(out)], pa.string())})
    for b in batches:
        if not b.num_rows:
            continue
        block = b["_block"].to_numpy(zero_copy_only=False)
        ends = {*pc.run_end_encode(b["_name"]).run_ends.to_pylist(), *(np.flatnonzero(np.diff(block)) + 1).tolist()}
        start = 0
        for end in sorted(ends):
            part = b.slice(start, end - start)
            here = (part["_name"][0].as_py(), part["_block"][0].as_py())
            if which is not None and which != here:
                yield said()
                out = None
            which, out, start = here, _stretch(out, part), end
    if which is not None:
        yield said()


def file_zones(log: DataFrame, make: Callable[[str], dict]) -> list[Zone]:
    """The zones of files by first key, in one pass without a shuffle: a task sums up each stretch of a file that it reads,
    and the driver gets a row per stretch. ``log`` has ``FILE_COLUMNS``; ``make`` gives the other fields from a file's name.
    A file is ``unique`` if its keys rise."""
    parts: dict[str, list[dict]] = {}
    for r in log.select(*FILE_COLUMNS).mapInArrow(_stretches, "zone string").collect():
        z = json.loads(r["zone"])
        parts.setdefault(z["name"], []).append(z)
    zones = []
    for of in parts.values():
        out, *rest = sorted(of, key=lambda z: (z["min_key"].encode(), z["max_key"].encode()))
        for z in rest:
            out["rises"] = out["rises"] and z["rises"] and out["max_key"].encode() < z["min_key"].encode()
            _join(out, z)
            for n in ("count", "texts"):
                out[n] += z[n]
            for n in ("has_incr", "has_del"):
                out[n] = out[n] or z[n]
            for name, values in z["labels"].items():
                _add_values(out["labels"], name, out["labels"].get(name, []), values)
            for name, span in z["numerics"].items():
                _add_span(out["numerics"], name, span)
        out["labels"] = {n: None if v is None else sorted(x for x in v if x is not None) for n, v in out["labels"].items()}
        zones.append(out)
    zones.sort(key=lambda z: z["min_key"].encode())
    return [Zone(unique=z.pop("rises"), **{n: v for n, v in z.items() if n != "name"}, **make(z["name"])) for z in zones]


def may_match(zone: Zone, spec: QuerySpec) -> bool:
    """Whether a row of the file can meet the conditions on time, labels, metrics and key."""
    if not may_overlap_prefix(zone, spec.key_prefix):
        return False
    if spec.time_range is not None and (zone.max_ts < spec.time_range[0] or zone.min_ts > spec.time_range[1]):
        return False
    for name, value in spec.labels.items():
        if name not in zone.labels or (zone.labels[name] is not None and value not in zone.labels[name]):
            return False
    if spec.after is not None:
        ascending = spec.order_by is not None and not spec.order_by.descending
        if (zone.max_ts < spec.after[0]) if ascending else (zone.min_ts > spec.after[0]):
            return False
    for name, (low, high) in spec.ranges.items():
        span = zone.numerics.get(name)
        if span is None or not (span[0] <= high and span[1] >= low):
            return False
    return True


def may_overlap_prefix(zone: Zone, prefix: str | None) -> bool:
    if not prefix:
        return True
    p = prefix.encode()
    return zone.max_key.encode() >= p and zone.min_key.encode()[: len(p)] <= p


def keys_overlap(a: Zone, b: Zone) -> bool:
    return a.min_key.encode() <= b.max_key.encode() and b.min_key.encode() <= a.max_key.encode()


def disjoint(zones: list[Zone]) -> bool:
    """Whether no two files share a stretch of keys."""
    return len(alone(zones)) == len(zones)


class Overlap:
    """Answers which key ranges overlap one of those of ``zones``, in logarithmic time each."""

    def __init__(self, zones: Iterable[Zone]) -> None:
        ranges = sorted((z.min_key.encode(), z.max_key.encode()) for z in zones)
        self.lows, self.tops = [a for a, _ in ranges], []
        for _, b in ranges:
            self.tops.append(max(b, self.tops[-1]) if self.tops else b)

    def __call__(self, z: Zone) -> bool:
        # Of the ranges that begin at or before z's end, one must reach z's beginning.
        k = bisect_right(self.lows, z.max_key.encode())
        return k > 0 and self.tops[k - 1] >= z.min_key.encode()


def alone(zones: list[Zone]) -> set[int]:
    """Ids of the files that share no stretch of keys with another one."""
    z = sorted(zones, key=lambda x: (x.min_key.encode(), x.max_key.encode()))
    out, top = set(), None
    for k, x in enumerate(z):
        if (top is None or top < x.min_key.encode()) and (k + 1 == len(z) or z[k + 1].min_key.encode() > x.max_key.encode()):
            out.add(x.id)
        top = max(top, x.max_key.encode()) if top is not None else x.max_key.encode()
    return out


def hiders(rest: list[Zone], read: list[Zone]) -> list[Zone]:
    """Those of ``rest`` that can hide rows of ``read``: they share keys with a file that has older rows.

    Files to read enter by their oldest row; a tree over first keys holds the furthest last key of those that are in.
    """
    lows = sorted({r.min_key.encode() for r in read})
    tree: list[bytes | None] = [None] * (len(lows) + 1)
    waiting = sorted(read, key=lambda r: r.min_seq, reverse=True)
    found = set()
    for z in sorted(rest, key=lambda z: z.max_seq):
        while waiting and waiting[-1].min_seq < z.max_seq:
            r = waiting.pop()
            k, top = bisect_left(lows, r.min_key.encode()) + 1, r.max_key.encode()
            while k <= len(lows):
                if tree[k] is None or tree[k] < top:
                    tree[k] = top
                k += k & -k
        k, low = bisect_right(lows, z.max_key.encode()), z.min_key.encode()
        while k:
            if tree[k] is not None and tree[k] >= low:
                found.add(z.id)
                break
            k -= k & -k
    return [z for z in rest if z.id in found]


def plan_files(zones: list[Zone], spec: QuerySpec) -> tuple[list[Zone], list[Zone]]:
    """(files to read, files that only hide older rows of those)."""
    near = [z for z in zones if may_overlap_prefix(z, spec.key_prefix)]
    if any(z.has_incr for z in near):
        return near, []  # a total can match where none of its parts does
    read = [z for z in near if may_match(z, spec)]
    ids = {z.id for z in read}
    return read, hiders([z for z in near if z.id not in ids], read)


def newest_until(zones: list[Zone], k: int) -> tuple[list[Zone], int | None]:
    """The k files with the latest times, and the latest time of all others (None if there are none): a newest-first page
    whose last row is later needs no other file."""
    z = sorted(zones, key=lambda x: x.max_ts, reverse=True)
    return z[:k], z[k].max_ts if k < len(z) else None


def suffix_max(zones: DataFrame) -> DataFrame:
    """Adds the largest max_ts of this and all older files: where a newest-first walk may stop. One row per file."""
    older = Window.orderBy(F.col("id").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return zones.withColumn("suffix_max_ts", F.max("max_ts").over(older))


def disjointness(zones: DataFrame) -> DataFrame:
    """Adds whether the next file by first key begins after this one ends (null for the last). One row per file."""
    after = F.lead("min_key").over(Window.orderBy("min_key", "id"))
    return zones.withColumn("is_disjoint", after > F.col("max_key"))
