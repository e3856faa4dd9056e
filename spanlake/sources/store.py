"""The store: Parquet files under a commit log.

A write goes to new files first and becomes visible, as a whole, with one commit. Rows carry ``seq``, the write order,
so files can be rewritten and dropped in any order without changing what a read finds. One writer at a time is expected;
a second one fails on the commit and can retry. Files that no commit lists any more stay until :meth:`Store.vacuum`.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any, TypeVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.metrics import content_id, record_bytes
from spanlake.functions.text import like_constraints, tokens_of
from spanlake.operators import read, text_index
from spanlake.operators.fold import normalised, promote, resolve
from spanlake.operators.retention import Policy
from spanlake.plans.spec import TS_DESC, QuerySpec
from spanlake.plans.zones import LABEL_VALUES, Zone, disjoint, file_zones, hiders, may_overlap_prefix, newest_until, plan_files
from spanlake.schema import DEL, INCR, LOG_COLUMNS, LOG_SCHEMA, PUT, RECORD_COLUMNS, RECORD_SCHEMA, RESERVED_PREFIX, TOMBSTONE_LABEL

from . import small
from .commits import BlobFolder, CommitLog, CorruptError, Snapshot
from .files import Files

HOUR = 3600 * 10**9
Found = TypeVar("Found")


@dataclass(frozen=True)
class Config:
    """``fsync``: "always" commits every write before it returns, a number n every n-th one, "os" when
    ``memtable_max_records`` rows are buffered in the driver; a crash loses what is buffered. TTLs are in nanoseconds, None
    for never. ``promote_*`` names get columns of their own. ``cold_root``: where cold files go; None leaves them in place.
    ``cold_root`` and ``remote_root`` belong to one store each: what it does not list there is vacuumed. ``index_text``
    writes postings beside texts; reads go by them where ``index_rows`` rows with text or more could be asked and
    ``index_keys`` keys or fewer match. ``early_files``: files with which a newest-first page is tried first. A file holds
    ``max_segment_records`` rows and, at its batch's mean size of a record, ``max_segment_bytes`` at most. Files that a
    commit dropped stay for ``vacuum_grace``."""

    fsync: str | int = "always"
    memtable_max_records: int = 10_000
    compact_min_segments: int = 8
    max_segment_records: int = 131_072
    max_segment_bytes: int = 256 << 20
    hot_ttl: int | None = 24 * HOUR
    remote_ttl: int | None = None
    cold_root: str | None = None
    remote_root: str | None = None
    retention: Policy = Policy()
    blob_sweep_every_n_ticks: int = 12
    reclaim_files_per_tick: int = 1
    promote_labels: tuple[str, ...] = ()
    promote_metrics: tuple[str, ...] = ()
    index_text: bool = True
    index_rows: int = 100_000
    index_keys: int = 1000
    early_files: int = 16
    vacuum_grace: int = 24 * HOUR

    def __post_init__(self) -> None:
        if self.fsync not in ("always", "os") and not (isinstance(self.fsync, int) and self.fsync > 0):
            raise ValueError("fsync is 'always', 'os' or a number of writes")

    @property
    def promoted(self) -> list[str]:
        return [f"l_{n}" for n in self.promote_labels] + [f"n_{n}" for n in self.promote_metrics]


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None) -> None:
        self.spark, self.files, self.config = spark, Files(spark), config or Config()
        self.root = self.files.full(root).rstrip("/")
        self.commits = CommitLog(self.files, self.root)
        self.buffer: list[tuple] = []
        self.pending: list[str] = []
        self.unsynced = self.ticks = self.audited = 0
        self.closed = False
        self.snapshot()
        if self.config.remote_root:
            from spanlake.operators.maintenance import vacuum

            vacuum(self, tiers=("remote",))

    # Writes.

    def snapshot(self) -> Snapshot:
        return self.commits.latest()

    def put(self, key: str, ts: int, labels: Mapping[str, str] | None = None, numerics: Mapping[str, float] | None = None, payload: bytes = b"", text: str | None = None) -> None:
        self.put_batch([(key, ts, labels or {}, numerics or {}, payload, text)])

    def put_batch(self, rows: Iterable[tuple] | DataFrame, *, order: list[str] | None = None, batch: str | None = None) -> None:
        """Upsert records, all visible at once; of a key's rows the last wins.

        Lists are in write order. A DataFrame is written from the executors in the order of the columns ``order``, which
        must not tie within a key. ``batch``: an id; a batch with a known id is not written again.
        """
        if not isinstance(rows, DataFrame):
            self._add([(*r, PUT) for r in rows], batch)
            return
        if order is None:
            raise ValueError("a DataFrame needs the columns of its write order")
        self._write_frame(rows, order, None, [batch])

    def put_batches(self, rows: DataFrame, *, order: list[str], number: Column, batches: list[str]) -> None:
        """Several batches of one DataFrame, as :meth:`put_batch` would write them one after the other, by one pass over it:
        the rows whose ``number`` is k are the batch with the id ``batches[k]``, rows with another number are left out. Each
        batch has a commit of its own and files of its own; if one can't be committed, those before it stay."""
        self._write_frame(rows, order, number, list(batches))

    def _write_frame(self, rows: DataFrame, order: list[str], number: Column | None, batches: list[str | None]) -> None:
        self._open()
        self.flush()
        now = self.snapshot()
        todo = [k for k, b in enumerate(batches) if b is None or (b not in now.batches and b not in batches[:k])]
        if not todo:
            return
        op = F.col("op") if "op" in rows.columns else F.lit(PUT)
        named = rows.select(*RECORD_COLUMNS, op.alias("op"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *([] if number is None else [number.cast("long").alias("_batch")]))
        by = ["key", *[f"_o{k}" for k in range(len(order))]]
        # A folder's name and that of a file in it must be those of no other file, so numbers of batches are moved by a large one.
        moved = uuid.uuid4().int >> 66
        if number is not None:
            named, by = named.where(F.col("_batch").isin(todo)).withColumn("_batch", F.col("_batch") + moved), ["_batch", *by]
        # Range partitions by batch, key and order: a hot key is split, files come out sorted, and the place of a row in its
        # sorted partition is its write order. Kept on disk, as the partitions are counted before they are written.
        x = normalised(named).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
        try:
            bad = F.exists(F.map_keys("labels"), lambda n: n.startswith(RESERVED_PREFIX))
            of = F.lit(0) if number is None else F.col("_batch") - moved
            parts = x.groupBy("_part", of.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum(record_bytes(F.col("key"), F.col("payload"))).alias("bytes"), F.max(F.coalesce(bad, F.lit(False))).alias("bad")).orderBy("_part", "batch").collect()
            if any(r["bad"] for r in parts):
                raise ValueError(f"label names may not start with {RESERVED_PREFIX}")
            if not parts:
                return
            # A number for each partition: the write order of its first row. What each batch has in rows and bytes.
            starts, seq, sizes = [0] * (parts[-1]["_part"] + 1), now.next_seq, {}
            for r in parts:
                starts[r["_part"]] = starts[r["_part"]] or seq
                seq += r["n"]
                n, size = sizes.get(r["batch"], (0, 0))
                sizes[r["batch"]] = (n + r["n"], size + r["bytes"])
            at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
            logged = x.sortWithinPartitions(*by).withColumn("seq", F.array(*map(F.lit, starts))[F.col("_part")].cast("long") + at)
            mean = max(size / n for n, size in sizes.values())
            zones = self.write_files(logged, now, arranged=True, mean=mean, most=max(r["n"] for r in parts), apart=None if number is None else "_batch")
        finally:
            x.unpersist()
        for k in sorted(sizes):
            # Write orders rise from batch to batch, so they tell whose file it is.
            end = now.next_seq + sizes[k][0]
            own = [z for z in zones if now.next_seq <= z.min_seq < end]
            now = self._publish(now, [replace(z, id=now.next_file + i) for i, z in enumerate(own)], end, [batches[k]] if batches[k] else [])

    def delete(self, key: str, ts: int) -> None:
        self._add([(key, ts, {}, {}, b"", None, DEL)])

    def incr(self, key: str, ts: int, deltas: Mapping[str, float]) -> dict[str, float]:
        """Add to a record's metrics; returns them as they are after it."""
        self._add([(key, ts, {}, dict(deltas), b"", None, INCR)])
        return dict(self.get(key)["numerics"])

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    def _add(self, rows: list[tuple], batch: str | None = None) -> None:
        self._open()
        for r in rows:
            if any(n.startswith(RESERVED_PREFIX) for n in r[2]):
                raise ValueError(f"label names may not start with {RESERVED_PREFIX}")
        if batch is not None:
            if batch in self.pending or batch in self.snapshot().batches:
                return
            self.pending.append(batch)
        self.buffer += rows
        self.unsynced += 1
        every = {"always": 1, "os": math.inf}.get(self.config.fsync, self.config.fsync)
        if self.unsynced >= every or len(self.buffer) >= self.config.memtable_max_records:
            self.flush()

    def _buffered(self, first: int) -> list[tuple]:
        """The buffer as log rows in key order."""
        out = []
        for k, (key, ts, labels, numerics, payload, text, op) in enumerate(self.buffer):
            op = DEL if op == PUT and labels.get(TOMBSTONE_LABEL) == "1" else op
            out.append((key, ts, dict(labels), {n: float(v) for n, v in numerics.items()}, bytes(payload), text, first + k, op))
        return sorted(out, key=lambda r: (r[0].encode(), r[6]))

    def flush(self) -> None:
        """Commit what is buffered, with the ids of its batches: all or nothing."""
        if self.buffer or self.pending:
            now = self.snapshot()
            zones = self._write_buffer(now) if self.buffer else []
            self._publish(now, zones, now.next_seq + len(self.buffer), self.pending)
        self.buffer, self.pending, self.unsynced = [], [], 0

    def _publish(self, now: Snapshot, zones: list[Zone], next_seq: int, batches: list[str]) -> Snapshot:
        metrics = tuple(sorted({*now.metrics, *(n for z in zones for n in z.numerics)}))
        new = replace(now, next_seq=next_seq, next_file=now.next_file + len(zones), zones=(*now.zones, *zones), metrics=metrics, batches=(*now.batches, *batches)[-1000:])
        return self.commits.add(new.counted(rows_written=sum(z.count for z in zones), bytes_flushed=sum(z.bytes for z in zones)))

    def new_folder(self, kind: str, now: Snapshot) -> str:
        return f"{self.root}/{kind}/{now.id + 1:012d}-{uuid.uuid4().hex[:8]}"

    def _write_buffer(self, now: Snapshot) -> list[Zone]:
        """The buffer as files, written by the driver; it holds ``memtable_max_records`` rows and one batch at most."""
        rows, folder = self._buffered(now.next_seq), self.new_folder("hot", now)
        names, width = self.config.promoted, self._records_a_file(sum(len(r[4]) + len(r[0].encode()) + 32 for r in rows) / len(rows))
        columns = [*small.LOG, *[(n, small.pa.string() if n.startswith("l_") else small.pa.float64()) for n in names]]
        wide = lambda r: (*r, *[r[2 if n.startswith("l_") else 3].get(n[2:]) for n in names])
        index = self._write_small_index(rows, now)
        zones = []
        for k, a in enumerate(range(0, len(rows), width)):
            part, file = rows[a : a + width], f"{folder}/part-{k:05d}.parquet"
            size = small.write_rows(self.files, file, columns, map(wide, part))
            labels, numerics = {}, {}
            for r in part:
                for n, v in r[2].items():
                    labels.setdefault(n, set()).add(v)
                for n, v in r[3].items():
                    numerics.setdefault(n, []).extend([] if math.isnan(v) else [v])
            ts, seq, ops, texts = [r[1] for r in part], [r[6] for r in part], {r[7] for r in part}, sum(r[5] is not None for r in part)
            zones.append(Zone(
                file, now.next_file + k, len(part), size, time.time_ns(), min(ts), max(ts), part[0][0], part[-1][0], min(seq), max(seq), INCR in ops, DEL in ops, "hot",
                {n: sorted(v) if len(v) <= LABEL_VALUES else None for n, v in labels.items()}, {n: [min(v), max(v)] if v else None for n, v in numerics.items()},
                names, texts, index if texts else None, len({r[0] for r in part}) == len(part),
            ))
        return zones

    def _write_small_index(self, rows: list[tuple], now: Snapshot) -> str | None:
        pairs = sorted({(t, r[0]) for r in rows if r[5] is not None for t in tokens_of(r[5])}) if self.config.index_text else []
        if not self.config.index_text or all(r[5] is None for r in rows):
            return None
        folder = self.new_folder("index", now)
        small.write_rows(self.files, f"{folder}/part-00000.parquet", small.POSTINGS, pairs)
        return folder

    def _records_a_file(self, mean: float) -> int:
        return max(1, min(self.config.max_segment_records, int(self.config.max_segment_bytes / max(1.0, mean))))

    def write_files(self, rows: DataFrame, now: Snapshot, *, arranged: bool = False, mean: float = 0.0, most: int | None = None, created: int | None = None, tier: str = "hot", apart: str | None = None) -> list[Zone]:
        """Write log rows as key-sorted files and return their zones; nothing is committed. ``arranged``: the rows are in
        range partitions and sorted; ``mean``: bytes of a record; ``most``: rows that a file can hold at most, if known;
        ``apart``: a column of whole numbers that no other write has, by which arranged rows are sorted first: each has a
        folder of its own."""
        folder = self.new_folder(tier, now)
        x, width = rows.select(*LOG_COLUMNS, *([] if apart is None else [apart])), self._records_a_file(mean)
        # The choice of ranges reads all rows once before they are written, so what makes them runs once, onto disk.
        held = None if arranged else x.persist(StorageLevel.DISK_ONLY)
        try:
            if held is not None:
                x = held.repartitionByRange("key").sortWithinPartitions("key", "seq")
            x = promote(x, self.config.promote_labels, self.config.promote_metrics)
            # A filter on keys is as large as a file's keys need; without their number it takes a megabyte in each file.
            keys = max(1, min(width, width if most is None else most))
            # The column itself, as Spark would sort rows again by one that is computed after they were sorted, and when that
            # sort spills it loses their order.
            to = x.write if apart is None else x.withColumnRenamed(apart, "batch").write.partitionBy("batch")
            to = to.option("maxRecordsPerFile", width).option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", keys)
            # Write orders never repeat and times seldom do: dictionaries of them would be made only to be thrown away.
            to.option("parquet.enable.dictionary#seq", "false").option("parquet.enable.dictionary#ts", "false").parquet(folder)
        finally:
            if held is not None:
                held.unpersist()
        log = self.spark.read.schema(self._schema([])).parquet(folder)
        meta = {"_name": "file_name", "_block": "file_block_start", "_size": "file_size"}
        read = log.select(*LOG_COLUMNS, F.col("text").isNotNull().alias("_text"), *[F.col(f"_metadata.{v}").alias(n) for n, v in meta.items()], *([] if apart is None else ["batch"]))
        if apart is not None:
            read = read.withColumn("_name", F.concat(F.lit("batch="), F.col("batch"), F.lit("/"), F.col("_name")))
        number = iter(range(now.next_file, 1 << 62))
        made = created or time.time_ns()
        zones = file_zones(read, lambda name: {"file": f"{folder}/{name}", "id": next(number), "created": made, "tier": tier, "promoted": self.config.promoted})
        inside = Counter(z.file.rpartition("/")[0] for z in zones)
        zones = [replace(z, folder_files=inside[z.file.rpartition("/")[0]]) for z in zones]
        if self.config.index_text and any(z.texts for z in zones):
            index = self.new_folder("index", now)
            text_index.write_postings(log, index)
            zones = [replace(z, index=index) if z.texts else z for z in zones]
        return zones

    # Reads.

    def log(self, zones: Iterable[Zone] | None = None, *, slim: Iterable[Zone] = (), file: bool = False) -> DataFrame:
        """The writes in the given files (default: all, and the buffer). ``slim`` files give key, seq and op alone; ``file``
        adds the file as ``_file``."""
        now = self.snapshot()
        chosen = list(now.zones if zones is None else zones)
        names = self.config.promoted
        # Files from before a name was promoted lack its column; there the map's entry stands in.
        lacking = [z for z in chosen if not set(names) <= set(z.promoted)]
        whole = [z for z in chosen if set(names) <= set(z.promoted)]
        parts = [self._read(whole, names, file)] if whole or not lacking else []
        if lacking:
            old = promote(self._read(lacking, [], file), self.config.promote_labels, self.config.promote_metrics)
            parts.append(old)
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if hiding := list(slim):
            out = out.withColumn("_hides", F.lit(False)).unionByName(self._read(hiding, [], False).select("key", "seq", "op").withColumn("_hides", F.lit(True)), allowMissingColumns=True)
        if zones is None and self.buffer:
            rows = self.spark.createDataFrame(self._buffered(now.next_seq), LOG_SCHEMA)
            out = out.unionByName(promote(rows, self.config.promote_labels, self.config.promote_metrics), allowMissingColumns=True)
        return out

    def _read(self, zones: list[Zone], promoted: list[str], file: bool) -> DataFrame:
        if not zones:
            out = promote(self.spark.createDataFrame([], LOG_SCHEMA), [n[2:] for n in promoted if n[0] == "l"], [n[2:] for n in promoted if n[0] == "n"])
            return out.withColumn("_file", F.lit("")) if file else out
        out = self.spark.read.schema(self._schema(promoted)).parquet(*self._paths(zones))
        return out.select("*", F.col("_metadata.file_path").alias("_file")) if file else out

    def _paths(self, zones: list[Zone]) -> list[str]:
        """Paths that hold these files and no others: a folder where all of its files are read, as Spark looks at each path
        that it is given by itself."""
        inside: dict[str, list[Zone]] = {}
        for z in zones:
            inside.setdefault(z.file.rpartition("/")[0], []).append(z)
        out = []
        for folder, of in inside.items():
            out += [folder] if len(of) == of[0].folder_files else [z.file for z in of]
        return out

    def _schema(self, promoted: list[str]) -> str:
        fields = "".join(f", `{n}` {'string' if n.startswith('l_') else 'double'}" for n in promoted)
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields) + fields

    def state(self, spec: QuerySpec | None = None) -> DataFrame:
        """Live records, from the files that ``spec`` needs. Files that share no key and hold plain puts skip resolution, so
        that all conditions reach the scan; without increments the last write per key is enough."""
        now = self.snapshot()
        spec = spec or QuerySpec()
        if self.buffer:
            return self._resolved(self.log().where(spec.key_condition()), sorted({*now.metrics, *(n for r in self.buffer for n in r[3])}), True)
        if (keys := self._keys_by_index(now, spec)) is not None:
            return self._of_keys(now, keys)
        zones, hiding = plan_files(list(now.zones), spec)
        if any(z.has_incr for z in zones):
            return self._resolved(self.log(zones).where(spec.key_condition()), list(now.metrics), True)
        if spec.limit and spec.order_by in (None, TS_DESC) and len(zones) > self.config.early_files:
            zones, hiding = self._newest_files(now, zones, spec)
        return self._plain(zones, hiding, spec)

    def _plain(self, zones: list[Zone], hiding: list[Zone], spec: QuerySpec) -> DataFrame:
        log = self.log(zones, slim=hiding)
        if not hiding and all(z.unique and not z.has_del for z in zones) and disjoint(zones):
            return log.drop("op")
        log = log.where(spec.key_condition())
        if not hiding:
            return self._resolved(log, [], False)
        mark = F.when(F.col("_hides"), F.create_map(F.lit("_hides"), F.lit("1")).cast("map<string,string>")).otherwise(F.col("labels"))
        out = self._resolved(log.withColumn("labels", mark).drop("_hides"), [], False)
        return out.where(~F.coalesce(F.col("labels")["_hides"] == "1", F.lit(False)))

    def _resolved(self, log: DataFrame, metrics: list[str], increments: bool) -> DataFrame:
        out = resolve(log, metrics, increments=increments)
        return promote(out, self.config.promote_labels, self.config.promote_metrics) if increments else out

    def _newest_files(self, now: Snapshot, zones: list[Zone], spec: QuerySpec) -> tuple[list[Zone], list[Zone]]:
        """The newest files that hold a whole newest-first page: it ends later than all that the other files have."""
        k = self.config.early_files
        while True:
            part, rest = newest_until(zones, k)
            ids = {z.id for z in part}
            hiding = hiders([z for z in now.zones if z.id not in ids and may_overlap_prefix(z, spec.key_prefix)], part)
            if rest is None:
                return part, hiding
            page = read.scan(self._plain(part, hiding, spec), spec).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low")).first()
            if page["n"] == spec.limit and page["low"] > rest:
                return part, hiding
            k *= 4

    def _keys_by_index(self, now: Snapshot, spec: QuerySpec) -> list[str] | None:
        """Keys one of whose writes has the tokens that ``spec`` asks for, in order; None where the index does not serve:
        few rows to read, no token known, files without postings, or too many keys."""
        if not spec.needs_text:
            return None
        near = [z for z in now.zones if z.texts and may_overlap_prefix(z, spec.key_prefix)]
        if sum(z.texts for z in near) < self.config.index_rows or any(z.index is None for z in near):
            return None
        wanted = like_constraints(spec.text_like) if spec.text_like is not None else []
        tokens = {t for kind, t in wanted if kind == "token"} | set(tokens_of(spec.text_match or ""))
        prefixes = {p for kind, p in wanted if kind == "prefix"}
        if not tokens and not prefixes:
            return None
        index = self.spark.read.schema("token string, key string").parquet(*sorted({z.index for z in near}))
        found = text_index.keys_with(index.where(spec.key_condition()), sorted(tokens), sorted(prefixes)).limit(self.config.index_keys + 1).collect()
        return sorted((r["key"] for r in found), key=str.encode) if len(found) <= self.config.index_keys else None

    def _of_keys(self, now: Snapshot, keys: list[str]) -> DataFrame:
        """The records of a few keys, from the files whose ranges hold one of them."""
        raw = [k.encode() for k in keys]

        def holds(z: Zone) -> bool:
            k = bisect_left(raw, z.min_key.encode())
            return k < len(raw) and raw[k] <= z.max_key.encode()

        zones = [z for z in now.zones if holds(z)]
        if not any(z.has_incr for z in zones):
            # The condition passes below the resolution, if there is one.
            return self._plain(zones, [], QuerySpec()).where(F.col("key").isin(keys)) if zones else self._plain([], [], QuerySpec())
        return self._resolved(self.log(zones).where(F.col("key").isin(keys)), list(now.metrics), True)

    def scan(self, spec: QuerySpec) -> DataFrame:
        return read.scan(self.state(spec), spec).select(*RECORD_COLUMNS)

    def count(self, spec: QuerySpec) -> int:
        if spec.after is not None:
            raise ValueError("count takes no keyset cursor")
        return self._retrying(lambda: read.count(self.state(replace(spec, limit=0, order_by=None)), spec).first()["n"])

    def get(self, key: str) -> Row | None:
        """The record of a key, from the files whose key range holds it."""

        def found() -> Row | None:
            if self.buffer:
                return read.get(self.state(QuerySpec(key_prefix=key)), key).select(*RECORD_COLUMNS).first()
            return self._of_keys(self.snapshot(), [key]).select(*RECORD_COLUMNS).first()

        return self._retrying(found)

    def _retrying(self, f: Callable[[], Found]) -> Found:
        """A file that went between the choice of files and their reading: choose again by the newest commit."""
        for left in (3, 2, 1, 0):
            try:
                return f()
            except Exception as e:
                if not left or not re.search("FileNotFound|FILE_NOT_EXIST|PATH_NOT_FOUND", f"{type(e).__name__} {e}"):
                    raise
        raise AssertionError

    # Blobs: folders of contents and of deletions by id. The newest row of an id tells whether it is there.

    def put_blob(self, content: bytes) -> str:
        """Store bytes under their SHA-256; the same bytes are stored once."""
        blob, now = hashlib.sha256(content).hexdigest(), self.snapshot()
        if not self._blob_is_live(now, blob):
            self._blob_row(now, (blob, bytes(content)), gone=False)
        return blob

    def put_blobs(self, contents: DataFrame) -> DataFrame:
        """Store the distinct contents of a DataFrame that the store has not yet; returns the ids of all of them."""
        now, folder = self.snapshot(), None
        x = contents.where("content is not null").select(content_id(F.col("content")).alias("id"), "content").groupBy("id").agg(F.any_value("content").alias("content"))
        new = x.join(self.blobs(now), "id", "left_anti")
        folder = self.new_folder("blobs", now)
        new.repartitionByRange("id").sortWithinPartitions("id").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").parquet(folder)
        self._blob_folder(now, folder, gone=False)
        return contents.where("content is not null").select(content_id(F.col("content")).alias("id")).distinct()

    def _blob_folder(self, now: Snapshot, folder: str, *, gone: bool) -> None:
        r = self._blob_rows([folder]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        if r["n"]:
            added = BlobFolder(folder, max([b.number for b in now.blobs], default=0) + 1, r["low"], r["high"], r["n"], gone)
            self.commits.add(replace(now, blobs=(*now.blobs, added), n_blobs=now.n_blobs + (-r["n"] if gone else r["n"])))

    def _blob_row(self, now: Snapshot, row: tuple, *, gone: bool) -> None:
        folder = self.new_folder("blobs", now)
        small.write_rows(self.files, f"{folder}/part-00000.parquet", small.BLOBS, [row])
        added = BlobFolder(folder, max([b.number for b in now.blobs], default=0) + 1, row[0], row[0], 1, gone)
        self.commits.add(replace(now, blobs=(*now.blobs, added), n_blobs=now.n_blobs + (-1 if gone else 1)))

    def _blob_rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema("id string, content binary").parquet(*folders)

    def blob_log(self, now: Snapshot) -> DataFrame:
        """id, number and gone of every stored row about a blob; contents are not read."""
        out = self.spark.createDataFrame([], "id string, number int, gone boolean, folder string")
        by_kind: dict[bool, list[BlobFolder]] = {}
        for b in now.blobs:
            by_kind.setdefault(b.gone, []).append(b)
        for gone, folders in by_kind.items():
            names = self.spark.createDataFrame([(b.folder, b.number) for b in folders], "folder string, number int")
            rows = self._blob_rows([b.folder for b in folders]).select("id", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_at"))
            # A row per folder; a full path has its scheme as a commit has it, but for the slashes after it.
            bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
            out = out.unionByName(rows.join(F.broadcast(names), bare(F.col("_at")) == bare(F.col("folder"))).select("id", "number", F.lit(gone).alias("gone"), "folder"))
        return out

    def blobs(self, now: Snapshot | None = None) -> DataFrame:
        """The ids of all blobs."""
        log = self.blob_log(now or self.snapshot())
        return log.groupBy("id").agg(F.max_by("gone", "number").alias("gone")).where("not gone").select("id")

    def _blob_is_live(self, now: Snapshot, blob: str) -> bool:
        near = [b for b in now.blobs if b.low <= blob <= b.high]
        found = self.blob_log(replace(now, blobs=tuple(near))).where(F.col("id") == blob).agg(F.max_by("gone", "number").alias("gone")).first() if near else None
        return found is not None and found["gone"] is False

    def get_blob(self, blob: str) -> bytes | None:
        """None for an id that is malformed or not stored; an error if stored bytes are missing or don't fit the id."""
        now = self.snapshot()
        near = [b for b in now.blobs if b.low <= blob <= b.high] if re.fullmatch("[0-9a-f]{64}", blob) else []
        if lost := [b.folder for b in near if not self.files.exists(b.folder)]:
            raise CorruptError(f"blob folders are missing: {lost}")
        if not near or not self._blob_is_live(now, blob):
            return None
        kept = [b.folder for b in near if not b.gone]
        got = self._blob_rows(kept).where(F.col("id") == blob).select("content", content_id(F.col("content")).alias("is")).first()
        if got is None or got["is"] != blob:
            raise CorruptError(f"blob {blob} is missing or damaged")
        return bytes(got["content"])

    def delete_blob(self, blob: str) -> bool:
        now = self.snapshot()
        if not self._blob_is_live(now, blob):
            return False
        self._blob_row(now, (blob, None), gone=True)
        return True

    def delete_blobs(self, ids: DataFrame) -> None:
        """Delete the blobs whose ids a DataFrame has in column ``id``; others are passed over."""
        now = self.snapshot()
        folder = self.new_folder("blobs", now)
        x = ids.select("id").distinct().join(self.blobs(now), "id", "left_semi").withColumn("content", F.lit(None).cast("binary"))
        x.repartitionByRange("id").sortWithinPartitions("id").write.parquet(folder)
        self._blob_folder(now, folder, gone=True)

    # Upkeep.

    def maintain(self, now: int | None = None) -> None:
        from spanlake.operators.maintenance import tick

        tick(self, time.time_ns() if now is None else now)

    def purge_key(self, key: str) -> None:
        from spanlake.operators.maintenance import purge_key

        purge_key(self, key)

    def vacuum(self, grace: int | None = None) -> int:
        from spanlake.operators.maintenance import vacuum

        return vacuum(self, grace)

    def stats(self) -> dict[str, Any]:
        """Counters and gauges of the newest commit; ``rows_stored`` counts stored writes, not live records."""
        now = self.snapshot()
        c, flushed = now.counters, now.counters.get("bytes_flushed", 0)
        tiers = {f"files_{t}": sum(z.tier == t for z in now.zones) for t in ("hot", "cold", "remote")}
        return tiers | {
            "commit": now.id, "rows_stored": sum(z.count for z in now.zones), "bytes_stored": sum(z.bytes for z in now.zones), "blobs": now.n_blobs,
            "rows_buffered": len(self.buffer), "write_amplification": 1 + c.get("bytes_compacted", 0) / flushed if flushed else 0.0,
        } | {k: c.get(k, 0) for k in ("rows_written", "bytes_flushed", "bytes_compacted", "compactions", "rows_expired", "rows_reclaimed", "files_dropped", "files_tiered", "files_migrated", "purges")}

    def close(self) -> None:
        self.flush()
        self.closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


__all__ = ["RECORD_SCHEMA", "Config", "Store"]
