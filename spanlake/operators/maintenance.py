"""Upkeep of a store as batch jobs: compaction, retention, reclaim, tiers, purge, migration, blob sweep and vacuum.

Each job reads whole files, writes new ones and swaps the lists in one commit, counters included. Choices are made on the
commit's zones, so they cost no scan.
"""

from __future__ import annotations

import time
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.plans.zones import Overlap, Zone, alone
from spanlake.schema import LOG_COLUMNS
from spanlake.sources.files import copy_on_executors, short, spelled

from .fold import fold
from .reclaim import dead_rows
from .retention import expired

if TYPE_CHECKING:
    from spanlake.sources.store import Config, Store

#: Files of one size tier differ by less than this factor.
TIER_FACTOR = 4


def tick(store: Store, now: int) -> None:
    """One round, in a fixed order."""
    store.flush()
    compact(store, now)
    reclaim(store, store.config.reclaim_files_per_tick)
    tier(store, now)
    groom(store, now)
    migrate(store)
    if store.ticks % store.config.blob_sweep_every_n_ticks == 0:
        sweep_blobs(store)
    store.ticks += 1


def mergeable(z: Zone, config: Config) -> bool:
    """A hot file below the caps; a file at a cap is sealed and only reclaim or retention rewrite it."""
    return z.tier == "hot" and z.count < config.max_segment_records and z.bytes < config.max_segment_bytes // 2


def stretches_of(zones: list[Zone], config: Config) -> list[list[Zone]]:
    """Neighbours in write order that may be merged; a sealed or colder file parts them."""
    out: list[list[Zone]] = [[]]
    for z in sorted(zones, key=lambda z: (z.max_seq, z.min_key.encode())):
        if mergeable(z, config):
            out[-1].append(z)
        elif out[-1]:
            out.append([])
    return [s for s in out if s]


def same_tier_run(stretch: list[Zone]) -> list[Zone]:
    """The longest, and of those the first, run whose largest file has less than TIER_FACTOR times the rows of its least.

    Two pointers: the window's extremes stand in queues, so each file enters and leaves once.
    """
    best, first, lows, highs = (0, 0), 0, [], []
    low_at = high_at = 0
    for k, z in enumerate(stretch):
        while len(lows) > low_at and stretch[lows[-1]].count >= z.count:
            lows.pop()
        while len(highs) > high_at and stretch[highs[-1]].count <= z.count:
            highs.pop()
        lows.append(k)
        highs.append(k)
        while stretch[highs[high_at]].count >= TIER_FACTOR * max(stretch[lows[low_at]].count, 1):
            first += 1
            low_at += lows[low_at] < first
            high_at += highs[high_at] < first
        if k + 1 - first > best[1] - best[0]:
            best = (first, k + 1)
    return stretch[best[0] : best[1]]


def choose_run(zones: list[Zone], config: Config) -> list[Zone]:
    """Files to merge: the longest run of one size tier, if it has the least number of files (two at least, but for a single
    one where retention may drop rows); else, where files in all have grown to four times that number, the longest stretch."""
    stretches = stretches_of(zones, config)
    least = max(1, config.compact_min_segments)
    has_policy = bool(config.retention.rows) or config.retention.everything is not None
    run = max(map(same_tier_run, stretches), key=len, default=[])
    if len(run) >= (least if has_policy else max(2, least)):
        return run
    longest = max((s for s in stretches if len(s) >= 2), key=len, default=[])
    return longest if sum(map(len, stretches)) > TIER_FACTOR * least else []


def swap(store: Store, old: list[Zone], rows: DataFrame | None, *, fewer: str | None = None, **counted: int) -> list[Zone]:
    """Replace files by what ``rows`` holds, in one commit. ``fewer``: the counter of the rows that are gone."""
    now = store.snapshot()
    new: list[Zone] = []
    if rows is not None:
        mean = sum(z.bytes for z in old) / max(1, sum(z.count for z in old))
        new = store.write_files(rows, now, mean=mean, most=sum(z.count for z in old), created=max(z.created for z in old))
    gone = {z.id for z in old}
    kept = tuple(z for z in now.zones if z.id not in gone)
    made = replace(now, zones=(*kept, *new), next_file=now.next_file + len(new))
    if fewer:
        counted[fewer] = sum(z.count for z in old) - sum(z.count for z in new)
    store.commits.add(made.counted(bytes_compacted=sum(z.bytes for z in new), files_dropped=len(old) - len(new), **counted))
    return new


def compact(store: Store, now: int, run: list[Zone] | None = None) -> list[Zone]:
    """Merge a run: one row per key. Increments whose base is elsewhere stay increments; deletes stay while another file
    may hold older writes of their keys. Records that have expired go with their whole history."""
    zones = list(store.snapshot().zones)
    run = choose_run(zones, store.config) if run is None else run
    if not run:
        return []
    ids, touches = {z.id for z in run}, Overlap(run)
    others = any(z.id not in ids and touches(z) for z in zones)
    rows = fold(store.log(run), list(store.snapshot().metrics))
    if not others:
        rows = rows.where("op <> 'del'")
    policy = store.config.retention
    if policy.rows or policy.everything is not None:
        ttl = policy.column(F.col("key"))
        old = ttl.isNotNull() & (F.col("ts") < F.lit(now) - ttl)
        # With other files about, an expired winner becomes a delete: it must go on hiding what they hold.
        rows = _as_deletes(rows, old & (F.col("op") == "put")) if others else rows.where(~old)
    return swap(store, run, rows, compactions=1)


def _as_deletes(rows: DataFrame, where) -> DataFrame:
    empty = {"labels": F.create_map().cast("map<string,string>"), "numerics": F.create_map().cast("map<string,double>"), "payload": F.lit(b""), "text": F.lit(None).cast("string"), "op": F.lit("del")}
    return rows.withColumn("_old", where).withColumns({c: F.when(F.col("_old"), v).otherwise(F.col(c)) for c, v in empty.items()}).drop("_old")


def compact_all(store: Store, now: int) -> list[Zone]:
    """One file set with one row per live key, from everything."""
    return compact(store, now, list(store.snapshot().zones))


def groom(store: Store, now: int) -> int:
    """Retention without compaction. Files in which every row must have expired are dropped by their zones alone, if no
    other file shares their keys. Of the rest, hot files with expired winners are rewritten: an expired key's writes leave
    the hot files, and where a colder file may hold older ones a delete stays to hide them. Returns dropped files."""
    policy = store.config.retention
    if not policy.rows and policy.everything is None:
        return 0
    zones = list(store.snapshot().zones)

    def over(z: Zone, ts: int) -> bool:
        ttl = policy.longest_in(z.min_key, z.max_key)
        return ttl is not None and ts < now - ttl

    single = alone(zones)
    gone = [z for z in zones if z.id in single and over(z, z.max_ts)]
    if gone:
        swap(store, gone, None, fewer="rows_expired")
    left = {z.id for z in zones} - {z.id for z in gone}
    shortest = min([t for _, t in policy.rows] + ([policy.everything] if policy.everything is not None else []))
    some = [z for z in zones if z.id in left and z.tier == "hot" and z.min_ts < now - shortest]
    if not some:
        return len(gone)
    # Winners are judged over all files that share keys; of keys in ``some`` every write is in ``near``.
    touches = Overlap(some)
    near = [z for z in zones if z.id in left and touches(z)]
    hot, cold = [z for z in near if z.tier == "hot"], [z for z in near if z.tier != "hot"]
    log = store.log(near)
    if len(some) < len(near):
        log = log.join(store.log(some).select("key").distinct(), "key", "left_semi")
    winners = fold(log, list(store.snapshot().metrics))
    # Kept on disk, as it is asked for more than once and stands on a fold.
    dead = expired(winners.where("op <> 'del'"), policy, now).select("key", "seq", "ts").persist(StorageLevel.DISK_ONLY)
    try:
        if dead.count():
            rows = store.log(hot).join(dead.select("key"), "key", "left_anti").select(*LOG_COLUMNS)
            if cold:
                hidden = dead.join(store.log(cold).select("key").distinct(), "key", "left_semi")
                marks = hidden.select("key", "ts", *[F.lit(None).cast(t).alias(c) for c, t in (("labels", "map<string,string>"), ("numerics", "map<string,double>"), ("payload", "binary"), ("text", "string"))], "seq", F.lit("del").alias("op"))
                rows = rows.unionByName(marks)
            swap(store, hot, rows, fewer="rows_expired")
    finally:
        dead.unpersist()
    return len(gone)


def _number(name: Column) -> Column:
    return F.xxhash64(name)


def reclaim(store: Store, files: int | None = None) -> int:
    """Rewrite sealed hot files in which half the rows or more are dead; returns the rows that went.

    ``files`` sealed files are audited, going on from where the last call ended (all: None), each against the files that
    share its keys, with slim columns only.
    """
    zones = list(store.snapshot().zones)
    sealed = sorted((z for z in zones if z.tier == "hot" and not mergeable(z, store.config)), key=lambda z: z.id)
    if files is not None and len(sealed) > files:
        turn = [z for z in sealed if z.id > store.audited] + [z for z in sealed if z.id <= store.audited]
        sealed = turn[:files]
    if not sealed:
        return 0
    store.audited = sealed[-1].id
    touches = Overlap(sealed)
    near = [z for z in zones if touches(z)]
    # A file's number of eight bytes goes through the shuffle, not its path. Kept on disk, as rows are looked up in it.
    slim = store.log(near, file=True).select("key", "seq", "op", _number(F.substring_index("_file", "/", -2)).alias("_file"))
    marked = dead_rows(slim).select("key", "seq", "_file", "dead").persist(StorageLevel.DISK_ONLY)
    try:
        counts = marked.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dead").cast("long")).alias("dead"))
        bad = {r["_file"] for r in counts.where("dead * 2 >= n").collect()}
        numbers = store.spark.createDataFrame([(z.id, short(z.file)) for z in sealed], "id long, name string").select("id", _number(F.col("name")).alias("n"))
        hit = {r["id"] for r in numbers.collect() if r["n"] in bad}
        chosen = [z for z in sealed if z.id in hit]
        if not chosen:
            return 0
        rows = store.log(chosen).join(marked.where("not dead").select("key", "seq"), ["key", "seq"], "left_semi")
        new = swap(store, chosen, rows, fewer="rows_reclaimed")
    finally:
        marked.unpersist()
    return sum(z.count for z in chosen) - sum(z.count for z in new)


def tier(store: Store, now: int) -> int:
    """Hot to cold and cold to remote by age. Where the colder tier has a root of its own the executors copy the files
    there, the commit points to the copies, and the old ones are left to the vacuum; otherwise files stay in place."""
    c = store.config
    snap = store.snapshot()

    def target(z: Zone) -> str | None:
        if z.tier == "hot" and c.hot_ttl is not None and z.created < now - c.hot_ttl:
            return "cold"
        if z.tier == "cold" and c.remote_ttl is not None and c.remote_root and z.created < now - c.remote_ttl:
            return "remote"
        return None

    roots = {t: store.files.full(r).rstrip("/") if r else None for t, r in (("cold", c.cold_root), ("remote", c.remote_root))}
    moved: dict[int, Zone] = {}
    for z in snap.zones:
        if to := target(z):
            moved[z.id] = replace(z, tier=to, file=f"{roots[to]}/{short(z.file)}" if roots[to] else z.file)
    copies = [(z.file, moved[z.id].file) for z in snap.zones if z.id in moved and moved[z.id].file != z.file]
    if copies:
        copy_on_executors(store.spark, copies)
    if moved:
        store.commits.add(replace(snap, zones=tuple(moved.get(z.id, z) for z in snap.zones)).counted(files_tiered=len(moved)))
    return len(moved)


def migrate(store: Store) -> int:
    """Rewrite one hot file that lacks a promoted column or postings that the store has by now; returns how many."""
    old = [z for z in store.snapshot().zones if z.tier == "hot" and (not set(store.config.promoted) <= set(z.promoted) or (store.config.index_text and z.texts and z.index is None))]
    for z in old[:1]:
        swap(store, [z], store.log([z]), files_migrated=1)
    return len(old[:1])


def purge_key(store: Store, key: str) -> None:
    """Remove every stored write of a key. A key with increments is refused: their total can't be told apart from it."""
    store.flush()
    zones = [z for z in store.snapshot().zones if z.min_key.encode() <= key.encode() <= z.max_key.encode()]
    # A row for each file that holds the key.
    found = store.log(zones, file=True).where(F.col("key") == key).groupBy("_file").agg(F.max(F.col("op") == "incr").alias("incr")).collect() if zones else []
    if any(r["incr"] for r in found):
        raise ValueError(f"{key} holds increments and can't be purged")
    holds = {short(r["_file"]) for r in found}
    if chosen := [z for z in zones if short(z.file) in holds]:
        swap(store, chosen, store.log(chosen).where(F.col("key") != key), purges=1)


def sweep_blobs(store: Store) -> int:
    """Rewrite blob folders that hold deleted contents without them, and drop the deletions; returns the rows that went."""
    now = store.snapshot()
    if not any(b.gone for b in now.blobs):
        return 0
    log = store.blob_log(now)
    last = log.groupBy("id").agg(F.max_by("gone", "number").alias("gone"), F.max("number").alias("number"))
    # A row per folder: contents that are deleted, or were put again later.
    dead = log.where("not gone").join(last.withColumnRenamed("number", "top").withColumnRenamed("gone", "dead"), "id").where("dead or number < top")
    hit = {r["folder"] for r in dead.select("folder").distinct().collect()}
    old = [b for b in now.blobs if not b.gone and b.folder in hit]
    kept = tuple(b for b in now.blobs if not b.gone and b.folder not in hit)
    if old:
        folder = store.new_folder("blobs", now)
        live = store._blob_rows([b.folder for b in old]).join(last.where("not gone").select("id"), "id", "left_semi").groupBy("id").agg(F.any_value("content").alias("content"))
        # What is kept elsewhere is not written again.
        if kept:
            live = live.join(store.blobs(replace(now, blobs=kept)), "id", "left_anti")
        live.repartitionByRange("id").sortWithinPartitions("id").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").parquet(folder)
        r = store._blob_rows([folder]).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        if r["n"]:
            kept = (*kept, replace(old[0], folder=folder, number=max(b.number for b in now.blobs) + 1, low=r["low"], high=r["high"], rows=r["n"]))
    store.commits.add(replace(now, blobs=kept))
    return sum(b.rows for b in now.blobs if not b.gone) - sum(b.rows for b in kept)


def vacuum(store: Store, grace: int | None = None, *, tiers: tuple[str, ...] = ("hot", "cold", "remote")) -> int:
    """Delete files that no commit lists and that have not changed for ``grace`` nanoseconds (so that running reads and
    writes keep theirs): data, postings, blobs and commits behind a checkpoint. Returns deleted data files."""
    before = time.time_ns() - (store.config.vacuum_grace if grace is None else grace)
    now, files = store.snapshot(), store.files
    live = {spelled(z.file) for z in now.zones}
    roots = {"hot": f"{store.root}/hot", "cold": store.config.cold_root, "remote": store.config.remote_root}
    n = 0
    for name in tiers:
        for folder in files.entries(roots[name]) if roots[name] else []:
            inside = list(files.tree(folder.path)) if folder.is_dir else [folder]
            dead = [e for e in inside if spelled(e.path) not in live]
            if any(e.changed > before for e in inside):
                continue
            n += sum(e.name.endswith(".parquet") for e in dead)
            for e in [folder] if len(dead) == len(inside) else dead:
                files.delete(e.path)
    if len(tiers) == 3:
        used = {"index": {spelled(z.index) for z in now.zones if z.index}, "blobs": {spelled(b.folder) for b in now.blobs}}
        for kind, kept in used.items():
            for folder in files.entries(f"{store.root}/{kind}"):
                if folder.changed <= before and spelled(folder.path) not in kept:
                    files.delete(folder.path)
        store.commits.trim(before)
    return n
