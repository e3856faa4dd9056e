"""Queries that write the adapted tables into a store and read them back through its files, commits and upkeep."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.metrics import content_id
from spanlake.operators import maintenance, read
from spanlake.operators.reclaim import dead_rows
from spanlake.operators.retention import kept as unexpired
from spanlake.plans.spec import TS_DESC, OrderBy, QuerySpec
from spanlake.plans.zones import may_match
from spanlake.queries import DAY, HI, LO, POLICY, SPAN, TTL, T, query
from spanlake.schema import RECORD_COLUMNS
from spanlake.sources import adapters
from spanlake.sources.shared import new_folder
from spanlake.sources.store import HOUR, Config, Store
from spanlake.streaming.ingest import ingest

PLAIN = Config(promote_labels=("event_type",), promote_metrics=("value",), hot_ttl=None, early_files=2)
_made: dict[tuple, Store] = {}


def fresh(spark: SparkSession, config: Config = PLAIN) -> Store:
    return Store(spark, new_folder(spark, "store"), config)


def fill(store: Store, log: DataFrame, parts: int = 4) -> Store:
    """Write a log in its order, in some batches, by one pass over it."""
    top = log.agg(F.max("seq")).first()[0] or 0
    # Part k is where (seq * parts) div (top + 1) = k, that is how many of the parts' starts but the first lie at or before seq.
    starts = [-(-k * (top + 1) // parts) for k in range(1, parts)]
    number = sum(((F.col("seq") >= s).cast("long") for s in starts), F.lit(0))
    store.put_batches(log.where(F.col("seq").between(0, top)), order=["seq"], number=number, batches=[f"part-{k}" for k in range(parts)])
    return store


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Store]) -> Store:
    """A store that queries only read is made once for a session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _made:
        _made[at] = make()
    return _made[at]


def spans(spark: SparkSession, sf_dir: str) -> Store:
    return kept(spark, sf_dir, "spans", lambda: fill(fresh(spark), adapters.spans(spark, sf_dir)))


def ops(spark: SparkSession, sf_dir: str, config: Config = PLAIN) -> Store:
    return fill(fresh(spark, config), adapters.oplog(spark, sf_dir))


def some_ops(spark: SparkSession, sf_dir: str) -> Store:
    return kept(spark, sf_dir, "ops", lambda: ops(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> Store:
    config = Config(promote_labels=("lang",), hot_ttl=None, index_rows=1, index_keys=5000)
    return kept(spark, sf_dir, "texts", lambda: fill(fresh(spark, config), adapters.docs(spark, sf_dir).where("seq is not null"), 2))


def show(df: DataFrame) -> DataFrame:
    at = lambda m, n: F.col(m)[F.lit(n)]
    return df.select("key", "ts", at("labels", "event_type").alias("event_type"), at("labels", "user").alias("user_label"), at("numerics", "value").alias("value"))


def show_total(df: DataFrame) -> DataFrame:
    return df.select("key", "ts", F.col("labels")[F.lit("event_type")].alias("event_type"), F.round(F.col("numerics")[F.lit("value")], 2).alias("total"))


def over_store(name: str, spec: QuerySpec, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(spans(spark, sf_dir).scan(spec))

    run.__name__ = name
    query(f"SELECT {SPAN} FROM spans {sql}", "spans")(run)


over_store("store_scan_all", QuerySpec(), "")
over_store("store_scan_time_range", QuerySpec(time_range=(LO, HI)), f"WHERE ts BETWEEN {LO} AND {HI}")
over_store("store_scan_label", QuerySpec(labels={"event_type": "click"}), "WHERE event_type = 'click'")
over_store("store_scan_composed", QuerySpec(time_range=(LO, T), labels={"event_type": "purchase", "user": "u7"}, ranges={"value": (5, 90)}, key_prefix="s/0"), f"WHERE ts BETWEEN {LO} AND {T} AND event_type = 'purchase' AND user_label = 'u7' AND value BETWEEN 5 AND 90 AND starts_with(key, 's/0')")
over_store("store_topk", QuerySpec(labels={"event_type": "purchase"}, ranges={"value": (20, 90)}, order_by=OrderBy("value"), limit=50), "WHERE event_type = 'purchase' AND value BETWEEN 20 AND 90 ORDER BY value DESC, key LIMIT 50")
over_store("store_newest_page", QuerySpec(order_by=TS_DESC, limit=50), "ORDER BY ts DESC, key LIMIT 50")


@query(f"SELECT {SPAN} FROM spans ORDER BY ts DESC, key LIMIT 50 OFFSET 50", "spans")
def store_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, spec = spans(spark, sf_dir), QuerySpec(order_by=TS_DESC, limit=50)
    last = store.scan(spec).select("ts", "key").collect()[-1]
    return show(store.scan(read.next_page(spec, *last)))


@query("SELECT count(*) AS n FROM spans WHERE event_type = 'click' AND value BETWEEN 10 AND 50", "spans")
def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spans(spark, sf_dir).count(QuerySpec(labels={"event_type": "click"}, ranges={"value": (10, 50)}, limit=3))
    return spark.createDataFrame([(n,)], "n long")


@query(f"SELECT {SPAN} FROM spans WHERE key IN ('s/00000042', 's/00000777')", "spans")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = spans(spark, sf_dir)
    found = [store.get(k) for k in ("s/00000042", "s/00000777", "s/none")]
    rows = [(r["key"], r["ts"], r["labels"].get("event_type"), r["labels"].get("user"), r["numerics"].get("value")) for r in found if r is not None]
    return spark.createDataFrame(rows, "key string, ts long, event_type string, user_label string, value double")


@query(f"SELECT file FROM zones WHERE max_ts >= {LO} AND min_ts <= {HI} AND max_value >= 99 AND min_key < 's/1' AND max_key >= 's/0'", "zones")
def store_file_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each thousand events; those that a query must read, by the zones of the files."""
    store = fresh(spark, replace(PLAIN, max_segment_records=1000))
    log = adapters.spans(spark, sf_dir).select(*RECORD_COLUMNS, "seq", "op")
    top = log.agg(F.max("seq")).first()[0] or 0
    # A task holds whole thousands in order, so each of them comes to a file of its own.
    parts = log.withColumn("k", F.expr("seq div 1000")).repartitionByRange(top // 1000 + 1, "k").sortWithinPartitions("k", "key")
    zones = store.write_files(parts, store.snapshot(), arranged=True)
    spec = QuerySpec(time_range=(LO, HI), ranges={"value": (99, 1000)}, labels={"event_type": "view"}, key_prefix="s/0")
    return spark.createDataFrame([(z.min_seq // 1000,) for z in zones if may_match(z, spec)], "file long")


@query("SELECT count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts, min(key) AS min_key, max(key) AS max_key, min(value) AS min_value, max(value) AS max_value, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM spans", "spans")
def store_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commit says of all files together; rows of the driver's list, no scan."""
    z = spans(spark, sf_dir).snapshot().zones
    values, types = [v for x in z for v in x.numerics["value"]], sorted({v for x in z for v in x.labels["event_type"]})
    row = (sum(x.count for x in z), min(x.min_ts for x in z), max(x.max_ts for x in z), min(x.min_key for x in z), max(x.max_key for x in z), min(values), max(values), ",".join(types))
    return spark.createDataFrame([row], "n_rows long, min_ts long, max_ts long, min_key string, max_key string, min_value double, max_value double, types string")


# Writes.

SMALL = "(VALUES ('a', 5, 'y', 7.5), ('c', 9, NULL, 4.0), ('e', 2, 'x', NULL), ('f', 3, NULL, 1.5)) t(key, ts, kind, total)"


def small_writes(store: Store) -> None:
    store.put("a", 1, {"kind": "x"}, {"n": 1.0}, b"1")
    store.put_batch([("b", 1, {"kind": "x"}, {}, b"", None), ("a", 4, {"kind": "y"}, {"n": 7.0}, b"2", "t"), ("d", 1, {}, {"n": 2.0}, b"", None)])
    store.delete("b", 2)
    store.incr("c", 9, {"n": 1.0})
    store.put("e", 2, {"kind": "x"})
    store.incr("a", 5, {"n": 0.5})
    store.incr("c", 3, {"n": 3.0})
    store.put("d", 7, {"del": "1"})
    store.delete("f", 8)
    store.incr("f", 3, {"n": 1.5})


def small_view(df: DataFrame) -> DataFrame:
    return df.select("key", "ts", F.col("labels")["kind"].alias("kind"), F.col("numerics")["n"].alias("total"))


@query(f"SELECT key, ts::BIGINT AS ts, kind, total::DOUBLE AS total FROM {SMALL}")
def store_small_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts, deletes and increments one by one, each its own commit."""
    store = fresh(spark)
    small_writes(store)
    return small_view(store.scan(QuerySpec()))


@query(f"SELECT key, ts::BIGINT AS ts, kind, total::DOUBLE AS total FROM {SMALL}")
def store_buffered_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same writes, read while they are in the buffer."""
    store = fresh(spark, replace(PLAIN, fsync="os"))
    small_writes(store)
    assert not store.snapshot().zones
    return small_view(store.scan(QuerySpec()))


@query(f"SELECT key, ts::BIGINT AS ts, kind, total::DOUBLE AS total FROM {SMALL}")
def store_closed_and_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same writes with every third one committed; closing flushes the rest and another store reads them."""
    store = fresh(spark, replace(PLAIN, fsync=3))
    small_writes(store)
    store.close()
    return small_view(Store(spark, store.root, PLAIN).scan(QuerySpec()))


@query("SELECT i AS step, i * (i + 1) / 2 + 0.0 AS total FROM range(1, 6) t(i)")
def store_incr_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fresh(spark)
    return spark.createDataFrame([(k, store.incr("c", k, {"n": float(k)})["n"]) for k in range(1, 6)], "step long, total double")


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def store_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_total(some_ops(spark, sf_dir).scan(QuerySpec()))


@query("SELECT key, ts, event_type, total FROM folded WHERE total BETWEEN 50 AND 200 AND event_type = 'signup'", "folded")
def store_range_on_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_total(some_ops(spark, sf_dir).scan(QuerySpec(labels={"event_type": "signup"}, ranges={"value": (49.999, 200.001)})))


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def store_repeated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch sent twice; each is written once."""
    store = ops(spark, sf_dir)
    return show_total(fill(store, adapters.oplog(spark, sf_dir)).scan(QuerySpec()))


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def store_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of micro-batches, run twice with one checkpoint."""
    store, at = fresh(spark), new_folder(spark, "stream")
    log = adapters.oplog(spark, sf_dir).select(*RECORD_COLUMNS, "seq", "op")
    # One file, as a file source reads files in no stated order.
    log.coalesce(1).write.parquet(f"{at}/in")
    for _ in range(2):
        q = ingest(spark.readStream.schema(log.schema).parquet(f"{at}/in"), store, f"{at}/checkpoint", order=["seq"], available_now=True)
        q.awaitTermination()
    return show_total(store.scan(QuerySpec()))


@query(f"SELECT {SPAN} FROM spans WHERE event_type = 'click' AND value BETWEEN 10 AND 20", "spans")
def store_promoted_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half written before names were promoted, half after; one of the older files is migrated."""
    log = adapters.spans(spark, sf_dir)
    store = fresh(spark, Config(hot_ttl=None))
    store.put_batch(log.where("seq % 2 = 0"), order=["seq"])
    store = Store(spark, store.root, PLAIN)
    store.put_batch(log.where("seq % 2 = 1"), order=["seq"])
    maintenance.migrate(store)
    return show(store.scan(QuerySpec(labels={"event_type": "click"}, ranges={"value": (10, 20)})))


# Upkeep.


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def store_compacted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two middle batches merged."""
    store = ops(spark, sf_dir)
    # A batch has a folder of its own.
    z = sorted(store.snapshot().zones, key=lambda z: z.min_seq)
    folders = list(dict.fromkeys(x.file.rpartition("/")[0] for x in z))
    maintenance.compact(store, 0, [x for x in z if x.file.rpartition("/")[0] in folders[1:3]])
    return show_total(store.scan(QuerySpec()))


@query("SELECT key, ts, event_type, total FROM folded WHERE key >= 'u/0000'", "folded")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merged, read after a vacuum without grace."""
    store = ops(spark, sf_dir)
    maintenance.compact_all(store, 0)
    store.vacuum(0)
    return show_total(store.scan(QuerySpec()))


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def store_ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole rounds of upkeep with small caps."""
    store = ops(spark, sf_dir, replace(PLAIN, compact_min_segments=2, max_segment_records=2000))
    for _ in range(2):
        store.maintain(0)
    return show_total(store.scan(QuerySpec()))


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def store_reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ops(spark, sf_dir, replace(PLAIN, max_segment_records=300))
    maintenance.reclaim(store)
    return show_total(store.scan(QuerySpec()))


LATER = T + 16 * DAY
UNEXPIRED = f"SELECT key, ts, event_type, total FROM folded WHERE ts >= {LATER} - {TTL}"


@query(UNEXPIRED, "folded")
def store_groomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ops(spark, sf_dir, replace(PLAIN, retention=POLICY))
    maintenance.groom(store, LATER)
    return show_total(store.scan(QuerySpec()))


@query(UNEXPIRED, "folded")
def store_groomed_beside_cold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half is cold when the rest is written; after grooming the cold files' own records are looked at as well."""
    store, log = fresh(spark, replace(PLAIN, retention=POLICY, hot_ttl=HOUR)), adapters.oplog(spark, sf_dir)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    store.put_batch(log.where(F.col("seq") <= half), order=["seq"])
    maintenance.tier(store, time.time_ns() + 2 * HOUR)
    store.put_batch(log.where(F.col("seq") > half), order=["seq"])
    maintenance.groom(store, LATER)
    return show_total(unexpired(store.scan(QuerySpec()), POLICY, LATER))


@query(UNEXPIRED, "folded")
def store_compacted_with_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ops(spark, sf_dir, replace(PLAIN, retention=POLICY))
    maintenance.compact_all(store, LATER)
    return show_total(store.scan(QuerySpec()))


@query(f"SELECT {SPAN}, 'remote' AS tier FROM spans WHERE value >= 50", "spans")
def store_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files copied to the cold root, then to the remote one; the copies behind are vacuumed."""
    roots = {n: new_folder(spark, n) for n in ("cold", "remote")}
    store = fill(fresh(spark, replace(PLAIN, hot_ttl=HOUR, remote_ttl=HOUR, cold_root=roots["cold"], remote_root=roots["remote"])), adapters.spans(spark, sf_dir), 2)
    for _ in range(2):
        maintenance.tier(store, time.time_ns() + 2 * HOUR)
    store.vacuum(0)
    tiers = sorted({z.tier for z in store.snapshot().zones})
    return show(Store(spark, store.root, store.config).scan(QuerySpec(ranges={"value": (50, 1e9)}))).withColumn("tier", F.lit(",".join(tiers)))


@query("SELECT key, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM oplog WHERE op <> 'incr') WHERE k = 1 AND op <> 'del' AND key <> 'u/000042'", "oplog")
def store_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fill(fresh(spark), adapters.oplog(spark, sf_dir).where("op <> 'incr'"))
    for _ in range(2):
        store.purge_key("u/000042")
    return show_total(store.scan(QuerySpec())).drop("total")


@query("SELECT (SELECT count(*) FROM oplog) AS rows_written, (SELECT count(*) FROM folded) AS rows_stored, 1::BIGINT AS compactions, true AS amplified", "folded")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ops(spark, sf_dir)
    maintenance.compact_all(store, 0)
    s = store.stats()
    return spark.createDataFrame([(s["rows_written"], s["rows_stored"], s["compactions"], s["write_amplification"] > 1)], "rows_written long, rows_stored long, compactions long, amplified boolean")


@query(f"SELECT file, n_rows, n_dead FROM (SELECT seq * 4 // (SELECT max(seq) + 1 FROM oplog) AS file, count(*) AS n_rows, sum(dead::INT)::BIGINT AS n_dead FROM (SELECT *, coalesce(seq < base, false) OR (op = 'del' AND count(*) OVER (PARTITION BY key) = 1) AS dead FROM based) GROUP BY 1)", "based")
def store_dead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead rows of each batch, from the slim columns of the store's files."""
    store = some_ops(spark, sf_dir)
    sizes, first, edges = store.snapshot(), 1, []
    log = adapters.oplog(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] or 0
    counts = {r["b"]: r["n"] for r in log.groupBy(F.expr(f"(seq * 4) div {top + 1}").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for b in sorted(counts):
        edges.append((b, first, first + counts[b] - 1))
        first += counts[b]
    x = dead_rows(store.log(sizes.zones).select("key", "seq", "op"))
    x = x.join(F.broadcast(spark.createDataFrame(edges, "file long, lo long, hi long")), F.col("seq").between(F.col("lo"), F.col("hi")))
    return x.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("dead").cast("long")).alias("n_dead"))


# Text.


def over_texts(name: str, spec: QuerySpec, sql: str, cte: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).scan(spec).select("key", F.col("labels")["lang"].alias("lang"))

    run.__name__ = name
    query(f"SELECT key, lang FROM {cte} WHERE {sql}", cte)(run)


over_texts("store_text_match", QuerySpec(text_match="though from"), "list_contains(toks, 'though') AND list_contains(toks, 'from')", "tokens")
over_texts("store_text_match_label", QuerySpec(text_match="THE", labels={"lang": "en"}), "list_contains(toks, 'the') AND lang = 'en'", "tokens")
over_texts("store_text_like_token", QuerySpec(text_like="% through %"), "text LIKE '% through %'", "docs")
over_texts("store_text_like_prefix", QuerySpec(text_like="The%"), "text LIKE 'The%'", "docs")
over_texts("store_text_like_infix", QuerySpec(text_like="%ough%"), "text LIKE '%ough%'", "docs")


@query("SELECT token, count(*) AS n FROM (SELECT DISTINCT key, unnest(toks) AS token FROM tokens) WHERE starts_with(token, 'th') GROUP BY token", "tokens")
def store_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written postings of the texts, by token."""
    folders = sorted({z.index for z in texts(spark, sf_dir).snapshot().zones if z.index})
    index = spark.read.schema("token string, key string").parquet(*folders)
    return index.where(F.col("token").startswith("th")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, lang, CAST(NULL AS VARCHAR) AS text FROM docs WHERE text LIKE '%the%'", "docs")
def store_omit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).scan(QuerySpec(text_like="%the%", omit_text=True)).select("key", F.col("labels")["lang"].alias("lang"), "text")


# Blobs.


def contents(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(where).select(F.encode("text", "UTF-8").alias("content"))


@query("SELECT DISTINCT sha256(text) AS id FROM documents WHERE text IS NOT NULL")
def store_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as blobs, a part of them twice."""
    store = fresh(spark)
    store.put_blobs(contents(spark, sf_dir, "doc_id % 3 = 0"))
    store.put_blobs(contents(spark, sf_dir))
    return store.blobs()


@query("SELECT DISTINCT sha256(text) AS id, 'swept' AS state FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def store_blobs_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of English texts deleted and swept; what is left are the stored contents themselves."""
    store = fresh(spark)
    store.put_blobs(contents(spark, sf_dir))
    store.delete_blobs(contents(spark, sf_dir, "lang = 'en' and text is not null").select(content_id(F.col("content")).alias("id")))
    maintenance.sweep_blobs(store)
    store.vacuum(0)
    folders = [b.folder for b in store.snapshot().blobs]
    stored = store._blob_rows(folders) if folders else spark.createDataFrame([], "id string, content binary")
    return stored.select(content_id(F.col("content")).alias("id"), F.lit("swept").alias("state"))


@query("SELECT sha256(text) AS id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY text ORDER BY 1 LIMIT 3")
def store_blob_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = fresh(spark)
    store.put_blobs(contents(spark, sf_dir))
    ids = [r["id"] for r in store.blobs().orderBy("id").limit(3).collect()]
    return spark.createDataFrame([(i, len(store.get_blob(i))) for i in ids], "id string, n_bytes long")

