"""The catalogue: one query for each operator, over the adapted tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.metrics import content_id
from spanlake.operators import read, text_index
from spanlake.operators.fold import fold, last_writes, resolve
from spanlake.operators.reclaim import dead_per_file, dead_rows
from spanlake.operators.retention import Policy, kept
from spanlake.plans.spec import TS_ASC, TS_DESC, OrderBy, QuerySpec
from spanlake.plans.zones import disjointness, may_match, suffix_max, zone_maps, zones_of
from spanlake.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-16 00:00:00 UTC in nanoseconds, the fixed "now" of retention and tiers.
T = 1_705_363_200_000_000_000
DAY = 86_400_000_000_000
LO, HI = T - 5 * DAY, T - 4 * DAY

CTES = {
    "spans": """spans AS (SELECT 's/' || lpad(event_id::VARCHAR, 8, '0') AS key, epoch_ns(ts) AS ts, event_id AS seq, event_type, 'u' || user_id AS user_label, value FROM events)""",
    "oplog": """oplog AS (SELECT 'u/' || lpad(user_id::VARCHAR, 6, '0') AS key, epoch_ns(ts) AS ts, event_id AS seq,
  CASE WHEN event_type = 'error' THEN 'del' WHEN event_type IN ('purchase', 'signup') THEN 'put' ELSE 'incr' END AS op, event_type, value FROM events)""",
    "docs": """docs AS (SELECT 'd/' || lpad(doc_id::VARCHAR, 8, '0') AS key, doc_id AS ts, lang, source, text FROM documents)""",
}
CTES["based"] = CTES["oplog"] + ", based AS (SELECT *, max(CASE WHEN op <> 'incr' THEN seq END) OVER (PARTITION BY key) AS base FROM oplog)"
CTES["folded"] = (
    CTES["based"]
    + """, live AS (SELECT * FROM based WHERE base IS NULL OR seq >= base),
folded AS (SELECT key, max(CASE WHEN op <> 'del' THEN ts END) AS ts, max(CASE WHEN seq = base AND op = 'put' THEN event_type END) AS event_type,
  round(sum(CASE WHEN op <> 'del' THEN value::DECIMAL(18, 2) ELSE 0 END)::DOUBLE, 2) AS total FROM live GROUP BY key HAVING count(CASE WHEN op <> 'del' THEN 1 END) > 0)"""
)
CTES["tokens"] = CTES["docs"] + r""", tokens AS (SELECT key, lang, text, list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda t: t <> ''), lambda t: lower(t)) AS toks FROM docs WHERE text IS NOT NULL)"""


def query(sql: str | None = None, cte: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {CTES[cte]} " if cte else "") + sql
        return f

    return add


SPAN = "key, ts, event_type, user_label, value"


def show_spans(df: DataFrame) -> DataFrame:
    return df.select("key", "ts", F.col("l_event_type").alias("event_type"), F.col("l_user").alias("user_label"), F.col("n_value").alias("value"))


def over_spans(name: str, spec: QuerySpec, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show_spans(read.scan(adapters.spans(spark, sf_dir), spec))

    run.__name__ = name
    query(f"SELECT {SPAN} FROM spans {sql}", "spans")(run)


over_spans("scan_all", QuerySpec(), "")
over_spans("scan_time_range", QuerySpec(time_range=(LO, HI)), f"WHERE ts BETWEEN {LO} AND {HI}")
over_spans("scan_label_eq", QuerySpec(labels={"event_type": "click"}), "WHERE event_type = 'click'")
over_spans("scan_label_absent", QuerySpec(labels={"region": "north"}), "WHERE false")
over_spans("scan_two_labels", QuerySpec(labels={"event_type": "view", "user": "u7"}), "WHERE event_type = 'view' AND user_label = 'u7'")
over_spans("scan_numeric_range", QuerySpec(ranges={"value": (10, 20)}), "WHERE value BETWEEN 10 AND 20")
over_spans("scan_key_prefix", QuerySpec(key_prefix="s/000000"), "WHERE starts_with(key, 's/000000')")
over_spans("scan_composed", QuerySpec(time_range=(LO, T), labels={"event_type": "purchase"}, ranges={"value": (5, 60)}, key_prefix="s/0000"), f"WHERE ts BETWEEN {LO} AND {T} AND event_type = 'purchase' AND value BETWEEN 5 AND 60 AND starts_with(key, 's/0000')")
over_spans("order_ts_desc_limit", QuerySpec(order_by=TS_DESC, limit=50), "ORDER BY ts DESC, key LIMIT 50")
over_spans("order_ts_asc_limit", QuerySpec(order_by=TS_ASC, limit=50), "ORDER BY ts, key LIMIT 50")
over_spans("order_numeric_desc_limit", QuerySpec(order_by=OrderBy("value"), limit=50), "ORDER BY value DESC NULLS LAST, key LIMIT 50")
over_spans("scan_label_numeric_topk", QuerySpec(labels={"event_type": "purchase"}, ranges={"value": (20, 90)}, order_by=OrderBy("value"), limit=50), "WHERE event_type = 'purchase' AND value BETWEEN 20 AND 90 ORDER BY value DESC, key LIMIT 50")


@query(f"SELECT {SPAN} FROM spans WHERE key = 's/00000042'", "spans")
def get_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_spans(read.get(adapters.spans(spark, sf_dir), "s/00000042"))


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose metric is NaN for every seventh and missing for every eleventh event."""
    v = F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).when(F.col("seq") % 11 == 0, None).otherwise(F.col("n_value"))
    return adapters.spans(spark, sf_dir).withColumn("n_value", v)


GAPS = "(SELECT key, ts, seq, CASE WHEN seq % 7 = 0 THEN 'nan'::DOUBLE WHEN seq % 11 = 0 THEN NULL ELSE value END AS v FROM spans)"


@query(f"SELECT key, v AS value FROM {GAPS} WHERE v >= 10 AND v <= 1e300 AND NOT isnan(v)", "spans")
def scan_numeric_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = with_gaps(spark, sf_dir)
    return read.scan(x, QuerySpec(ranges={"value": (10, float("inf"))})).select("key", F.col("n_value").alias("value"))


@query(f"SELECT key FROM {GAPS} ORDER BY CASE WHEN NOT isnan(v) THEN v END NULLS LAST, key LIMIT (SELECT count(*) - 100 FROM spans)", "spans")
def order_numeric_asc_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = with_gaps(spark, sf_dir)
    return read.scan(x, QuerySpec(order_by=OrderBy("value", descending=False), limit=x.count() - 100)).select("key")


def page_after(state: DataFrame, spec: QuerySpec) -> DataFrame:
    """The page that follows the spec's first one; the cursor is the first page's last row."""
    first = read.scan(state, spec).select("ts", "key").collect()
    return read.scan(state, read.next_page(spec, *first[-1]))


@query(f"SELECT {SPAN} FROM spans ORDER BY ts DESC, key LIMIT 50 OFFSET 50", "spans")
def keyset_desc_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_spans(page_after(adapters.spans(spark, sf_dir), QuerySpec(order_by=TS_DESC, limit=50)))


@query(f"SELECT {SPAN} FROM spans ORDER BY ts, key LIMIT 50 OFFSET 50", "spans")
def keyset_asc_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_spans(page_after(adapters.spans(spark, sf_dir), QuerySpec(order_by=TS_ASC, limit=50)))


@query("SELECT key, ts FROM spans WHERE event_type = 'signup' AND user_label = 'u3'", "spans")
def keyset_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a scan; the driver holds one cursor at a time."""
    state, spec, pages = adapters.spans(spark, sf_dir), QuerySpec(labels={"event_type": "signup", "user": "u3"}, order_by=TS_DESC, limit=20), []
    while True:
        page = read.scan(state, spec).select("ts", "key")
        rows = page.collect()
        pages.append(page)
        if len(rows) < spec.limit:
            return reduce(DataFrame.unionByName, pages).select("key", "ts")
        spec = read.next_page(spec, *rows[-1])


@query("SELECT count(*) AS n FROM spans WHERE event_type = 'click' AND value BETWEEN 10 AND 50", "spans")
def count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.count(adapters.spans(spark, sf_dir), QuerySpec(labels={"event_type": "click"}, ranges={"value": (10, 50)}, limit=3))


@query("SELECT key, lang, source, CAST(NULL AS VARCHAR) AS text FROM docs WHERE text LIKE '%the%'", "docs")
def scan_omit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_docs(read.scan(adapters.docs(spark, sf_dir), QuerySpec(text_like="%the%", omit_text=True)), text=True)


# Resolution of the write log.


def show_ops(df: DataFrame) -> DataFrame:
    return df.select("key", "ts", F.col("labels")["event_type"].alias("event_type"), F.round(F.col("numerics")["value"], 2).alias("total"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(adapters.oplog(spark, sf_dir), ["value"])


@query("SELECT key, ts, seq, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM oplog) WHERE k = 1", "oplog")
def lww_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.spans(spark, sf_dir)
    x = last_writes(e.withColumn("key", F.concat(F.lit("u/"), F.lpad(F.substring("l_user", 2, 20), 6, "0"))))
    return x.select("key", "ts", "seq", F.col("l_event_type").alias("event_type"), F.col("n_value").alias("value"))


@query("SELECT key, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM oplog) WHERE k = 1 AND event_type = 'click'", "oplog")
def lww_label_filter_after_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.spans(spark, sf_dir).withColumn("key", F.concat(F.lit("u/"), F.lpad(F.substring("l_user", 2, 20), 6, "0")))
    return read.scan(resolve(e, increments=False), QuerySpec(labels={"event_type": "click"})).select("key", "ts")


@query("SELECT key, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM oplog WHERE op <> 'incr') WHERE k = 1 AND op <> 'del'", "oplog")
def tombstone_hides(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.oplog(spark, sf_dir).where("op <> 'incr'")
    return resolve(log, increments=False).select("key", "ts", F.col("l_event_type").alias("event_type"))


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def counter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_ops(totals(spark, sf_dir))


@query("SELECT key, ts, event_type, total FROM folded WHERE total BETWEEN 50 AND 200", "folded")
def counter_range_on_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_ops(read.scan(totals(spark, sf_dir), QuerySpec(ranges={"value": (49.999, 200.001)})))


@query("SELECT key, total FROM folded ORDER BY total DESC, key LIMIT 20", "folded")
def counter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = totals(spark, sf_dir).withColumn("numerics", F.transform_values("numerics", lambda _, v: F.round(v, 2)))
    return show_ops(read.scan(x, QuerySpec(order_by=OrderBy("value"), limit=20))).select("key", "total")


@query("SELECT f.key, f.total FROM folded f JOIN (SELECT DISTINCT key FROM based WHERE seq = base AND op = 'del') USING (key)", "folded")
def delete_then_incr_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that rose again from increments after a delete; they start from zero and have no labels."""
    log = adapters.oplog(spark, sf_dir)
    gone = log.where("op <> 'incr'").groupBy("key").agg(F.max_by("op", "seq").alias("last")).where("last = 'del'")
    return show_ops(resolve(log, ["value"]).join(gone, "key", "left_semi")).select("key", "total")


# Text.


def show_docs(df: DataFrame, text: bool = False) -> DataFrame:
    return df.select("key", F.col("l_lang").alias("lang"), F.col("l_source").alias("source"), *(["text"] if text else []))


def over_docs(name: str, spec: QuerySpec, sql: str, cte: str = "docs") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show_docs(read.scan(adapters.docs(spark, sf_dir), spec)).select("key", "lang")

    run.__name__ = name
    query(f"SELECT key, lang FROM {cte} WHERE {sql}", cte)(run)


over_docs("text_match_and", QuerySpec(text_match="The FROM"), "list_contains(toks, 'the') AND list_contains(toks, 'from')", "tokens")
over_docs("text_match_no_tokens", QuerySpec(text_match="!!!"), "false")
over_docs("text_match_label_composed", QuerySpec(text_match="the", labels={"lang": "en"}), "list_contains(toks, 'the') AND lang = 'en'", "tokens")
over_docs("text_like_prefix", QuerySpec(text_like="The%"), "text LIKE 'The%'")
over_docs("text_like_infix", QuerySpec(text_like="%the%"), "text LIKE '%the%'")
over_docs("text_like_underscore", QuerySpec(text_like="_he %"), "text LIKE '_he %'")


@query("SELECT token, count(*) AS n, count(DISTINCT key) AS docs FROM (SELECT key, unnest(toks) AS token FROM tokens) GROUP BY token", "tokens")
def fts_tokens_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.dictionary(adapters.docs(spark, sf_dir))


def index_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    state = adapters.docs(spark, sf_dir)
    return state, text_index.postings(state)


@query("SELECT key, lang FROM docs WHERE text LIKE '% the %'", "docs")
def text_like_via_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_docs(text_index.match_like(*index_of(spark, sf_dir), "% the %")).select("key", "lang")


@query("SELECT key, lang FROM tokens WHERE list_contains(toks, 'the') AND list_contains(toks, 'from')", "tokens")
def text_match_via_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_docs(text_index.match(*index_of(spark, sf_dir), "the from")).select("key", "lang")


@query("SELECT DISTINCT key FROM (SELECT key, unnest(toks) AS token FROM tokens) WHERE starts_with(token, 'th')", "tokens")
def postings_prefix_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.tokens_with_prefix(index_of(spark, sf_dir)[1], "th")


@query("SELECT token, list_aggregate(list_sort(list(key)), 'string_agg', ',') AS keys FROM (SELECT DISTINCT key, unnest(toks) AS token FROM tokens) WHERE starts_with(token, 'tho') GROUP BY token", "tokens")
def postings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)[1].where(F.col("token").startswith("tho"))
    return index.groupBy("token").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))


# Files, retention, maintenance. A file is a thousand events in write order.

FILE = "seq // 1000"


def in_files(log: DataFrame) -> DataFrame:
    return log.withColumn("file", F.expr("seq div 1000"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_maps(in_files(adapters.spans(spark, sf_dir)), "file")


ZONE_SQL = f"zones AS (SELECT {FILE} AS file, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, min(key) AS min_key, max(key) AS max_key, min(value) AS min_value, max(value) AS max_value, count(DISTINCT event_type) AS n_types, count(DISTINCT user_label) AS n_users, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM spans GROUP BY 1)"
CTES["zones"] = CTES["spans"] + ", " + ZONE_SQL


@query("SELECT file, n, min_ts, max_ts, min_key, max_key, min_value, max_value, types, CASE WHEN n_users <= 64 THEN n_users END AS users_listed FROM zones", "zones")
def zone_map_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir)
    listed = F.when(F.col("labels")["user"].isNotNull(), F.size(F.col("labels")["user"])).cast("long")
    return z.select("file", F.col("count").alias("n"), "min_ts", "max_ts", "min_key", "max_key", F.col("numerics")["value"]["min"].alias("min_value"), F.col("numerics")["value"]["max"].alias("max_value"), F.array_join(F.col("labels")["event_type"], ",").alias("types"), listed.alias("users_listed"))


@query(f"SELECT file FROM zones WHERE max_ts >= {LO} AND min_ts <= {HI} AND max_value >= 99 AND min_key < 's/1' AND max_key >= 's/0'", "zones")
def zone_prune_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a query on time, label and metric must read, by their zones: a row per file, as in a commit."""
    spec = QuerySpec(time_range=(LO, HI), ranges={"value": (99, 1000)}, labels={"event_type": "view"}, key_prefix="s/0")
    number = lambda f: {"id": int(f), "bytes": 0, "created": 0}
    found = zones_of(in_files(adapters.spans(spark, sf_dir)), "file", number)
    return spark.createDataFrame([(z.id,) for z in found if may_match(z, spec)], "file long")


@query("SELECT file, lead(min_key) OVER (ORDER BY min_key) > max_key AS is_disjoint FROM zones", "zones")
def zone_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disjointness(zones(spark, sf_dir).withColumn("id", F.col("file"))).select("file", "is_disjoint")


@query("SELECT file, max(max_ts) OVER (ORDER BY file DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix_max_ts FROM zones", "zones")
def zone_suffix_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_max(zones(spark, sf_dir).withColumn("id", F.col("file"))).select("file", "suffix_max_ts")


POLICY = Policy((("u/", 10 * DAY), ("u/0000", 4 * DAY), ("u/00000", 2 * DAY), ("u/000005", 400 * DAY)))
TTL = f"CASE WHEN starts_with(key, 'u/000005') THEN {400 * DAY} WHEN starts_with(key, 'u/00000') THEN {2 * DAY} WHEN starts_with(key, 'u/0000') THEN {4 * DAY} WHEN starts_with(key, 'u/') THEN {10 * DAY} END"


@query(f"SELECT key, ts, seq FROM oplog WHERE ts >= {T} - {TTL}", "oplog")
def retention_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(adapters.oplog(spark, sf_dir), POLICY, T).select("key", "ts", "seq")


@query(f"SELECT key, ts, event_type, total FROM folded WHERE ts >= {T + 16 * DAY} - {TTL}", "folded")
def retention_after_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_ops(kept(totals(spark, sf_dir), POLICY, T + 16 * DAY))


@query("SELECT key, ts, event_type, total FROM folded", "folded")
def compact_equals_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log folded in four runs in write order, and then as a whole."""
    log = adapters.oplog(spark, sf_dir)
    top = log.agg(F.max("seq")).first()[0] + 1
    runs = [fold(log.where((F.col("seq") * 4 >= k * top) & (F.col("seq") * 4 < (k + 1) * top)), ["value"]) for k in range(4)]
    return show_ops(resolve(reduce(DataFrame.unionByName, runs), ["value"]))


DEAD = "(SELECT *, coalesce(seq < base, false) OR (op = 'del' AND count(*) OVER (PARTITION BY key) = 1) AS dead FROM based)"


@query(f"SELECT {FILE} AS file, count(*) AS n_rows, sum(dead::INT)::BIGINT AS n_dead, sum(dead::INT) * 2 >= count(*) AS rewrite FROM {DEAD} GROUP BY 1", "based")
def reclaim_dead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_per_file(in_files(adapters.oplog(spark, sf_dir)), "file")


@query(f"SELECT key, seq, op FROM {DEAD} WHERE NOT dead", "based")
def reclaim_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_rows(adapters.oplog(spark, sf_dir)).where("not dead").select("key", "seq", "op")


@query("SELECT key, seq FROM oplog WHERE key <> 'u/000042'", "oplog")
def purge_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.oplog(spark, sf_dir).where(F.col("key") != "u/000042").select("key", "seq")


@query("SELECT DISTINCT sha256(text) AS id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.encode("text", "UTF-8").alias("content"))
    return content.select(content_id(F.col("content")).alias("id"), F.octet_length("content").cast("long").alias("n_bytes")).distinct()


@query("SELECT DISTINCT sha256(text) AS id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def blob_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("lang", content_id(F.encode("text", "UTF-8")).alias("id"))
    return d.select("id").distinct().join(d.where("lang = 'en'").select("id"), "id", "left_anti")


def tier_of(ts: Column) -> Column:
    return F.when(ts >= T, "hot").when(ts >= T - 7 * DAY, "cold").otherwise("remote")


@query(f"SELECT CASE WHEN max_ts >= {T} THEN 'hot' WHEN max_ts >= {T - 7 * DAY} THEN 'cold' ELSE 'remote' END AS tier, count(*) AS files, sum(n)::BIGINT AS n_rows FROM zones GROUP BY 1", "zones")
def stats_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zones(spark, sf_dir).withColumn("tier", tier_of(F.col("max_ts")))
    return z.groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("count").alias("n_rows"))


# Breadth: the same reads over the other tables.


@query("SELECT 'l/' || l_orderkey || '/' || l_linenumber AS key, l_quantity AS quantity, l_discount AS discount FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 45 AND 50 ORDER BY l_discount DESC, key LIMIT 100")
def items_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = adapters.items(spark, sf_dir)
    x = read.scan(x, QuerySpec(labels={"returnflag": "R"}, ranges={"quantity": (45, 50)}, order_by=OrderBy("discount"), limit=100))
    return x.select("key", F.col("n_quantity").alias("quantity"), F.col("n_discount").alias("discount"))


@query("SELECT role, count(*) AS n FROM conversations WHERE text LIKE '%a_e%' GROUP BY role")
def turns_like_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read.matching(adapters.turns(spark, sf_dir), QuerySpec(text_like="%a_e%"))
    return x.groupBy(F.col("l_role").alias("role")).agg(F.count(F.lit(1)).alias("n"))
