"""The star-schema and text tables as logs and states. Labels and metrics stand in maps and in promoted columns; what a
query does not use is pruned from the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def nanos(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) * 1000")


def _present(columns: dict[str, Column], kind: str) -> Column:
    """A map of the columns that are not null. The filter is slow, so only rows of which a part is null take it."""
    empty = F.create_map().cast(kind)
    if not columns:
        return empty
    every = F.create_map(*[x for n, v in columns.items() for x in (F.lit(n), v)])
    whole = reduce(and_, [v.isNotNull() for v in columns.values()])
    return F.when(whole, every).otherwise(empty if len(columns) == 1 else F.map_filter(every, lambda _, v: v.isNotNull()))


def _maps(labels: dict[str, Column], metrics: dict[str, Column]) -> dict[str, Column]:
    out = {f"l_{n}": v for n, v in labels.items()} | {f"n_{n}": v for n, v in metrics.items()}
    out["labels"] = _present(labels, "map<string,string>")
    out["numerics"] = _present(metrics, "map<string,double>")
    return out


def _columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``, each a record of its own."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    key = F.concat(F.lit("s/"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    return _columns(e, key=key, ts=nanos("ts"), payload=F.encode("props", "UTF-8"), text=F.lit(None).cast("string"), seq=F.col("event_id"), op=F.lit("put"), **_maps({"event_type": F.col("event_type"), "user": user}, {"value": F.col("value")}))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as writes to their user's record: errors delete, purchases and signups put, others add."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.lit("u/"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    kind = F.col("event_type")
    op = F.when(kind == "error", F.lit("del")).when(kind.isin("purchase", "signup"), F.lit("put")).otherwise(F.lit("incr"))
    put = op == "put"
    payload = F.when(put, F.encode("props", "UTF-8")).otherwise(F.lit(b""))
    return _columns(e, key=key, ts=nanos("ts"), payload=payload, text=F.lit(None).cast("string"), seq=F.col("event_id"), op=op, **_maps({"event_type": F.when(put, kind)}, {"value": F.when(op != "del", F.col("value"))}))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return _columns(d, key=key, ts=F.col("doc_id"), payload=F.lit(b""), text=F.col("text"), seq=F.col("doc_id"), op=F.lit("put"), **_maps({"lang": F.col("lang"), "source": F.col("source")}, {"n_chars": F.col("n_chars").cast("double")}))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return _columns(c, key=key, ts=F.col("turn"), payload=F.lit(b""), text=F.col("text"), seq=F.col("turn"), op=F.lit("put"), **_maps({"role": F.col("role")}, {}))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat(F.lit("l/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    labels = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}
    metrics = {n: F.col(f"l_{n}") for n in ("quantity", "extendedprice", "discount")}
    return _columns(x, key=key, ts=nanos("l_shipdate"), payload=F.lit(b""), text=F.lit(None).cast("string"), seq=F.col("l_orderkey"), op=F.lit("put"), **_maps(labels, metrics))
