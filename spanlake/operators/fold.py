"""Resolution of a log: the one place where writes become records.

Per key, in write order: the last put or delete is the base, and increments after it fold onto it. A put keeps its own
labels, payload and text; metrics add up by name and the time is the latest. Increments after a delete, or without a
base, are a record by themselves that starts from zero, with the identity of the oldest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.metrics import present
from spanlake.schema import DEL, INCR, PUT, RECORD_COLUMNS, TOMBSTONE_LABEL

#: Writes from which on a key is hot, and the most keys that are treated so.
HOT_ROWS, HOT_KEYS = 1_000_000, 1000


def normalised(log: DataFrame) -> DataFrame:
    """``log`` with tombstone-labelled puts as deletes."""
    return log.withColumn("op", F.when((F.col("op") == PUT) & F.coalesce(F.col("labels")[TOMBSTONE_LABEL] == "1", F.lit(False)), F.lit(DEL)).otherwise(F.col("op")))


def last_writes(log: DataFrame) -> DataFrame:
    """The last write of each key; right for logs without increments.

    The rank limit is pushed below the shuffle, so a key with many versions sends one row from each task.
    """
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return log.withColumn("_rank", newest).where("_rank = 1").drop("_rank")


def fold(log: DataFrame, metrics: list[str] | None = None, *, increments: bool = True) -> DataFrame:
    """One log row per key that stands for all its writes in ``log``; folding again changes nothing.

    The result's op is ``put``, ``del``, or ``incr`` where no base is in the log. ``metrics``: all metric names, if known;
    sums are then plain columns of one aggregation. Writes meet their key's base in a join by key. Of keys with ``HOT_ROWS``
    writes or more, the ``HOT_KEYS`` largest meet it by a broadcast of so many narrow rows instead, and aggregate before
    they shuffle; any other key has less than one in ``HOT_KEYS`` of all writes, or few. Without hot keys adaptive
    execution drops that branch.
    """
    if not increments:
        return last_writes(log)
    log = log.where(F.col("key").isNotNull())
    base = log.groupBy("key").agg(F.max(F.when(F.col("op") != INCR, F.col("seq"))).alias("_base"), F.count(F.lit(1)).alias("_n"))
    # The last column of the order decides nothing; with it all readers of this aggregation ask for the same of it, so that
    # the log is aggregated once.
    hot = base.where(F.col("_n") >= HOT_ROWS).orderBy(F.col("_n").desc(), "key", "_base").limit(HOT_KEYS)
    few = log.join(F.broadcast(hot.select("key")), "key", "left_anti")
    # The condition on _n keeps this aggregation the same as that of the hot keys, so that its exchange is used again.
    return _folded(log.join(F.broadcast(hot), "key"), metrics).unionByName(_folded(few.join(base.where("_n > 0"), "key"), metrics))


def _folded(based: DataFrame, metrics: list[str] | None) -> DataFrame:
    """:func:`fold` of writes that carry their key's newest base in ``_base``."""
    live = based.where("_base is null or seq >= _base")
    # Ordering values that are null are passed over: a delete never lends its identity.
    own = F.when(F.col("op") != DEL, F.col("seq"))
    counted = F.col("op") != DEL
    sums = [F.sum(F.when(counted, F.col("numerics")[F.lit(n)])).alias(f"_m{k}") for k, n in enumerate(metrics or [])]
    out = live.groupBy("key").agg(
        F.min_by(F.struct("labels", "payload", "text", "op"), own).alias("_id"),
        F.min_by(F.struct("labels", "payload", "text"), F.when(~counted, F.col("seq"))).alias("_gone"),
        F.max(F.when(counted, F.col("ts"))).alias("_ts"),
        F.max(F.when(~counted, F.col("ts"))).alias("_gone_ts"),
        F.max("seq").alias("seq"),
        *sums,
    )
    if metrics is None:
        each = live.where(counted).select("key", F.explode("numerics").alias("name", "v")).groupBy("key", "name").agg(F.sum("v").alias("v"))
        total = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("_numerics"))
        out = out.join(total, "key", "left")
        numerics: Column = F.coalesce("_numerics", F.create_map().cast("map<string,double>"))
    else:
        numerics = present(metrics, [F.col(f"_m{k}") for k in range(len(metrics))])
    dead = F.col("_id").isNull()
    op = F.when(dead, F.lit(DEL)).when(F.col("_gone").isNotNull() | (F.col("_id.op") == PUT), F.lit(PUT)).otherwise(F.lit(INCR))
    pick = lambda c: F.when(dead, F.col(f"_gone.{c}")).otherwise(F.col(f"_id.{c}")).alias(c)
    return out.select("key", F.coalesce("_ts", "_gone_ts").alias("ts"), pick("labels"), numerics.alias("numerics"), pick("payload"), pick("text"), "seq", op.alias("op"))


def resolve(log: DataFrame, metrics: list[str] | None = None, *, increments: bool = True) -> DataFrame:
    """The state of a log: live records, with ``seq`` of their last write."""
    out = fold(log, metrics, increments=increments).where(F.col("op") != DEL)
    return out.select(*RECORD_COLUMNS, "seq", *[c for c in out.columns if c.startswith(("l_", "n_"))])


def promote(df: DataFrame, labels: list[str] = (), metrics: list[str] = ()) -> DataFrame:
    """Adds promoted columns of labels and metrics."""
    return df.withColumns({f"l_{n}": F.col("labels")[F.lit(n)] for n in labels} | {f"n_{n}": F.col("numerics")[F.lit(n)] for n in metrics})
