"""Dead rows of files: writes that no read can see any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.schema import DEL, INCR


def dead_rows(log: DataFrame) -> DataFrame:
    """``log`` with ``dead``: a later put or delete of the key stands above the row, or the row is a delete with nothing
    of its key below or above it that it must hide."""
    last = log.groupBy("key").agg(F.max(F.when(F.col("op") != INCR, F.col("seq"))).alias("_last"), F.min("seq").alias("_first"), F.max("seq").alias("_newest"))
    x = log.join(last, "key")
    hidden = F.coalesce(F.col("seq") < F.col("_last"), F.lit(False))
    idle = (F.col("op") == DEL) & (F.col("seq") == F.col("_first")) & (F.col("seq") == F.col("_newest"))
    return x.withColumn("dead", hidden | idle).drop("_last", "_first", "_newest")


def dead_per_file(log: DataFrame, file: str) -> DataFrame:
    """file, rows, dead, rewrite: at least half of a rewritten file's rows are dead."""
    out = dead_rows(log).groupBy(file).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("dead").cast("long")).alias("n_dead"))
    return out.withColumn("rewrite", F.col("n_dead") * 2 >= F.col("n_rows"))
