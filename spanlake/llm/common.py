"""Shared folders, written tables and file systems for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted to have at most so many (narrow) rows; beyond that it is joined by shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary one is made, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that this session has been given and that may still be there.
_given: set[str] = set()


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) in the shared folder."""
    path = f"{shared_dir(spark)}/spanlake/{name}-{uuid.uuid4().hex}"
    _given.add(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all that operators wrote to the shared folder in this session, token files and bundles included; returns how
    many folders. To be called when their results have been read or stored elsewhere: results read these tables."""
    n = len(_given)
    for path in sorted(_given):
        drop_dir(spark, path)
    return n


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sl_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what :func:`table` wrote, once nothing reads it any more."""
    if path := getattr(df, "_sl_path", None):
        drop_dir(df.sparkSession, path)


def drop_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _given.discard(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if it was counted to have at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; works on executors as on the driver."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def crc_mod(column, n: int):
    """crc32 of a column's text, modulo n; null ids count as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), F.lit(n))
