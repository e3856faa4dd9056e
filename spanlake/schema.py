"""Schemas and reserved names.

A *log* is a DataFrame of writes: one row per put, delete or increment, ordered by ``seq``. A *state* is a
DataFrame of resolved records: one row per live key. Hot labels and metrics can also stand in promoted
columns ``l_<name>`` and ``n_<name>``, which unlike map entries push down into Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_FIELDS = [
    T.StructField("key", T.StringType(), False),
    T.StructField("ts", T.LongType(), False),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("numerics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("payload", T.BinaryType()),
    T.StructField("text", T.StringType()),
]
RECORD_SCHEMA = T.StructType(RECORD_FIELDS)
PUT, DEL, INCR = "put", "del", "incr"
LOG_SCHEMA = T.StructType([*RECORD_FIELDS, T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False)])
RECORD_COLUMNS = [f.name for f in RECORD_FIELDS]
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]

#: A put whose label ``del`` is "1" is a tombstone, whoever wrote it.
TOMBSTONE_LABEL = "del"
#: Label names that start so belong to the engine and are refused in writes.
RESERVED_PREFIX = "__sl_"
#: Version of commits and data that this code writes; greater ones are refused.
FORMAT_VERSION = 3
