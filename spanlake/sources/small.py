"""Parquet files of a few rows, made in the driver and sent to any file system: no Spark job for a single write."""

from __future__ import annotations

import io
from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq

from .files import Files

LOG = [("key", pa.string()), ("ts", pa.int64()), ("labels", pa.map_(pa.string(), pa.string())), ("numerics", pa.map_(pa.string(), pa.float64())), ("payload", pa.binary()), ("text", pa.string()), ("seq", pa.int64()), ("op", pa.string())]
POSTINGS = [("token", pa.string()), ("key", pa.string())]
BLOBS = [("id", pa.string()), ("content", pa.binary())]


def write_rows(files: Files, path: str, columns: Sequence[tuple[str, Any]], rows: Iterable[tuple]) -> int:
    """Write rows to a new file; returns its bytes."""
    held = [[list(v.items()) if isinstance(v, dict) else v for v in r] for r in rows]
    t = pa.table({n: pa.array([r[k] for r in held], t) for k, (n, t) in enumerate(columns)})
    out = io.BytesIO()
    pq.write_table(t, out, compression="zstd")
    if not files.create(path, out.getvalue()):
        raise FileExistsError(path)
    return out.tell()
