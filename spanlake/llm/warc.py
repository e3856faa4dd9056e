"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole records, then two skippable frames: an
index (64-bit hash of the record id, frame, offset within the frame; sorted by hash) and the seek table of
the Zstandard seekable format. Any zstd tool reads a bundle from front to end; :func:`lookup` reads the tail
and one frame.

Of records with equal payloads of at least ``least`` bytes the one with the largest page id is the response
and the others are revisits that refer to it.

Edge cases: a null html is an empty payload; a null url leaves the header out; control characters of a url
are percent-encoded; null page ids stay null and never are what others refer to (if all of a group are null,
all are responses); repeated rows with the largest id all are responses; an empty table gives no bundle and
no row. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_batches, file_system, new_dir, table

#: Uncompressed bytes after which a frame ends; compressed bytes after which a bundle ends.
FRAME, BUNDLE = 1 << 18, 1 << 26
SALTS = 32
INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
ENTRY = np.dtype([("hash", "<u8"), ("frame", "<u4"), ("offset", "<u4")])


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """id, url, payload, digest and refers_to (null: a response). Equal payloads are counted on (digest, length) with
    map-side partial results; payloads move only if the groups are too many to broadcast, and then salted."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = table(groups.where("n > 1").drop("n"), "warc-groups")
    if groups.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups), ["digest", "bytes"], "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "bytes", "salt"], "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(record: str) -> int | None:
    found = record[len("<urn:x-page:") : -1]
    return None if found == "null" else int(found)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """(headers, http headers, payload, next offset) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[: cut - 4].decode().split("\r\n")[1:])
    return headers, http, block[cut:], end + 4 + n + 4


class BundleWriter:
    def __init__(self, path: str, level: int) -> None:
        import zstandard

        fs, name = file_system(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.out, self.pack = path, fs.open_output_stream(name, compression=None), zstandard.ZstdCompressor(level=level).compress
        self.part, self.size, self.written, self.frames, self.index, self.records = [], 0, 0, [], [], 0

    def add(self, name: str, data: bytes) -> None:
        import xxhash

        self.index.append((xxhash.xxh64_intdigest(name), len(self.frames), self.size))
        self.part.append(data)
        self.size, self.records = self.size + len(data), self.records + 1
        if self.size >= FRAME:
            self._frame()

    def _frame(self) -> None:
        if self.part:
            packed = self.pack(b"".join(self.part))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.part, self.size = [], 0

    def close(self) -> None:
        self._frame()
        index = np.sort(np.array(self.index, ENTRY), order=["hash", "frame", "offset"]).tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0))
        seek = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.out.close()


def read_tail(f) -> tuple[np.ndarray, np.ndarray]:
    """(frames as (start, compressed bytes, bytes), the index) of an open bundle."""
    size = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != FOOT_MAGIC:
        raise ValueError("no seek table")
    table_ = np.frombuffer(f.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(n, 2).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(table_[:-1, 0])])
    index = np.frombuffer(f.read_at(int(table_[-1, 0]) - 8, int(starts[-1]) + 8), ENTRY)
    return np.column_stack([starts, table_])[:-1], index


def lookup(path: str, page: int | None) -> list[tuple[dict, bytes]]:
    """The records of a page id: one frame is read for each."""
    import xxhash
    import zstandard

    fs, name = file_system(path)
    with fs.open_input_file(name) as f:
        frames, index = read_tail(f)
        key = np.uint64(xxhash.xxh64_intdigest(record_id(page)))
        found = []
        for e in index[np.searchsorted(index["hash"], key) : np.searchsorted(index["hash"], key, "right")]:
            start, packed, size = map(int, frames[e["frame"]])
            data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=size)
            headers, _, payload, _ = parse(data, int(e["offset"]))
            if headers["WARC-Record-ID"] == record_id(page):
                found.append((headers, payload))
        return found


def write_bundles(marked: DataFrame, folder: str, *, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write bundles under ``folder``; returns the written manifest (path, records, bytes). A task that is run again
    writes under other names and only names of finished tasks enter the manifest."""
    arrow_batches(marked.sparkSession, 200)

    def run(batches):
        import pyarrow as pa

        def done(w: BundleWriter):
            w.close()
            return pa.RecordBatch.from_pydict({"path": [w.path], "records": pa.array([w.records], pa.int64()), "bytes": pa.array([w.written], pa.int64())})

        out = None
        for b in batches:
            for r in b.to_pylist():
                out = out or BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", level)
                out.add(record_id(r["id"]), record(r["id"], r["url"], r["payload"], r["digest"], r["refers_to"], date))
                if out.written >= BUNDLE:
                    yield done(out)
                    out = None
        if out:
            yield done(out)

    return table(marked.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read back from the bundles."""
    spark = manifest.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        import pyarrow as pa
        import zstandard

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    frames, _ = read_tail(f)
                    for start, packed, size in frames.tolist():
                        data, at, rows = zstandard.ZstdDecompressor().decompress(f.read_at(packed, start), max_output_size=size), 0, []
                        while at < len(data):
                            headers, http, payload, at = parse(data, at)
                            stated = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                            if headers["WARC-Type"] == "response":
                                if (digest := hashlib.sha1(payload).hexdigest()) != stated:
                                    raise ValueError(f"{path}: {headers['WARC-Record-ID']} is damaged")
                                rows.append((page_of(headers["WARC-Record-ID"]), len(payload), digest, "response", None))
                            else:
                                rows.append((page_of(headers["WARC-Record-ID"]), int(http["Content-Length"]), stated, "revisit", page_of(headers["WARC-Refers-To"])))
                        a, z, d, k, r = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict({"page_id": pa.array(a, pa.int64()), "payload_bytes": pa.array(z, pa.int64()), "payload_digest": pa.array(d, pa.string()), "record_type": pa.array(k, pa.string()), "refers_to": pa.array(r, pa.int64())})

    return manifest.select("path").repartition(n, "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    return read_bundles(write_bundles(mark_revisits(pages), folder or new_dir(pages.sparkSession, "warc")))


def op6_warc_bundles(spark, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM q
"""
