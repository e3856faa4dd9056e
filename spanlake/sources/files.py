"""Files through Hadoop's file systems, so that any URI that Spark reads works."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    """A file or folder: its name, full path, last change in nanoseconds and size in bytes."""

    name: str
    path: str
    is_dir: bool
    changed: int
    size: int


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def full(self, path: str) -> str:
        """The path with its scheme, as Spark's readers report it."""
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def entries(self, path: str) -> list[Entry]:
        """What a folder holds, by name; nothing if it is not there."""
        fs, p = self._at(path)
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted((Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime() * 10**6, s.getLen()) for s in found), key=lambda e: e.name)

    def names(self, path: str) -> list[str]:
        return [e.name for e in self.entries(path)]

    def sizes(self, path: str) -> dict[str, int]:
        return {e.path: e.size for e in self.entries(path) if not e.is_dir}

    def tree(self, path: str) -> Iterator[Entry]:
        """All files below a folder."""
        for e in self.entries(path):
            if e.is_dir:
                yield from self.tree(e.path)
            else:
                yield e

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Write a file that must not exist yet; False if it does. Exclusive where the file system's create without
        overwrite is (local, HDFS, ABFS, GCS, S3 with conditional writes)."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:  # py4j wraps the file system's error
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)


def short(path: str) -> str:
    """Folder and name of a file that the store wrote, which no other one has, however its path is spelled."""
    return "/".join(path.rsplit("/", 2)[1:])


def spelled(path: str) -> str:
    """A full path with one slash after its scheme: equal for the same file, whoever reports it."""
    return re.sub("^([a-z0-9]+:)/+", r"\1/", path)


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def copy_on_executors(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Copy (source, target) files, each by one task; the driver holds names only."""

    def run(batches):
        for b in batches:
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (a, p), (z, q) = _open(source), _open(target)
                z.create_dir(q.rpartition("/")[0], recursive=True)
                with a.open_input_stream(p, compression=None) as data, z.open_output_stream(q, compression=None) as out:
                    while chunk := data.read(16 << 20):
                        out.write(chunk)
            yield b.slice(0, 0)

    spark.createDataFrame(pairs, "source string, target string").repartition(max(1, min(len(pairs), 2000))).mapInArrow(run, "source string, target string").count()
