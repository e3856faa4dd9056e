"""The commit log: numbered JSON files, each with what it adds and drops, and a Parquet checkpoint of all now and then.

The state of the store is the newest whole commit and the commits before it, back to a checkpoint. A commit names the one
it was made on, so a commit that was torn while it was written is passed over.
"""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from spanlake.plans.zones import Zone
from spanlake.schema import FORMAT_VERSION

from .files import Files

#: Commits from one checkpoint to the next; it bounds what an opening store reads.
CHECKPOINT_EVERY = 50


class CorruptError(Exception):
    """Stored data is not what the commit says."""


class ConflictError(Exception):
    """Another writer made the same commit number."""


@dataclass(frozen=True)
class BlobFolder:
    """A folder of blobs by id, or of deletions of blobs; ``number`` orders folders."""

    folder: str
    number: int
    low: str
    high: str
    rows: int
    gone: bool = False


@dataclass(frozen=True)
class Snapshot:
    id: int = 0
    next_seq: int = 1
    next_file: int = 1
    zones: tuple[Zone, ...] = ()
    blobs: tuple[BlobFolder, ...] = ()
    n_blobs: int = 0
    metrics: tuple[str, ...] = ()
    counters: dict[str, int] = field(default_factory=dict)
    batches: tuple[str, ...] = ()
    format_version: int = FORMAT_VERSION

    def counted(self, **more: int) -> Snapshot:
        return replace(self, counters=self.counters | {k: self.counters.get(k, 0) + v for k, v in more.items()})


#: Fields of a snapshot that every commit states whole; they don't grow with the data.
WHOLE = ("next_seq", "next_file", "n_blobs", "counters", "format_version")


def _difference(old: Snapshot, new: Snapshot) -> dict[str, Any]:
    was, now = {z.id: z for z in old.zones}, {z.id: z for z in new.zones}
    had, has = {b.folder for b in old.blobs}, {b.folder for b in new.blobs}
    return {n: getattr(new, n) for n in WHOLE} | {
        "add": [asdict(z) for i, z in now.items() if was.get(i) != z],
        "drop": [i for i in was if i not in now],
        "add_blobs": [asdict(b) for b in new.blobs if b.folder not in had],
        "drop_blobs": sorted(had - has),
        "metrics": sorted(set(new.metrics) - set(old.metrics)),
        "batches": [b for b in new.batches if b not in old.batches],
    }


def _applied(to: Snapshot, raw: dict[str, Any]) -> Snapshot:
    zones = {z.id: z for z in to.zones}
    for i in raw["drop"]:
        zones.pop(i, None)
    zones |= {z["id"]: Zone(**z) for z in raw["add"]}
    dropped = set(raw["drop_blobs"])
    blobs = (*(b for b in to.blobs if b.folder not in dropped), *(BlobFolder(**b) for b in raw["add_blobs"]))
    return Snapshot(id=raw["id"], zones=tuple(zones.values()), blobs=blobs, metrics=tuple(sorted({*to.metrics, *raw["metrics"]})), batches=(*to.batches, *raw["batches"])[-1000:], **{n: raw[n] for n in WHOLE})


class CommitLog:
    def __init__(self, files: Files, root: str) -> None:
        self.files, self.root = files, f"{root}/_commits"
        self._known: Snapshot | None = None

    def _path(self, number: int, kind: str = "json") -> str:
        return f"{self.root}/{number:020d}.{kind}"

    def _read(self, number: int) -> dict[str, Any] | None:
        try:
            raw = json.loads(self.files.read(self._path(number)))
        except ValueError:
            return None
        self._check(raw["format_version"], f"commit {number}")
        return raw

    def _check(self, version: int, what: str) -> None:
        if version > FORMAT_VERSION:
            raise CorruptError(f"{what} has format {version}; this version reads up to {FORMAT_VERSION}")

    def numbers(self, kind: str = "json") -> list[int]:
        return [int(n[:20]) for n in self.files.names(self.root) if n.endswith(f".{kind}")]

    def latest(self) -> Snapshot:
        """The newest state. What was read before is kept, so only newer commits are read."""
        names = self.files.names(self.root)
        numbers = [int(n[:20]) for n in names if n.endswith(".json")]
        marks = [int(n[:20]) for n in names if n.endswith(".checkpoint")]
        known = self._known or Snapshot()
        newest = max([known.id, *numbers, *marks])
        if newest == known.id:
            return known
        bases = sorted({known.id, *marks, 0}, reverse=True)
        for tip in [n for n in reversed(numbers) if n > known.id] or [newest]:
            chain, at = [], tip
            while at not in bases and at in numbers and (raw := self._read(at)) is not None:
                chain.append(raw)
                at = raw["parent"]
            if at in bases:
                base = known if at == known.id else Snapshot() if at == 0 else self._checkpoint(at)
                for raw in reversed(chain):
                    base = _applied(base, raw)
                self._known = base
                return base
        return known

    def add(self, snapshot: Snapshot) -> Snapshot:
        """Publish ``snapshot``, made from the newest state, as the next commit; readers see all of it or nothing."""
        old = self.latest()
        if old.id != snapshot.id:
            raise ConflictError("another writer has committed since this snapshot was read")
        number = max([old.id, *self.numbers()]) + 1
        new = replace(snapshot, id=number)
        body = _difference(old, new) | {"id": number, "parent": old.id, "writer": uuid.uuid4().hex}
        data = json.dumps(body).encode()
        # Read again, in case the file system let two writers create it.
        if not self.files.create(self._path(number), data) or self.files.read(self._path(number)) != data:
            raise ConflictError(f"commit {number} exists")
        self._known = new
        if number // CHECKPOINT_EVERY > old.id // CHECKPOINT_EVERY:
            self.checkpoint(new)
        return new

    def checkpoint(self, s: Snapshot) -> None:
        """Write the whole of a state as Parquet: a row for each file or blob folder, the rest as its metadata."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = [("zone", json.dumps(asdict(z))) for z in s.zones] + [("blobs", json.dumps(asdict(b))) for b in s.blobs]
        head = {n: getattr(s, n) for n in (*WHOLE, "id", "metrics", "batches")}
        t = pa.table({"kind": pa.array([k for k, _ in rows], pa.string()), "body": pa.array([b for _, b in rows], pa.string())})
        out = io.BytesIO()
        pq.write_table(t.replace_schema_metadata({"state": json.dumps(head)}), out, compression="zstd")
        self.files.create(self._path(s.id, "checkpoint"), out.getvalue())

    def _checkpoint(self, number: int) -> Snapshot:
        import pyarrow.parquet as pq

        t = pq.read_table(io.BytesIO(self.files.read(self._path(number, "checkpoint"))))
        head = json.loads(t.schema.metadata[b"state"])
        self._check(head["format_version"], f"checkpoint {number}")
        rows = [(k, json.loads(b)) for k, b in zip(t["kind"].to_pylist(), t["body"].to_pylist(), strict=True)]
        return Snapshot(zones=tuple(Zone(**b) for k, b in rows if k == "zone"), blobs=tuple(BlobFolder(**b) for k, b in rows if k == "blobs"), **head | {"metrics": tuple(head["metrics"]), "batches": tuple(head["batches"])})

    def trim(self, before: int) -> int:
        """Delete commits that a checkpoint which was written before ``before`` (nanoseconds) makes needless."""
        found = self.files.entries(self.root)
        marks = [int(e.name[:20]) for e in found if e.name.endswith(".checkpoint") and e.changed <= before]
        old = [e for e in found if marks and int(e.name[:20]) < max(marks) or e.name.endswith(".json") and marks and int(e.name[:20]) == max(marks)]
        for e in old:
            self.files.delete(e.path)
        return len(old)
