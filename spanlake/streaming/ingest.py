"""Streams of writes into a store, one atomic commit per micro-batch."""

from __future__ import annotations

import math
import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanlake.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, *, order: list[str], name: str = "ingest", available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Write a stream of log rows (record columns and ``op``) to ``store``.

    A batch's commit carries the batch id, so a batch that is run again after a failure is written once. Event time plays
    no part: a row that comes late still is the last write of its key, so there is no watermark and no state to expire.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.put_batch(batch, order=order, batch=f"{name}-{number}")

    out = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=interval)).start()


class Ticker:
    """Calls ``store.maintain`` each ``seconds``, the first time after one interval; ticks that fall into a running one are
    skipped. An error stops it and is raised by :meth:`stop`."""

    def __init__(self, store: Store, seconds: float) -> None:
        self.store, self.seconds, self.error = store, seconds, None
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._run, name="spanlake-ticker", daemon=True)
        self._thread.start()

    def _run(self) -> None:
        due = time.monotonic() + self.seconds
        while not self._end.wait(max(0.0, due - time.monotonic())):
            try:
                self.store.maintain()
            except Exception as e:
                self.error = e
                return
            due += self.seconds * max(1, math.ceil((time.monotonic() - due) / self.seconds))

    def stop(self) -> None:
        self._end.set()
        self._thread.join()
        if self.error is not None:
            raise self.error
