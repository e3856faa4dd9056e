"""Running records of a stream of writes: keyed state that each micro-batch moves on.

The state of a key is its record as :func:`spanlake.operators.fold.resolve` gives it: the newest put, or what increments add
up to. Writes count in the order of ``seq``; a row that comes late in event time is still the last write of its key, so
there is no watermark. Writes with a ``seq`` that a key has seen are passed over, so replayed rows change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.fold import normalised
from spanlake.schema import RECORD_COLUMNS

STATE = "seq long, live boolean, ts long, labels string, numerics string, payload binary, text string"


def move_on(state: tuple | None, rows: list[tuple]) -> tuple:
    """The state after writes (seq, op, ts, labels, numerics, payload, text) of one key, in the order of seq."""
    seq, live, ts, labels, numerics, payload, text = state or (None, False, 0, "{}", "{}", b"", None)
    sums = {n: float(v) for n, v in json.loads(numerics).items()}
    for r in sorted(rows, key=lambda r: r[0]):
        if seq is not None and r[0] <= seq:
            continue
        seq, op = r[0], r[1]
        new = {n: float(v) for n, v in json.loads(r[4] or "{}").items()}
        if op == "incr":
            if not live:
                live, ts, labels, sums, payload, text = True, r[2], r[3], {}, r[5], r[6]
            ts = max(ts, r[2])
            sums |= {n: sums.get(n, 0.0) + v for n, v in new.items()}
        else:
            live, ts, labels, sums, payload, text = op == "put", r[2], r[3], new if op == "put" else {}, r[5], r[6]
    return seq, live, ts, labels or "{}", json.dumps(sums), bytes(payload or b""), text


def running_state(stream: DataFrame, *, ttl_ms: int | None = None) -> DataFrame:
    """A stream of changed records (record columns, ``seq`` and ``live``, false for a deleted one) from a stream of log rows,
    in update mode. A micro-batch's writes of one key are held together in one task, so the source's rate bounds them.
    ``ttl_ms``: a key without writes for so long (processing time) is forgotten and comes out as not live, once; such a
    query goes on with batches for timeouts, so it needs a trigger by time and does not end by itself."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def move(key: tuple, chunks: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            old = state.get
            state.remove()
            now = (old[0], False, *old[2:])
        else:
            rows = [(r.seq, r.op, r.ts, r.labels, r.numerics, r.payload, r.text) for c in chunks for r in c.itertuples(index=False)]
            now = move_on(state.get if state.exists else None, rows)
            state.update(now)
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        seq, live, ts, labels, numerics, payload, text = now
        yield pd.DataFrame({"key": [key[0]], "ts": [ts], "labels": [labels], "numerics": [numerics], "payload": [payload], "text": [text], "seq": [seq], "live": [live]})

    slim = normalised(stream).select("key", "seq", "op", "ts", F.to_json("labels").alias("labels"), F.to_json("numerics").alias("numerics"), "payload", "text")
    schema = "key string, ts long, labels string, numerics string, payload binary, text string, seq long, live boolean"
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = slim.groupBy("key").applyInPandasWithState(move, schema, STATE, "update", timeout)
    maps = {"labels": F.from_json("labels", "map<string,string>"), "numerics": F.from_json("numerics", "map<string,double>", {"allowNonNumericNumbers": "true"})}
    return out.withColumns(maps).select(*RECORD_COLUMNS, "seq", "live")
