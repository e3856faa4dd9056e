"""The store through its life: writes, files, commits, upkeep. Reads must not change under any of it."""

import hashlib
import os
import subprocess
import sys
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spanlake.operators import maintenance as m
from spanlake.operators import text_index
from spanlake.operators.fold import resolve
from spanlake.operators.retention import Policy
from spanlake.plans.spec import TS_DESC, OrderBy, QuerySpec
from spanlake.plans.zones import zones_of
from spanlake.sources import adapters, commits
from spanlake.sources.commits import ConflictError, CorruptError
from spanlake.sources.store import Config, Store
from spanlake.store_queries import PLAIN, fill
from tests import oracle
from tests.test_reads import SPECS, history, view

HOUR = 3600 * 10**9
RECORD = "key string, ts long, labels map<string,string>, numerics map<string,double>, payload binary, text string"


def apply(store, writes):
    store._add([(key, ts, labels, numerics, b"p" if op == "put" else b"", text, op) for op, key, ts, labels, numerics, text in writes])


def same(store, want, specs=None):
    for spec in specs if specs is not None else [SPECS[k] for k in (0, 3, 5, 9)]:
        got = sorted(view(store.scan(spec).collect()), key=str)
        assert got == sorted(view(oracle.scan(want, spec)), key=str), spec
        assert store.count(spec) == len(oracle.scan(want, replace(spec, limit=0)))


def put_all(store, rows):
    store.put_batch([(k, ts, {}, {}, b"", None) for k, ts in rows])


def keys(store, spec=None):
    return {r["key"] for r in store.scan(spec or QuerySpec()).collect()}


@pytest.mark.parametrize("ops", [True, False])
def test_reads_survive_upkeep(spark, tmp_path, ops):
    cfg = Config(compact_min_segments=2, max_segment_records=40, hot_ttl=None, promote_labels=("grade",), promote_metrics=("hours",))
    store, writes = Store(spark, f"file://{tmp_path}/s", cfg), history(400, 21, ops)
    for a in range(0, 400, 100):
        apply(store, writes[a : a + 100])
    want = oracle.resolve(writes)
    same(store, want)
    before = store.stats()["rows_stored"]
    m.compact(store, 0)
    same(store, want, [QuerySpec(), SPECS[5]])
    m.reclaim(store)
    same(store, want, [QuerySpec(), SPECS[2]])
    m.compact_all(store, 0)
    assert store.stats()["rows_stored"] == len(want) < before
    same(Store(spark, f"file://{tmp_path}/s", cfg), want)
    assert store.vacuum() == 0 < store.vacuum(0)
    same(store, want, [QuerySpec()])
    key = next(iter(want))
    assert store.get(key)["key"] == key and store.get("nope") is None


def test_promotion_after_reopening(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    writes = history(200, 5, ops=False)
    apply(Store(spark, root), writes[:120])
    store = Store(spark, root, Config(promote_labels=("grade",), promote_metrics=("hours",)))
    apply(store, writes[120:])
    want = oracle.resolve(writes)
    specs = [SPECS[2], SPECS[5], QuerySpec(labels={"grade": "b"}, order_by=OrderBy("hours"), limit=5)]
    same(store, want, specs)
    assert m.migrate(store) == 1 and m.migrate(store) == 0
    same(store, want, specs)
    m.compact_all(store, 0)
    same(store, want, specs)


def test_plain_store_skips_the_fold(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(promote_labels=("grade",)))
    apply(store, history(200, ops=False))
    m.compact_all(store, 0)
    spec = QuerySpec(labels={"grade": "a"})
    plan = store.state(spec).where(spec.condition(store.state(spec)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "EqualTo(l_grade,a)" in plan


def test_a_pruned_file_still_hides(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put("s/x", 10, {"state": "live"})
    store.put("s/x", 900, {"state": "gone"})
    assert store.scan(QuerySpec(labels={"state": "live"})).count() == 0
    assert store.count(QuerySpec(time_range=(0, 100))) == 0
    assert store.count(QuerySpec(time_range=(800, 1000))) == 1
    store.delete("s/x", 0)
    assert store.count(QuerySpec()) == 0 and store.get("s/x") is None


def test_newest_pages_read_few_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(early_files=3))
    for k in range(12):
        put_all(store, [(f"k{(k * 5 + i) % 23:02d}", 10 * k + i) for i in range(5)])
    put_all(store, [("k01", 3)])  # the newest write of a key with an early time
    want = {}
    for k in range(12):
        want |= {f"k{(k * 5 + i) % 23:02d}": 10 * k + i for i in range(5)}
    want["k01"] = 3
    page = sorted(want.items(), key=lambda r: (-r[1], r[0]))
    for limit, after in ((4, None), (9, (page[3][1], page[3][0])), (40, None)):
        spec = QuerySpec(order_by=TS_DESC, limit=limit, after=after)
        start = 0 if after is None else 4
        assert [(r["key"], r["ts"]) for r in store.scan(spec).collect()] == page[start : start + limit]
    zones, hiding = store._newest_files(store.snapshot(), list(store.snapshot().zones), QuerySpec(order_by=TS_DESC, limit=4))
    assert len(zones) == 3 and len(hiding) < 10


def test_counters(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put("b", 1, {"kind": "ledger"}, {"cost": 10.0})
    assert store.incr("b", 2, {"cost": 1.0}) == {"cost": 11.0}
    assert store.incr("b", 3, {"cost": 0.5, "n": 1.0}) == {"cost": 11.5, "n": 1.0}
    m.compact(store, 0, list(store.snapshot().zones)[1:])
    assert store.incr("b", 4, {"cost": 0.5})["cost"] == 12.0
    assert store.count(QuerySpec(ranges={"cost": (11.9, 12.1)})) == 1
    with pytest.raises(ValueError):
        store.purge_key("b")


def test_a_delete_in_a_newer_run_survives_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    put_all(store, [("a", 1), ("b", 1)])
    store.delete("a", 2)
    store.put("c", 3)
    m.compact(store, 0, list(store.snapshot().zones)[1:])
    assert keys(store) == {"b", "c"}


def test_retention(spark, tmp_path):
    now = 1000 * HOUR
    policy = Policy((("s/", HOUR), ("s/keep/", 48 * HOUR)), 2 * HOUR)
    assert (policy.ttl("s/keep/a"), policy.ttl("s/a"), policy.ttl("t")) == (48 * HOUR, HOUR, 2 * HOUR)
    for job in (lambda s: m.compact_all(s, now), lambda s: m.groom(s, now)):
        root = f"file://{tmp_path}/{id(job)}"
        store = Store(spark, root, Config(retention=policy))
        put_all(store, [(k, now - 24 * HOUR) for k in ("s/keep/a", "s/old", "t/old")] + [("s/new", now), ("u", now)])
        job(store)
        assert keys(store) == {"s/keep/a", "s/new", "u"}
    assert Policy((("s/", HOUR),)).ttl("t/ancient") is None
    # An old winner must not uncover a fresh loser.
    store = Store(spark, f"file://{tmp_path}/w", Config(retention=Policy((), HOUR)))
    store.put("k", now)
    store.put("k", 1)
    m.compact(store, now, [store.snapshot().zones[1]])
    assert store.count(QuerySpec()) == 0
    m.compact_all(store, now)
    assert store.count(QuerySpec()) == 0 and store.stats()["rows_stored"] == 0


def test_groom_drops_whole_files(spark, tmp_path):
    now = 1000 * HOUR
    store = Store(spark, f"file://{tmp_path}/s", Config(retention=Policy((("a/", HOUR),))))
    put_all(store, [(f"a/{k}", 5) for k in range(5)])
    store.put("b/1", 5)
    assert m.groom(store, now) == 1 and store.stats()["rows_expired"] == 5
    assert keys(store) == {"b/1"}


def test_groom_beside_cold_files(spark, tmp_path):
    now = 1000 * HOUR
    store = Store(spark, f"file://{tmp_path}/s", Config(retention=Policy((), HOUR), hot_ttl=HOUR))
    put_all(store, [("a", now), ("b", now), ("c", now)])
    assert m.tier(store, time.time_ns() + 2 * HOUR) == 1
    put_all(store, [("a", 1), ("b", now), ("d", 1)])  # a's newest write has expired; the cold one has not
    assert m.groom(store, now) == 0
    assert keys(store) == {"b", "c"}
    hot = [z for z in store.snapshot().zones if z.tier == "hot"]
    assert sum(z.count for z in hot) == 2 and store.log(hot).where("op = 'del'").count() == 1


def test_tiers(spark, tmp_path):
    cfg = Config(hot_ttl=HOUR, remote_ttl=2 * HOUR, cold_root=f"file://{tmp_path}/cold", remote_root=f"file://{tmp_path}/far")
    store, writes = Store(spark, f"file://{tmp_path}/s", cfg), history(100, ops=False)
    apply(store, writes)
    later = store.snapshot().zones[0].created + 10 * HOUR
    for name in ("cold", "far"):
        assert m.tier(store, later) == 1 and store.snapshot().zones[0].file.startswith(f"file:{tmp_path}/{name}/")
        same(store, oracle.resolve(writes), [QuerySpec(), SPECS[2]])
    assert store.stats()["files_remote"] == 1 and store.vacuum(0) == 2
    same(store, oracle.resolve(writes), [QuerySpec()])
    # Without a root of its own the colder tier leaves files where they are.
    store = Store(spark, f"file://{tmp_path}/t", Config(hot_ttl=HOUR))
    store.put("a", 1)
    file = store.snapshot().zones[0].file
    assert m.tier(store, later) == 1 and [(z.tier, z.file) for z in store.snapshot().zones] == [("cold", file)] and store.vacuum(0) == 0


def test_purge(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    put_all(store, [("a", 1), ("b", 1)])
    store.put("a", 2)
    store.purge_key("a")
    store.purge_key("a")
    assert store.get("a") is None and store.log().where("key = 'a'").count() == 0 and store.count(QuerySpec()) == 1 and store.stats()["purges"] == 1


def test_blobs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    ids = [store.put_blob(x) for x in (b"abc", b"abc", b"")]
    assert ids == [hashlib.sha256(x).hexdigest() for x in (b"abc", b"abc", b"")]
    assert store.get_blob(ids[0]) == b"abc" and store.get_blob(ids[2]) == b"" and store.stats()["blobs"] == 2
    assert store.get_blob("x") is None and store.get_blob("0" * 64) is None
    more = spark.createDataFrame([(bytearray(x),) for x in (b"abc", b"new", b"new", b"old")] + [(None,)], "content binary")
    got = sorted(r["id"] for r in store.put_blobs(more).collect())
    assert got == sorted(hashlib.sha256(x).hexdigest() for x in (b"abc", b"new", b"old")) and store.stats()["blobs"] == 4
    assert store.delete_blob(ids[0]) and not store.delete_blob(ids[0]) and store.get_blob(ids[0]) is None
    store.delete_blobs(spark.createDataFrame([(hashlib.sha256(b"new").hexdigest(),), ("f" * 64,)], "id string"))
    assert store.stats()["blobs"] == 2 and {r["id"] for r in store.blobs().collect()} == {ids[2], hashlib.sha256(b"old").hexdigest()}
    assert store.put_blob(b"abc") == ids[0] and store.get_blob(ids[0]) == b"abc"
    assert m.sweep_blobs(store) == 2 and m.sweep_blobs(store) == 0
    assert store.get_blob(ids[0]) == b"abc" and store.get_blob(hashlib.sha256(b"old").hexdigest()) == b"old" and store.get_blob(hashlib.sha256(b"new").hexdigest()) is None
    store.vacuum(0)
    assert store.get_blob(ids[0]) == b"abc" and store.stats()["blobs"] == 3
    for b in store.snapshot().blobs:
        store.files.delete(b.folder)
    with pytest.raises(CorruptError):
        store.get_blob(ids[2])


def test_commits(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    monkeypatch.setattr(commits, "CHECKPOINT_EVERY", 4)
    store = Store(spark, root)
    store.put("a", 1)
    old = store.snapshot()
    store.put("b", 1)
    with pytest.raises(ConflictError):
        store.commits.add(old)
    store.files.create(f"{store.root}/_commits/{9:020d}.json", b'{"id": ')  # torn
    assert store.count(QuerySpec()) == 2 and Store(spark, root).count(QuerySpec()) == 2
    store.put("c", 1)
    assert store.snapshot().id == 10 and store.commits.numbers("checkpoint") == [10]
    store.put("d", 1)
    store.delete("a", 2)
    assert store.commits.trim(time.time_ns()) == 7 and store.commits.numbers() == [] and store.commits.numbers("checkpoint") == [12]
    store.put("d", 3)
    for s in (store, Store(spark, root)):
        assert keys(s) == {"b", "c", "d"} and s.snapshot() == store.snapshot()
    store.commits.add(replace(store.snapshot(), format_version=99))
    with pytest.raises(CorruptError):
        Store(spark, root)


def test_a_vanished_file_is_chosen_anew(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store, other = Store(spark, root), Store(spark, root)
    put_all(store, [("a", 1), ("b", 2)])
    seen = other.snapshot()
    m.compact_all(store, 0)
    store.vacuum(0)
    calls = iter([seen])
    newest = other.commits.latest
    other.snapshot = lambda: next(calls, None) or newest()  # the first read goes by the commit before the compaction
    assert other.count(QuerySpec()) == 2


def test_buffered_writes_and_bulk_writes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(fsync="os"))
    store.put("a", 1, {}, {"n": 1.0})
    store.put("a", 2, {}, {"n": 2.0})
    assert store.get("a")["ts"] == 2 and store.stats()["rows_buffered"] == 2 and not store.snapshot().zones
    df = spark.createDataFrame([("a", k, {}, {"n": float(k)}, b"", None, k) for k in range(50)], f"{RECORD}, o long")
    store.put_batch(df, order=["o"], batch="x")
    store.put_batch(df, order=["o"], batch="x")
    assert store.get("a")["ts"] == 49 and store.stats()["rows_stored"] == 52
    with pytest.raises(ValueError):
        store.put_batch(df)
    with pytest.raises(ValueError):
        store.put("z", 1, {"__sl_x": "1"})
    with pytest.raises(ValueError):
        store.put_batch(df.withColumn("labels", __import__("pyspark").sql.functions.expr("map('__sl_x', '1')")), order=["o"])
    store.close()
    with pytest.raises(RuntimeError):
        store.put("a", 3)


def test_no_buffered_write_is_lost_to_a_known_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(fsync="os", memtable_max_records=3))
    store.put_batch([("x", 1, {}, {}, b"", None)], batch="one")
    store.put_batch([("x", 2, {}, {}, b"", None)], batch="one")
    store.put("kept", 1)
    store.flush()
    store.put("also", 1)
    store.put_batch([("x", 3, {}, {}, b"", None), ("y", 3, {}, {}, b"", None)], batch="one")
    store.flush()
    assert {(r["key"], r["ts"]) for r in store.scan(QuerySpec()).collect()} == {("x", 1), ("kept", 1), ("also", 1)}


def test_every_nth_write_is_committed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(fsync=3))
    for k in range(7):
        store.put(f"k{k}", k)
    assert store.stats()["rows_buffered"] == 1 and store.stats()["rows_stored"] == 6 and len(keys(store)) == 7


def test_write_order_is_dense(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [(f"k{k % 7}", k, {}, {}, b"", None, k) for k in range(1000)]
    for n in (1, 2):
        store.put_batch(spark.createDataFrame(rows, f"{RECORD}, o long").repartition(5), order=["o"])
        assert store.snapshot().next_seq == 1000 * n + 1
    assert {(r["key"], r["ts"]) for r in store.scan(QuerySpec()).collect()} == {(f"k{k % 7}", k) for k in range(993, 1000)}


def test_files_keep_the_byte_cap(spark, tmp_path):
    rows = [(f"k{k:03d}", k, {}, {}, bytes(1000), None, k) for k in range(200)]
    store = Store(spark, f"file://{tmp_path}/s", Config(max_segment_bytes=50_000))
    store.put_batch(spark.createDataFrame(rows, f"{RECORD}, o long"), order=["o"])
    assert max(z.count for z in store.snapshot().zones) <= 50 and sum(z.count for z in store.snapshot().zones) == 200
    store.put_batch([r[:6] for r in rows])
    assert max(z.count for z in store.snapshot().zones) <= 50


def test_choose_run_and_tick(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(compact_min_segments=4, hot_ttl=None))
    for k in range(4):
        put_all(store, [(f"k{i}", k) for i in range(10)])
    zones = list(store.snapshot().zones)
    assert len(m.choose_run(zones, store.config)) == 4
    sized = lambda counts: [replace(zones[0], id=k, count=c, min_seq=k, max_seq=k) for k, c in enumerate(counts)]
    run = lambda counts, **o: [z.id for z in m.choose_run(sized(counts), replace(store.config, **o))]
    assert run([1, 9, 9, 9, 9, 1]) == [1, 2, 3, 4]
    assert run([1, 1, 9, 9, 9]) == [] and run([1, 1, 9, 9, 9], compact_min_segments=2) == [2, 3, 4]
    assert run([1, 9] * 10) == list(range(20))  # no run, but many files: all of the longest stretch
    assert run([5], compact_min_segments=1) == [] and run([5], compact_min_segments=1, retention=Policy((), HOUR)) == [0]
    store.maintain(now=0)
    s = store.stats()
    assert s["compactions"] == 1 and s["rows_stored"] == 10 and s["write_amplification"] > 1
    assert [r["ts"] for r in store.scan(QuerySpec(order_by=TS_DESC, limit=2)).collect()] == [3, 3]


def test_reclaim_goes_round(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(max_segment_records=10))
    for k in range(3):
        put_all(store, [(f"{k}{i}", 1) for i in range(10)])
    put_all(store, [(f"{k}{i}", 2) for k in (0, 2) for i in range(4, 10)])
    assert [m.reclaim(store, 1) for _ in range(4)] == [6, 0, 6, 0] and store.stats()["rows_reclaimed"] == 12
    assert store.count(QuerySpec()) == 30


def test_text_reads_go_by_the_index(spark, tmp_path):
    cfg = Config(index_rows=1, index_keys=40)
    store, writes = Store(spark, f"file://{tmp_path}/s", cfg), history(300, 3, ops=True)
    apply(store, writes[:150])
    schema = f"{RECORD}, op string, o long"
    store.put_batch(spark.createDataFrame([(k, t, a, n, b"", x, op, i) for i, (op, k, t, a, n, x) in enumerate(writes[150:])], schema), order=["o"])
    want = oracle.resolve(writes)
    specs = [QuerySpec(text_match="seized"), QuerySpec(text_match="pump ok"), QuerySpec(text_like="load at%"), QuerySpec(text_like="% checked"), QuerySpec(text_match="nothing"), QuerySpec(text_match="valve", key_prefix="N/"), QuerySpec(text_like="%a%")]
    assert store._keys_by_index(store.snapshot(), specs[0]) is not None and store._keys_by_index(store.snapshot(), specs[-1]) is None
    assert Store(spark, store.root, replace(cfg, index_keys=3))._keys_by_index(store.snapshot(), specs[0]) is None
    same(store, want, specs)
    m.compact_all(store, 0)
    same(store, want, specs[:3])
    assert len({z.index for z in store.snapshot().zones if z.texts}) == 1


def test_streaming_ingest(spark, tmp_path):
    from spanlake.streaming.ingest import ingest

    schema = f"{RECORD}, o long, op string"
    rows = [("k1", 5, {}, {"n": 1.0}, b"", None, 1, "put"), ("k1", 6, {}, {"n": 2.0}, b"", None, 2, "incr"), ("k2", 1, {}, {}, b"", None, 3, "put"), ("k2", 1, {}, {}, b"", None, 4, "del")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        q = ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/ck", order=["o"], available_now=True)
        q.awaitTermination(120)
    assert store.get("k1")["numerics"] == {"n": 3.0} and store.get("k2") is None and store.stats()["rows_stored"] == 4


def test_ticker(spark, tmp_path):
    from spanlake.streaming.ingest import Ticker

    store = Store(spark, f"file://{tmp_path}/s", Config(fsync="os"))
    store.put("a", 1)
    ticker = Ticker(store, 0.2)
    assert store.stats()["rows_buffered"] == 1  # the first tick comes after an interval
    end = time.monotonic() + 30
    while store.ticks < 2 and time.monotonic() < end:
        time.sleep(0.1)
    ticker.stop()
    assert store.ticks >= 2 and store.stats()["rows_stored"] == 1


def test_orphans_of_the_remote_tier_go_when_a_store_opens(spark, tmp_path):
    cfg = Config(hot_ttl=HOUR, remote_ttl=HOUR, remote_root=f"file://{tmp_path}/far", vacuum_grace=0)
    store = Store(spark, f"file://{tmp_path}/s", cfg)
    store.put("a", 1)
    later = store.snapshot().zones[0].created + 10 * HOUR
    assert m.tier(store, later) == m.tier(store, later) == 1
    store.files.create(f"file://{tmp_path}/far/orphan/x.parquet", b"x")
    assert keys(Store(spark, f"file://{tmp_path}/s", cfg)) == {"a"} and store.files.names(f"file://{tmp_path}/far") != [] and not store.files.exists(f"file://{tmp_path}/far/orphan/x.parquet")


def test_running_state_is_the_fold(spark, tmp_path):
    from spanlake.streaming.state import move_on, running_state

    writes = [w for w in history(160, 8, machines=12)]
    schema = f"{RECORD}, op string, seq long"
    rows = [(k, t, a, {n: v for n, v in x.items() if v == v}, b"", text, op, i) for i, (op, k, t, a, x, text) in enumerate(writes)]
    for part in range(2):
        spark.createDataFrame(rows[80 * part : 80 * part + 90], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # ten rows come twice
        stream = running_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        # Every change goes to a file; the newest row of a key is its state.
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        if r["key"] not in last or last[r["key"]]["seq"] < r["seq"]:
            last[r["key"]] = r
    want = oracle.resolve([(op, k, t, a, {n: v for n, v in x.items() if v == v}, text) for op, k, t, a, x, text in writes])
    assert sorted(view(r for r in last.values() if r["live"]), key=str) == sorted(view(want.values()), key=str)
    assert move_on((5, True, 1, "{}", '{"n": 1.0}', b"", None), [(4, "put", 9, "{}", "{}", b"", None)])[0] == 5


def test_zones_of_files_in_one_pass(spark, tmp_path):
    """They are those that the grouping finds, whatever the labels and metrics; files whose keys rise are unique."""
    store = Store(spark, f"file://{tmp_path}/s", Config(max_segment_records=70, promote_labels=("a",)))
    rows = [(f"k{k % 150:03d}", k, {"a": str(k % 3), "many": str(k)} | ({"b": "é"} if k > 150 else {}), {"m": float("nan") if k % 2 else -float(k), "nan": float("nan")}, b"", "t" if k < 9 else None, k, "del" if k == 7 else "incr" if k == 8 else "put") for k in range(200)]
    log = spark.createDataFrame(rows, "key string, ts long, labels map<string,string>, numerics map<string,double>, payload binary, text string, k long, op string")
    store.put_batch(log, order=["k"])
    zones = store.snapshot().zones
    want = zones_of(store.log(zones, file=True), "_file", lambda f: {"id": 0, "bytes": 0, "created": 0})
    kinds = ("count", "min_ts", "max_ts", "min_key", "max_key", "min_seq", "max_seq", "has_incr", "has_del", "labels", "numerics", "texts")
    assert [[getattr(z, n) for n in kinds] for z in zones] == [[getattr(z, n) for n in kinds] for z in want]
    for z in zones:
        assert z.unique == (store.log([z]).select("key").distinct().count() == z.count)
    assert any(z.unique for z in zones) and not all(z.unique for z in zones)


def test_scan_of_disjoint_batches_resolves_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(hot_ttl=None))
    for a in (0, 500):
        store.put_batch(spark.range(a, a + 500).selectExpr("format_string('k%05d', id) key", "id ts", "map('a', 'b') labels", "map('n', 1d) numerics", "cast('' as binary) payload", "cast(null as string) text"), order=["ts"])
    plan = store.scan(QuerySpec())._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and store.scan(QuerySpec()).count() == 1000
    store.put("k00007", 5000)  # from here on a key has two writes
    assert store.scan(QuerySpec()).count() == 1000 and store.get("k00007")["ts"] == 5000


def test_files_cost_what_their_rows_need(spark, tmp_path):
    """No file holds a filter on keys of a fixed size; a whole folder is read as one path, a part of it file by file."""
    store = Store(spark, f"file://{tmp_path}/s", Config(hot_ttl=None, max_segment_records=20))
    store.put_batch(spark.range(400).selectExpr("format_string('k%05d', id) key", "id ts", "map('a', 'b') labels", "map('n', 1d) numerics", "cast('' as binary) payload", "cast(null as string) text"), order=["ts"])
    zones = list(store.snapshot().zones)
    assert len(zones) >= 20 and max(z.bytes for z in zones) < 20_000
    assert store._paths(zones) == [zones[0].file.rpartition("/")[0]]
    assert store._paths(zones[1:]) == [z.file for z in zones[1:]] and store.log(zones[1:]).count() == 400 - zones[0].count
    assert all(store.files.sizes(zones[0].file.rpartition("/")[0])[z.file] == z.bytes for z in zones)


def test_postings_are_written_without_a_shuffle(spark, tmp_path):
    texts = spark.range(300).selectExpr("format_string('k%05d', id) key", "concat('The the ', id % 7, ' Word', id) text").repartition(3)
    at = f"file://{tmp_path}/p"
    texts.write.parquet(f"file://{tmp_path}/t")
    text_index.write_postings(spark.read.parquet(f"file://{tmp_path}/t"), at)
    got = spark.read.parquet(at)
    assert sorted(map(tuple, got.collect())) == sorted({(w.lower(), r["key"]) for r in texts.collect() for w in r["text"].split()})
    assert "Exchange" not in text_index.arranged(spark.read.parquet(f"file://{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    for file in got.select("_metadata.file_path").distinct().collect():
        own = [tuple(r) for r in spark.read.parquet(file[0]).collect()]
        assert own == sorted(own)


def jobs(spark, name, run):
    """How many Spark jobs ``run`` starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_batches_of_one_frame_are_written_in_one_pass(spark, tmp_path):
    """They are what batches written one by one are: a commit, an id, files and a stretch of the write order each."""
    cfg = Config(hot_ttl=None, max_segment_records=60, cold_root=f"file://{tmp_path}/cold", promote_labels=("a",))
    rows = [(f"k{k % 37:02d}", k, {"a": str(k % 3)}, {"n": 1.0}, b"", None, k, "incr" if k % 4 == 1 else "del" if k % 11 == 5 else "put") for k in range(1000)]
    log = spark.createDataFrame(rows, f"{RECORD}, o long, op string").repartition(3)
    one, many = (Store(spark, f"file://{tmp_path}/{n}", cfg) for n in ("one", "many"))
    ids = ["x", "y", "x", "none", "z"]  # the second x is known by then, and no row has the number 3
    number = F.when(F.col("o") < 200, 0).when(F.col("o") < 300, 1).when(F.col("o") < 400, 2).when(F.col("o") < 990, 4)
    for k, b in enumerate(ids):
        many.put_batch(log.where(number == k), order=["o"], batch=b)
    one.put_batches(log, order=["o"], number=number, batches=ids)
    written = lambda s: sorted((r["seq"], r["key"], r["ts"], r["op"], r["l_a"]) for r in s.log().collect())
    assert written(one) == written(many) and len(written(one)) == 890
    assert one.snapshot().batches == many.snapshot().batches == ("x", "y", "z") and one.snapshot().id == many.snapshot().id
    zones = one.snapshot().zones
    assert len({z.id for z in zones}) == len(zones) and one.snapshot().next_file == max(z.id for z in zones) + 1
    assert all(a <= z.min_seq <= z.max_seq < b for z in zones for a, b in ((1, 201), (201, 301), (301, 891)) if a <= z.min_seq < b)
    for z in zones:
        held = one.log([z]).select("key", "seq").collect()
        assert held == sorted(held, key=lambda r: (r["key"], r["seq"])) and len(held) == z.count <= 60
    assert len(one._paths(zones)) == 3  # a folder for each batch
    one.put_batches(log, order=["o"], number=number, batches=ids)
    assert one.snapshot().zones == zones
    before = sorted(one.scan(QuerySpec()).collect(), key=str)
    m.tier(one, time.time_ns() + 25 * HOUR)
    one.vacuum(0)
    assert sorted(Store(spark, one.root, cfg).scan(QuerySpec()).collect(), key=str) == before == sorted(many.scan(QuerySpec()).collect(), key=str)


def test_a_filled_store_costs_no_more_for_more_batches(spark, tmp_path, sf_dir):
    """The log was read and shuffled for each batch by itself."""
    log = adapters.oplog(spark, sf_dir)
    made = [Store(spark, f"file://{tmp_path}/{n}", PLAIN) for n in (1, 8)]
    n = [jobs(spark, f"fill-{k}", lambda s=s, k=k: fill(s, log, k)) for s, k in zip(made, (1, 8), strict=True)]
    assert n[1] <= n[0] + 2 and made[1].snapshot().id == made[0].snapshot().id + 7
    assert made[0].snapshot().next_seq == made[1].snapshot().next_seq == log.count() + 1
    for store in made:
        for z in store.snapshot().zones:
            held = store.log([z]).select("key", "seq").collect()
            assert held == sorted(held, key=lambda r: (r["key"], r["seq"]))


SPILLING = """
import sys
from pyspark.sql import SparkSession, functions as F
from spanlake.sources.store import Store
from spanlake.store_queries import PLAIN

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.shuffle.spill.numElementsForceSpillThreshold", "500").getOrCreate()
rows = spark.range(20000).selectExpr("format_string('k%05d', id * 7919 % 20000) key", "id ts", "map('a', 'b') labels", "map('n', 1d) numerics", "cast('' as binary) payload", "cast(null as string) text", "id o")
store = Store(spark, sys.argv[1], PLAIN)
store.put_batches(rows, order=["o"], number=F.col("o") % 3, batches=["a", "b", "c"])
print("unique", [z.unique for z in store.snapshot().zones])
"""


def test_batches_keep_their_order_where_sorts_spill(tmp_path):
    """They were sorted by batch again as they were written, which lost the order of keys once that sort spilled. A session
    of its own, as the rows from which sorts spill are fixed with it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", SPILLING, f"file://{tmp_path}/s"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x for x in run.stdout.splitlines() if x.startswith("unique")]
    assert said and "True" in said[0] and "False" not in said[0], run.stdout + run.stderr


def test_a_fold_aggregates_the_log_once(spark, sf_dir):
    """The keys' bases and the search for hot keys ask for the same aggregation, so that its exchange is used again."""
    plan = resolve(adapters.oplog(spark, sf_dir), ["value"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    found = [x for x in plan if "Aggregate [key" in x and "count(1)" in x]
    assert len(found) == 3 and all("max(CASE" in x for x in found)


def test_adapters_leave_out_what_is_null(spark, tmp_path):
    rows = [(1, "a", None, 1.0), (2, None, 7, None), (3, "b", 8, 2.0), (4, None, None, None)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' ts", "'{}' props").write.parquet(f"file://{tmp_path}/events.parquet")
    got = {r["seq"]: (r["labels"], r["numerics"]) for r in adapters.spans(spark, f"file://{tmp_path}").collect()}
    assert got == {1: ({"event_type": "a"}, {"value": 1.0}), 2: ({"user": "u7"}, {}), 3: ({"event_type": "b", "user": "u8"}, {"value": 2.0}), 4: ({}, {})}
    log = adapters.oplog(spark, f"file://{tmp_path}")
    assert "lambda" not in log._jdf.queryExecution().optimizedPlan().toString()


def test_no_dictionary_of_write_orders_and_times(spark, tmp_path):
    import pyarrow.parquet as pq

    store = Store(spark, f"file://{tmp_path}/s", PLAIN)
    store.put_batch(spark.range(100).selectExpr("format_string('k%05d', id) key", "id div 50 ts", "map('a', 'b') labels", "map('n', 1d) numerics", "cast('' as binary) payload", "cast(null as string) text", "id o"), order=["o"])
    for z in store.snapshot().zones:
        group = pq.read_metadata(z.file.removeprefix("file:")).row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert not any(columns[n].has_dictionary_page for n in ("seq", "ts")) and columns["op"].has_dictionary_page
        assert columns["ts"].statistics.min == z.min_ts
    assert [r["ts"] for r in store.scan(QuerySpec(time_range=(1, 1), key_prefix="k0009")).collect()] == [1] * 10
