"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

Each query runs once to warm up and then three times; its figure is the median. ``store_build`` writes events as log rows
into a store, ``store_compact`` folds it, and ``store_*`` reads go through its files.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from spanlake import queries
from spanlake.operators import maintenance
from spanlake.plans.spec import TS_DESC, OrderBy, QuerySpec
from spanlake.sources import adapters
from spanlake.sources.store import Config, Store

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NAMES = [
    "scan_numeric_range", "scan_label_numeric_topk", "order_ts_desc_limit", "scan_time_range", "scan_composed", "count_filtered", "get_key", "text_match_and", "text_match_label_composed", "text_like_prefix", "text_like_infix",
    "lww_latest", "counter_fold", "counter_topk", "compact_equals_fold", "retention_after_fold", "fts_tokens_explode", "zone_map_build", "reclaim_dead_rows", "blob_dedup", "items_topk",
]


def done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    f()
    took = []
    for _ in range(3):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took), 4)


def main() -> None:
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", work).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        out = {n: timed(lambda n=n: done(queries.QUERIES[n](spark, SF_DIR))) for n in NAMES}
        store = Store(spark, f"file://{work}/store", Config(promote_labels=("event_type",), promote_metrics=("value",), hot_ttl=None))
        t = time.perf_counter()
        store.put_batch(adapters.spans(spark, SF_DIR), order=["seq"])
        out["store_build"] = round(time.perf_counter() - t, 4)
        t = time.perf_counter()
        maintenance.compact_all(store, 0)
        out["store_compact"] = round(time.perf_counter() - t, 4)
        reads = {
            "store_selective": QuerySpec(ranges={"value": (10, 10.2)}, limit=50),
            "store_topk": QuerySpec(labels={"event_type": "click"}, order_by=OrderBy("value"), limit=50),
            "store_newest": QuerySpec(order_by=TS_DESC, limit=50),
        }
        out |= {n: timed(lambda s=s: store.scan(s).collect()) for n, s in reads.items()}
        out["store_get"] = timed(lambda: store.get("s/00000042"))
        texts = Store(spark, f"file://{work}/texts", Config(promote_labels=("lang",), hot_ttl=None, index_rows=1))
        texts.put_batch(adapters.docs(spark, SF_DIR), order=["seq"])
        maintenance.compact_all(texts, 0)
        asked = {"store_text_match": QuerySpec(text_match="though from", limit=50), "store_text_like": QuerySpec(text_like="The th%", limit=50)}
        out |= {n: timed(lambda s=s: texts.scan(s).collect()) for n, s in asked.items()}
        key = iter(range(1 << 30))
        out["store_put"] = timed(lambda: store.put(f"new/{next(key)}", 1, {"event_type": "click"}, {"value": 1.0}))
        print(json.dumps({"metric": "total_query_time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
