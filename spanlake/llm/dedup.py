"""Near-dedup by Order MinHash (Marcais et al. 2019) with verification by banded alignment.

A document is its sequence of lower-case words. Two documents are linked if the edit distance of their word
sequences, found by banded alignment, is at most a fifth of the longer one (similarity 0.8 or more). A class is
a connected component of links; its id is the least doc_id in it. Candidates share a bucket of one of two kinds:

1. Order MinHash. K-mers are runs of ``K`` = 3 words, labelled with their occurrence number. For each of
   ``SKETCHES`` hash functions the two labelled k-mers with the least hashes are taken and kept in the order of
   the text, so equal sketches speak for equal k-mers in equal order, that is for edit similarity. The number
   of sketches is set so that a pair of ``SHORT`` + 1 words at similarity 0.8 exactly, with substituted words at
   random places, shares one with a chance of ``RECALL``. ``K`` is under five, so that a pair whose words are
   edited at even distances of five keeps common k-mers.
2. Blocks, where the longer text has at most ``SHORT`` words; this loses nothing. k edits leave one of k + 1
   disjoint blocks of the longer text intact, and for one of those, number i from the left, there are just i edits
   before it and at most k - i behind it (Li et al. 2011), which bounds its place in the shorter text.

Documents with the same words are one node from the start; a node is named by 64 bits of a hash of its words
(two texts of n share a name with a chance of n * n / 2**65). Links are looked for in two rounds: each node is
first aligned with the representative with which it shares most sketches, which labels it; then, in buckets
that hold several labels, all pairs with different ones are looked at in bounded blocks (blocks.py), and those
whose lengths and histograms of words and of word pairs allow similarity 0.8 (all are exact bounds) are
aligned there, unless links found before join them already. So no bucket is capped, no candidate link
between components is lost, and a bucket of true copies costs one alignment for each of them.

Edge cases: null, empty and wordless texts link with nothing, each is its own class; documents of fewer than
four words may have no edit and so link only with equal ones; null ids never name a class unless all in it are
null; repeated rows are copies of each other; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import edit_distance
from .blocks import deal, pairs_of, units
from .common import arrow_batches, drop_table, table
from .components import connected
from .words import WordHashes, hashed_words, mix64

K, SIMILARITY, RECALL, SHORT = 3, 0.8, 0.99, 40
#: A block of a bucket has so many words for each of its rows at most, on average: it is bounded in rows and bytes.
WORDS_A_ROW = 8192.0
#: Bins of the histograms of words and of word pairs.
BINS, PAIR_BINS = 512, 2048


def labelled_kmers(h: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of a word sequence with their occurrence numbers."""
    n = max(1, len(h) - K + 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(K, len(h))):
        x = mix64(x + h[k : k + n] + np.uint64(k + 1))
    order = np.argsort(x, kind="stable")
    y = x[order]
    first = np.concatenate([[0], np.flatnonzero(y[1:] != y[:-1]) + 1])
    number = np.empty(n, np.uint64)
    number[order] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return mix64(x + number * np.uint64(0x9E3779B97F4A7C15))


def limit_of(n):
    return n * (1 - SIMILARITY) + 1e-9


def sketches_for(n: int, trials: int = 4000) -> int:
    """Sketches that texts of n words need to reach RECALL: a sketch agrees about as often as two k-mers drawn from those of
    both texts are common to both."""
    rng = np.random.default_rng(17)
    places = rng.random((trials, n)).argsort(axis=1)[:, : math.floor(limit_of(n))]
    kept = np.ones((trials, n), bool)
    np.put_along_axis(kept, places, False, axis=1)
    runs = n - K + 1
    common = np.lib.stride_tricks.sliding_window_view(kept, K, axis=1).all(axis=2).sum(axis=1)
    alike = common * np.maximum(common - 1, 0) / ((2 * runs - common) * (2 * runs - common - 1))
    m = 1
    while (1 - (1 - alike) ** m).mean() < RECALL:
        m += 1
    return m


SKETCHES = sketches_for(SHORT + 1)
#: Texts with fewer words than this link with short texts only.
SKETCHED = SHORT + 1 - math.floor(limit_of(SHORT + 1))
SEEDS = np.random.default_rng(41).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def sketch(h: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """SKETCHES hashes, each of the two k-mers with the least hashes, in text order."""
    x = labelled_kmers(h)
    out = np.zeros(SKETCHES, np.uint64)
    step = max(1, cells // len(x))
    for a in range(0, SKETCHES, step):
        y = (x ^ SEEDS[a : a + step, None]) * np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        y = y.view(np.int64)
        first = y.argmin(axis=1)
        y[np.arange(len(y)), first] = np.iinfo(np.int64).max
        second = y.argmin(axis=1)
        low, high = x[np.minimum(first, second)], x[np.maximum(first, second)]
        out[a : a + step] = mix64(mix64(low + np.uint64(1)) * np.uint64(31) + high)
    return out


@cache
def blocks_for(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, words, name) of the blocks that a text of n words holds as the longer text of a pair, and of the parts of it in which
    it may hold a block of a longer one."""
    found = set()
    for longer in range(n, SHORT + 1):
        k = math.floor(limit_of(longer))
        if not k or longer - n > k:
            continue
        ends = [longer * b // (k + 1) for b in range(k + 2)]
        for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
            shifts = [d for d in range(-i, i + 1) if abs(d + longer - n) <= k - i]
            found |= {(a + d, z - a, longer * 64 + i) for d in shifts if 0 <= a + d and z + d <= n}
            if longer == n:
                found.add((a, z - a, longer * 64 + i))
    place, size, name = np.array(sorted(found), np.int64).reshape(-1, 3).T
    return place, size, name.astype(np.uint64)


def block_buckets(h: np.ndarray) -> np.ndarray:
    place, size, name = blocks_for(len(h))
    out = name * np.uint64(0x9E3779B97F4A7C15)
    for k in range(int(size.max(initial=0))):
        inside = k < size
        out[inside] = mix64(out[inside] + h[place[inside] + k] + np.uint64(k + 1))
    return out


def buckets(h: np.ndarray) -> np.ndarray:
    """The different buckets of a word sequence, sorted."""
    out = [np.zeros(0, np.uint64)]
    if len(h) >= SKETCHED:
        out.append(mix64(sketch(h) + np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    if len(h) <= SHORT:
        out.append(block_buckets(h))
    return np.unique(np.concatenate(out))


def words_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (hash of the text), key (hash of the words; null: no word), n, words (32 bits each) and buckets of every row, written."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            h, n = hashed_words(b.column(1).to_pylist(), hashes)
            parts = np.split(h, np.cumsum(n)[:-1]) if len(n) else []
            packed = [p.astype("<u4").tobytes() for p in parts]
            keys = [int.from_bytes(hashlib.md5(p).digest()[:8], "little", signed=True) if p else None for p in packed]
            places = [buckets(p).view(np.int64) if len(p) else None for p in parts]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "h": b.column(2), "key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int32()), "words": pa.array(packed, pa.binary()), "buckets": pa.array(places, pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(2), text_col).alias("h"))
    return table(rows.mapInArrow(run, "id long, h long, key long, n int, words binary, buckets array<long>"), "omh-words")


def aligned(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. Texts travel once for each pair."""
    x = pairs.select("a", "b").join(words.select(F.col("key").alias("a"), F.col("words").alias("x")), "a")
    x = x.join(words.select(F.col("key").alias("b"), F.col("words").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            linked = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u4").astype(np.int64), np.frombuffer(y, "<u4").astype(np.int64)
                linked.append(edit_distance(p, q, math.floor(limit_of(max(len(p), len(q))))) is not None)
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return x.mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and is_first (the row's id is the class id) of every row."""
    return _classes(docs, id_col, text_col).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_first"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    arrow_batches(docs.sparkSession, 500)
    rows = words_of(docs, id_col, text_col)
    known = rows.where("key is not null")
    nodes = table(known.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("buckets").alias("buckets")), "omh-nodes")
    placed = nodes.select("key", "n", F.explode("buckets").alias("bucket"))
    # A bucket holds a node once, so the hottest has at most a row of each node; adaptive execution splits it.
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("lead")).where("rows > 1")
    meet = table(placed.join(shared, "bucket"), "omh-meet")
    # The words of nodes that share a bucket, one copy of each.
    words = known.join(meet.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.any_value("words").alias("words"))
    words = table(words, "omh-meeting-words")
    stars = meet.where("key <> lead").groupBy("key", "lead").agg(F.count(F.lit(1)).alias("common"))
    stars = stars.groupBy("key").agg(F.max_by("lead", F.struct("common", "lead")).alias("b")).select(F.col("key").alias("a"), "b")
    first = table(aligned(stars, words), "omh-links")
    # A label is a node that links lead to: equal labels are one component, different ones may be.
    jump = first.select(F.col("a").alias("b"), F.col("b").alias("far"))
    labels = first.join(jump, "b", "left").select(F.col("a").alias("key"), F.coalesce("far", "b").alias("component"))
    labelled = meet.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    labelled = table(labelled.select("bucket", "key", "n", "component"), "omh-labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.greatest(F.count(F.lit(1)).cast("double"), F.sum("n") / WORDS_A_ROW)).alias("rows")).where("lo <> hi")
    rest = labelled.join(split.select("bucket", "rows"), "bucket").join(words, "key")
    links = first.unionByName(table(between(rest), "omh-more-links"))
    component = connected(links).withColumnRenamed("node", "key")
    # Only nodes that stand for several rows or are linked have a class other than the row's own id.
    named = nodes.select("key", "rep", "copies").join(component, "key", "left").where("copies > 1 or component is not null")
    named = named.withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = table(named.join(smallest, "component").select("key", "class_id", F.lit(True).alias("several")), "omh-classes")
    for t in (words, meet, labelled):
        drop_table(t)
    out = rows.select("id", "h", "key").join(named, "key", "left")
    return out.select(F.col("id").alias("doc_id"), "h", F.when(F.col("several"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def histograms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts, cut at 255, of hashed words and of hashed pairs of neighbours."""
    single, double = np.zeros((len(words), BINS), np.uint8), np.zeros((len(words), PAIR_BINS), np.uint8)
    for k, w in enumerate(words):
        h = np.frombuffer(w, "<u4").astype(np.uint64)
        single[k] = np.minimum(np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255)
        pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(PAIR_BINS)
        double[k] = np.minimum(np.bincount(pair.astype(np.int64), minlength=PAIR_BINS), 255)
    return single, double


def possible(i: np.ndarray, j: np.ndarray, edits: np.ndarray, counts: np.ndarray, q: int, step: int = 4096) -> np.ndarray:
    """Of pairs (i, j), those whose histograms of q-grams differ by no more than ``edits`` edits can make them: an
    edit takes away at most q of the one's q-grams and brings at most q of the other's."""
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), step):
        x, y = counts[i[a : a + step]], counts[j[a : a + step]]
        apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
        keep[a : a + step] = apart <= 2 * q * edits[a : a + step]
    return keep


def new_links(unit: dict) -> Iterator[tuple[int, int]]:
    """Links (as row numbers) between rows of a unit with different labels; each joins two groups that weren't joined."""
    n = np.array(unit["n"], np.int64)
    _, c = np.unique(unit["component"], return_inverse=True)
    mask = (np.abs(n[:, None] - n[None, :]) <= limit_of(np.maximum(n[:, None], n[None, :]))) & (c[:, None] != c[None, :])
    i, j = pairs_of(unit["block"], unit["alone"][0], mask)
    if not len(i):
        return
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    words = [unit["words"][k] for k in used]
    i, j = at[: len(i)], at[len(i) :]
    n, c = n[used], c[used]
    edits = np.floor(limit_of(np.maximum(n[i], n[j]))).astype(np.int64)
    for q, counts in enumerate(histograms(words), 1):
        keep = possible(i, j, edits, counts, q)
        i, j, edits = i[keep], j[keep], edits[keep]
    if not len(i):
        return
    h = [np.frombuffer(w, "<u4").astype(np.uint64) for w in words]
    places = {k: buckets(h[k]) for k in np.unique(np.concatenate([i, j])).tolist()}
    top = list(range(int(c.max()) + 1))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    bucket = np.int64(unit["bucket"][0]).view(np.uint64)
    for a, b, k in zip(i.tolist(), j.tolist(), edits.tolist(), strict=True):
        x, y = root(c[a]), root(c[b])
        # A pair that meets in several buckets is aligned in the first of them.
        if x != y and np.intersect1d(places[a], places[b], assume_unique=True)[0] == bucket and edit_distance(h[a].view(np.int64), h[b].view(np.int64), k) is not None:
            top[max(x, y)] = min(x, y)
            yield int(used[a]), int(used[b])


def between(rows: DataFrame) -> DataFrame:
    """Links a, b between nodes of a bucket whose labels differ."""
    names = ["block", "alone", "bucket", "key", "component", "n", "words"]
    dealt = deal(rows, ["bucket"], "rows", "key").select("unit", *names)

    def run(batches):
        import pyarrow as pa

        for u in units(batches, names):
            if len(u["key"]) > 1 and (found := list(new_links(u))):
                yield pa.RecordBatch.from_pydict({"a": pa.array([u["key"][x] for x, _ in found], pa.int64()), "b": pa.array([u["key"][y] for _, y in found], pa.int64())})

    return dealt.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the least id, with all columns of ``docs``. Rows without an id stay if no
    row of their class has one."""
    first = _classes(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__sl_a"), F.col("h").alias("__sl_b"))
    first = table(first.distinct(), "omh-firsts")
    marked = docs.withColumns({"__sl_id": F.col(id_col).cast("long"), "__sl_h": F.xxhash64(F.lit(2), F.col(text_col))})
    same = F.col("__sl_id").eqNullSafe(F.col("__sl_a")) & (F.col("__sl_h") == F.col("__sl_b"))
    return marked.join(first, same, "left_semi").dropDuplicates(["__sl_id", "__sl_h"]).drop("__sl_id", "__sl_h")


def op1_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
