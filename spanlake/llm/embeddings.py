"""Near-dedup of embeddings by cross-polytope hashing.

A hash of a vector is the nearest signed axis after three rounds of random signs and fast Hadamard transform.
``hashes`` of them name a bucket, in ``tables`` tables, whose number follows from that of the hashes so that a pair
at the threshold meets with a chance of ``RECALL``; each vector also visits the bucket in which its least
sure hash is replaced by the second nearest axis (multiprobe). All pairs of a bucket are verified by their cosine in double precision. A pair that meets in several buckets counts in the first.

Identical vectors are one class with a weight before hashing, so copies never meet. A class is hashed once; its
buckets travel with it. Within a bucket pairs are looked at in blocks (see blocks.py) and only sums and spanning
links are written.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths never link; repeated rows are vectors that link with
each other; null ids count as vectors but never name a component unless all ids in it are null; an empty table
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, deal, forest, pairs_of, units
from .common import arrow_batches, small, table
from .components import connected
from .words import mix64

#: The least number of tables, and the chance that a pair at the threshold meets in one of them.
TABLES, RECALL = 12, 0.999
#: Rows that a bucket should have at most if vectors were random; bytes of vectors that a block should have at most.
RANDOM_ROWS, BLOCK_BYTES = 1.0, 16 << 20


def rotations(dim: int, count: int, seed: int = 5) -> np.ndarray:
    """Random signs (count, 3, size) for vectors padded to a power of two."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), size=(count, 3, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def buckets(x: np.ndarray, signs: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited) buckets of unit vectors, each (rows, tables)."""
    padded = np.zeros((len(x), signs.shape[2]))
    padded[:, : x.shape[1]] = x
    home, visit = [], []
    for t in range(0, len(signs), hashes):
        best, second, gap = [], [], []
        for k in range(t, t + hashes):
            y = padded
            for s in signs[k]:
                y = hadamard(y * s)
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.abs(np.take_along_axis(y, order, 1))
            order = np.where(size[:, :1] >= size[:, 1:], order, order[:, ::-1])
            size.sort(axis=1)
            axis = order + y.shape[1] * (np.take_along_axis(y, order, 1) < 0)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(size[:, 1] - size[:, 0])
        weak = np.argmin(gap, axis=0)

        def name(parts):
            h = np.full(len(x), t + 1, np.uint64)
            for p in parts:
                h = mix64(h * np.uint64(1_000_003) + p.astype(np.uint64) + np.uint64(7))
            return h.astype(np.int64)

        home.append(name(best))
        visit.append(name([np.where(weak == k, second[k], best[k]) for k in range(hashes)]))
    return np.stack(home, 1), np.stack(visit, 1)


def usable(vectors: list) -> np.ndarray:
    return np.array([v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v) for v in vectors], bool)


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def number_of_hashes(rows: int, dim: int) -> int:
    axes = 2 << max(1, (dim - 1).bit_length())
    return max(1, math.ceil(math.log(max(1.0, rows / RANDOM_ROWS)) / math.log(axes)))


@cache
def tables_for(size: int, hashes: int, threshold: float) -> int:
    """Tables that vectors of ``size`` axes need, from simulated pairs at the threshold under random rotations."""
    pairs = max(256, min(4000, (1 << 22) // size))
    rng = np.random.default_rng([23, size, hashes])
    best, second, gap = np.zeros((3, 2, pairs, hashes))
    for k in range(hashes):
        x, z = rng.normal(size=(2, pairs, size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        for v, y in enumerate((x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * z)):
            order = np.argsort(-np.abs(y), axis=1)[:, :2]
            top = np.take_along_axis(y, order, 1)
            axis = order + size * (top < 0)
            best[v, :, k], second[v, :, k], gap[v, :, k] = axis[:, 0], axis[:, 1], np.abs(top[:, 0]) - np.abs(top[:, 1])
    visit = np.where(np.arange(hashes) == gap.argmin(axis=2)[:, :, None], second, best)
    meet = np.zeros(pairs, bool)
    for a in (best[0], visit[0]):
        for b in (best[1], visit[1]):
            meet |= (a == b).all(axis=1)
    chance = min(max(meet.mean(), 1 / pairs), 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log(1 - chance)))


def node_of(rep, key):
    """A class's name: its least id, so that names sort by it (null last), and the hash of the vector."""
    offset = F.lit(str(1 << 63)).cast("decimal(20,0)")
    place = F.lpad((rep.cast("decimal(20,0)") + offset).cast("string"), 20, "0")
    return F.concat(F.coalesce(place, F.lit("~" * 20)), key)


def id_of(node):
    offset = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(~node.startswith("~"), (F.substring(node, 1, 20).cast("decimal(20,0)") - offset).cast("long"))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists(v, lambda c: c != 0)
    key = F.when(F.coalesce(good, F.lit(False)), F.md5(F.to_json(F.struct(v.alias("v")))))
    rows = table(vectors.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.when(key.isNotNull(), v).alias("v")), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("v").alias("v"))
    classes = table(classes.select(node_of(F.col("rep"), F.col("key")).alias("node"), "weight", "v"), "vector-classes")
    bits = F.length(F.bin(F.size("v") - 1))
    top = classes.agg(F.count(F.lit(1)), F.max(F.size("v")), F.collect_set(bits)).first()
    k = hashes or number_of_hashes(top[0], top[1] or 1)
    #: By number of axes.
    needed = {1 << b: tables or tables_for(1 << b, k, threshold) for b in top[2]}

    def signs_of(dim: int) -> np.ndarray:
        return rotations(dim, needed[1 << max(1, (dim - 1).bit_length())] * k)

    def places(batches):
        import pyarrow as pa

        for b in batches:
            vs = b.column(2).to_pylist()
            for dim in sorted({len(x) for x in vs}):
                at = [i for i, x in enumerate(vs) if len(x) == dim]
                unit = unit_rows([vs[i] for i in at])
                home, visit = (x + dim for x in buckets(unit, signs_of(dim), k))
                found = [np.unique(x) for x in np.concatenate([home, visit], axis=1)]
                packed = {n: pa.array([r.tobytes() for r in x], pa.binary()) for n, x in (("unit", unit), ("home", home), ("visit", visit))}
                yield pa.RecordBatch.from_pydict({"node": b.column(0).take(pa.array(at)), "weight": b.column(1).take(pa.array(at)), **packed, "buckets": pa.array(found, pa.list_(pa.int64()))})

    # Each vector is hashed once: its buckets travel with it and decide in which of them a pair counts.
    hashed = table(classes.select("node", "weight", "v").mapInArrow(places, "node string, weight long, unit binary, home binary, visit binary, buckets array<long>"), "vector-buckets")
    slim = hashed.select("node", F.explode("buckets").alias("bucket"))
    counts = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only vectors that share a bucket travel, once for each such bucket. A block's bytes are bounded as its rows are.
    load = F.ceil(F.col("n") * F.greatest(F.lit(1.0), F.octet_length("unit") / F.lit(BLOCK_BYTES / BLOCK)))
    meet = slim.join(counts, "bucket").join(hashed.drop("buckets"), "node").withColumn("n", load)
    names = ["bucket", "block", "alone", "node", "weight", "unit", "home", "visit"]
    dealt = deal(meet.withColumnRenamed("unit", "x"), ["bucket"], "n", "node").select(F.col("unit"), *[F.col("x").alias("vector") if c == "unit" else F.col(c) for c in names])

    def verify(batches):
        import pyarrow as pa

        for u in units(batches, [c if c != "unit" else "vector" for c in names]):
            if len(u["node"]) < 2 or len({len(x) for x in u["vector"]}) > 1:
                continue  # vectors of different lengths share a bucket by chance of a hash only, and never link
            x = np.frombuffer(b"".join(u["vector"]), np.float64).reshape(len(u["node"]), -1)
            i, j = pairs_of(u["block"], u["alone"][0], x @ x.T >= threshold)
            if not len(i):
                continue
            home, visit = (np.frombuffer(b"".join(u[c]), np.int64).reshape(len(x), -1) for c in ("home", "visit"))
            first = owner(home, visit, i, j) == u["bucket"][0]
            i, j = i[first], j[first]
            if not len(i):
                continue
            w = np.array(u["weight"], np.int64)
            links = np.bincount(i, w[j], len(w)) + np.bincount(j, w[i], len(w))
            at = np.flatnonzero(links)
            tree = forest(len(w), i, j)
            yield pa.RecordBatch.from_pydict({"a": pa.array([u["node"][m] for m in at] + [u["node"][m] for m, _ in tree], pa.string()), "b": pa.array([None] * len(at) + [u["node"][m] for _, m in tree], pa.string()), "n": pa.array([int(links[m]) for m in at] + [0] * len(tree), pa.int64())})

    found = table(dealt.mapInArrow(verify, "a string, b string, n long"), "vector-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    # A component's name is its least node, and that one bears its least id: no rows meet by component.
    component = connected(found.where("b is not null").select("a", "b"))
    named = classes.select("node", "weight").join(component, "node", "left").join(links, "node", "left")
    result = named.select(F.substring("node", 21, 32).alias("key"), id_of(F.coalesce("component", "node")).alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "key").join(small(table(result, "vector-result")), "key", "left")
    component_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))


def owner(home: np.ndarray, visit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first bucket, by table and then value, in which two vectors meet."""
    out, left = np.zeros(len(i), np.int64), np.ones(len(i), bool)
    for t in range(home.shape[1]):
        a, b, c, d = home[i, t], visit[i, t], home[j, t], visit[j, t]
        at_a, at_b = (a == c) | (a == d), (b == c) | (b == d)
        best = np.where(at_a & at_b, np.minimum(a, b), np.where(at_a, a, b))
        new = left & (at_a | at_b)
        out[new] = best[new]
        left &= ~new
    return out


def op10_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
