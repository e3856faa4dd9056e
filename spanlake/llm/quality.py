"""Quality by nearest-neighbour voting on latent-semantic vectors.

Terms are hashed words, hashed token shapes ("THE!!" is "A!") and their pairs, with log counts and inverse
document frequencies; a truncated SVD over a bounded sample of labelled rows (``TRAIN_ROWS``) gives the latent
space. The sample's unit vectors are broadcast; for every document the exact cosines with all of them are
computed in blocks, and its ``NEIGHBOURS`` nearest vote with a power of their cosines as weights.

Edge cases: null and empty texts have a zero vector and get the smoothed share of label 1, as all do if
nothing is labelled; repeated rows and ids are scored alike; ties between neighbours go to the lower sample
row; an empty table gives an empty result. Of the documents only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod
from .labelled import training_sample

#: Hashed places of words and of shapes; dimensions; the bound of the sample.
WORDS, SHAPES, DIMS, TRAIN_ROWS, NEIGHBOURS = 2048, 2048, 48, 3000, 25
#: Shapes tell quality more than words do; exponent of the cosines.
SHAPE_WEIGHT, POWER = 3.0, 6
CLASSES = [(re.compile(p), r) for p, r in ((r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (r"\d+", "0"), (r"(.)\1+", r"\1"))]


class Tokens(dict):
    """token -> word place and shape hash in one number."""

    kept = 250_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        shape = token
        for p, r in CLASSES:
            shape = p.sub(r, shape)
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % WORDS
        self[token] = found = (zlib.crc32(shape.encode("utf-8", "surrogatepass")) << 16) | word
        return found


def counts(texts: list[str | None], tokens: Tokens) -> np.ndarray:
    """Log counts of terms, a row for each text."""
    split = [t.split() if t else [] for t in texts]
    n = np.array([len(s) for s in split], np.int64)
    both = np.fromiter(map(tokens.__getitem__, chain.from_iterable(split)), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    word, shape = (both & np.uint64(0xFFFF)).astype(np.int64), both >> np.uint64(16)
    at = [doc * (WORDS + SHAPES) + word, doc * (WORDS + SHAPES) + WORDS + (shape * np.uint64(0x9E3779B1) >> np.uint64(7)).astype(np.int64) % SHAPES]
    if len(doc) > 1:
        pair = ((shape[:-1] * np.uint64(31) + shape[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(9)).astype(np.int64) % SHAPES
        pair[both[1:] == both[:-1]] = SHAPES - 1  # the same token twice running
        at.append((doc[1:] * (WORDS + SHAPES) + WORDS + pair)[doc[1:] == doc[:-1]])
    x = np.bincount(np.concatenate(at), minlength=len(n) * (WORDS + SHAPES)).reshape(len(n), -1)
    x = np.log1p(x)
    length = np.maximum(np.log1p(n), 1)[:, None]
    return (x / length).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit(x: np.ndarray, y: np.ndarray, dims: int = DIMS):
    """(weights of terms, projection, unit vectors, labels, share of label 1). ``x`` is overwritten."""
    share = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(y):
        return np.ones(WORDS + SHAPES, np.float32), np.zeros((WORDS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, share
    w = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
    w[WORDS:] *= SHAPE_WEIGHT
    x *= w
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(length > 0, length, 1)[:, None]
    v = right_vectors(x, dims)
    return w, v, unit(x @ v).astype(np.float32), y, share


def right_vectors(z: np.ndarray, dims: int, more: int = 16, rounds: int = 12) -> np.ndarray:
    """The right singular vectors of the largest ``dims`` singular values, by subspace iteration (no Gram matrix)."""
    size = min(dims + more, *z.shape)
    v = np.linalg.qr(np.random.default_rng(13).standard_normal((z.shape[1], size), dtype=np.float32))[0]
    for _ in range(rounds):
        v = np.linalg.qr(z.T @ np.linalg.qr(z @ v)[0])[0]
    _, values, turn = np.linalg.svd(z @ v, full_matrices=False)
    keep = int((values[:dims] > 1e-3).sum())
    return np.ascontiguousarray((v @ turn.T)[:, :keep], np.float32)


def vote(x: np.ndarray, model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    w, v, known, y, share = model
    latent = unit(unit(x * w) @ v)
    out = np.full(len(x), share)
    if not len(y):
        return out
    for a in range(0, len(x), 512):
        cos = latent[a : a + 512] @ known.T
        best = nearest(cos, neighbours)
        weight = np.maximum(np.take_along_axis(cos, best, 1), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        np.divide((weight * y[best]).sum(axis=1), total, out=out[a : a + 512], where=total > 0)
    return np.clip(out, 0, 1)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row in ascending order; of equal values the first columns count."""
    if cos.shape[1] <= k:
        return np.tile(np.arange(cos.shape[1]), (len(cos), 1))
    least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
    above, equal = cos > least, cos == least
    room = k - above.sum(axis=1)
    over = equal.sum(axis=1) > room
    if over.any():
        equal[over] &= np.cumsum(equal[over], axis=1) <= room[over, None]
    return np.nonzero(above | equal)[1].reshape(len(cos), k)


def sample_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bounded sample's term counts (as half floats) and labels, in the order of its keys."""

    def run(batches):
        import pyarrow as pa

        tokens = Tokens()
        for b in batches:
            x = counts(b.column(1).to_pylist(), tokens).astype(np.float16)
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary()), "label": b.column(2)})

    got = sorted(sample.mapInArrow(run, "key long, x binary, label int").collect(), key=lambda r: (r["key"], r["x"]))
    x = np.empty((len(got), WORDS + SHAPES), np.float32)
    for k, r in enumerate(got):
        x[k] = np.frombuffer(r["x"], np.float16)
    return x, np.array([r["label"] for r in got], np.int64)


def score(docs: DataFrame, model, columns: list[str], text: str) -> DataFrame:
    """``columns`` of every row and its score; no shuffle."""
    arrow_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        tokens = Tokens()
        for b in batches:
            found = vote(counts(b.column(b.num_columns - 1).to_pylist(), tokens), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], names=[*b.schema.names[:-1], "__sl_score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text).alias("__sl_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, `__sl_score` double")


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 3, held: int = 1, rows: int = TRAIN_ROWS):
    arrow_batches(docs.sparkSession, 500)
    return fit(*sample_counts(training_sample(docs, labels, label, folds, held, rows)))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(ids, learn(docs, labels, folds=folds, held=held, **options), ["doc_id"], "text")
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), F.col("__sl_score").alias("score"), (F.col("__sl_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    scored = score(docs, learn(docs, labels, **options), docs.columns, "text")
    return scored.where("__sl_score >= 0.5").drop("__sl_score")


def op8_latent_neighbours(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
