"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of single words, of words cut to five and seven letters (a plain stemming), of pairs
of neighbours and of pairs with one word between, hashed to 2**20 places. Training is online with per-coordinate
rates and L1 sparsity on a bounded sample of labelled rows (``TRAIN_ROWS``). It runs in one task, which reads the
sample's features in batches, in the order of epochs and keys, so its memory is the model and a batch whatever the
lengths of the texts; the few weights that are not zero come to the driver, are broadcast, and every whole text is
scored.

Edge cases: null and empty texts have the bias alone for a score; repeated rows and ids are scored alike;
with no labelled rows, or none of a class, the score is the smoothed share of the class; an empty table gives
an empty result. Of the documents only id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, crc_mod, drop_table, table
from .labelled import training_sample
from .words import WordHashes, hashed_words, mix64

BITS = 20
#: The bound of the training sample and the times that it is gone through.
TRAIN_ROWS, EPOCHS = 12000, 4


class Stems(WordHashes):
    """word -> places of the word and of its first five and first seven letters, in one number."""

    def __missing__(self, word: str) -> int:
        parts = [word, word[:5] + "*", word[:7] + "**"]
        if len(self) >= self.kept:
            self.clear()
        self[word] = found = sum((zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS)) << (BITS * k) for k, p in enumerate(parts))
        return found


def grams(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(place, document) of all features, repeats included."""
    h, n = hashed_words(texts, hashes)
    doc = np.repeat(np.arange(len(n)), n)
    places, docs = [(h >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1) for k in range(3)], [doc] * 3
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD1B54A32D192ED03)):
        ok = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        a, b = (h[:-gap], h[gap:]) if len(doc) > gap else (h[:0], h[:0])
        places.append(mix64(a * np.uint64(salt) + b)[ok] >> np.uint64(64 - BITS))
        docs.append(doc[gap:][ok] if len(doc) > gap else doc[:0])
    return np.concatenate(places).astype(np.int64), np.concatenate(docs)


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) with logistic loss on binary features."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, bias = self.weights(at), self.bias
        g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * bias
        self.bias_n += g * g


def train(rows) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias), only what is not zero, from (places of features, label) in the order of training.

    With one class alone the bias is that of its smoothed share and there are no weights."""
    model, seen = Ftrl(), [0, 0]
    for at, y in rows:
        seen[y] += 1
        model.learn(at, y)
    if not all(seen):
        share = (seen[1] + 0.5) / (sum(seen) + 1)
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share)))
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at], float(model.bias)


def sample_features(sample: DataFrame) -> DataFrame:
    """key, at (places of the features) and label of the bounded sample, written."""

    def run(batches):
        import pyarrow as pa

        hashes = Stems()
        for b in batches:
            at, doc = grams(b.column(1).to_pylist(), hashes)
            order = np.argsort(doc, kind="stable")
            parts = np.split(at[order], np.searchsorted(doc[order], np.arange(1, b.num_rows)))
            yield pa.RecordBatch.from_pydict({"key": b.column(0), "at": pa.array([np.unique(p).astype("<u4").tobytes() for p in parts], pa.binary()), "label": b.column(2)})

    return table(sample.mapInArrow(run, "key long, at binary, label int"), "ftrl-sample")


def learn(sample: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of a bounded sample, as in :func:`train`."""
    spark = sample.sparkSession
    arrow_batches(spark, 100)
    features = sample_features(sample)
    ordered = features.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", "key", "at")

    def run(batches):
        import pyarrow as pa

        at, w, bias = train((np.frombuffer(x, "<u4"), y) for b in batches for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_pydict({"at": pa.array([*at.tolist(), -1], pa.int64()), "w": pa.array([*w.tolist(), bias], pa.float64())})

    got = ordered.select("at", "label").mapInArrow(run, "at long, w double").toArrow().sort_by("at")
    drop_table(features)
    at, w = got["at"].to_numpy(), got["w"].to_numpy()
    # Of an empty sample no task may have run.
    return (at[1:], w[1:], float(w[0])) if len(at) else train([])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; no shuffle."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        hashes = Stems()
        for b in batches:
            places, doc = grams(b.column(1).to_pylist(), hashes)
            used = dense[places] != 0
            pairs = np.unique(doc[used] * (1 << BITS) + places[used])
            total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=b.num_rows) + bias
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(training_sample(docs, labels, label, folds, held, rows))
    out = score(docs, model).withColumn("held_out", crc_mod("doc_id", folds) == held)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
