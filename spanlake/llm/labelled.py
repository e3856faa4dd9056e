"""Bounded training samples of labelled documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Steps of the sampling hash; so many that a share of a sample in any table is at least one of them.
STEPS = 1 << 53


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """key, text, label of about ``rows`` labelled documents, 2 * ``rows`` at most, whose crc32(id) mod ``folds`` is not ``held``.

    Rows are taken by a hash of the id, so the same documents are taken each time. Null labels and ids don't count; of
    several labels of one document the largest does, and of several texts the first in order. The sample is bounded,
    so it is what is broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, folds) != held))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(STEPS))
    picked = known.where(place < math.ceil(share * STEPS)).groupBy("id").agg(F.max("label").alias("label")).orderBy(place, "id").limit(2 * rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.select(F.xxhash64("id", F.lit(seed)).alias("key"), "text", "label")
