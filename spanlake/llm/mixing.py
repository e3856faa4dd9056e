"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document gets an expected number of copies e. Its whole part is allocated with certainty; the
fractional part is its inclusion probability p. Documents of a source are ranked by
q = (u / (1 - u)) / (p / (1 - p)) with u uniform from a hash, and the lowest ranks are taken until the
words that the source still lacks are filled: a sample of fixed size (in words) with unequal
probabilities. The ranks are never sorted over a whole source: a histogram of 4096 bins finds the bin in
which the sample ends and only that bin's rows are ordered.

Edge cases: a null text has size 0 and takes part with 0 words; null sources form a source of their own,
last in order; a null id is hashed as 'null'; repeated rows are alike in rank and are taken or left
together; an empty table gives an empty result. Other columns are never read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, small, table

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, id_col: str, text: str) -> Column:
    """In (0, 1), from 52 bits of an md5 of seed, id and text."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    key = F.md5(F.concat_ws("|", F.lit(seed), ident, F.md5(F.coalesce(F.col(text), F.lit("")))))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """sizes: key, source, source_size, tilt_sum per source. Adds weight and target: sources by code point, null
    last, weigh 1, 2, 3, repeating; a target stops at max_repeat times the size and the rest is shared again."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", ((F.col("weight") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("above", F.col("level") * F.col("weight") > F.col("cap"))
    free = F.min(F.when(~F.col("above"), F.struct("place", "level"))).over(every)
    target = F.when(F.col("above"), F.col("cap").cast("double")).otherwise(free["level"] * F.col("weight"))
    return ranked.withColumn("target", target).select("key", "source_size", "tilt_sum", "target")


def with_odds(rows: DataFrame, per_source: DataFrame, max_repeat: int, tilt: float) -> DataFrame:
    """Adds e's whole part, the rank key (null where p = 0) and its bin."""
    x = rows.join(per_source, "key")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    room = F.least(r, F.lit(float(max_repeat)) - r) * F.lit(tilt)
    mean = F.when(F.col("source_size") > 0, F.col("tilt_sum") / F.col("source_size")).otherwise(F.lit(0.0))
    x = x.withColumn("e", F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeat)), r + room * (F.col("lean") - mean) / 1000)))
    x = x.withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("whole"))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    x = x.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), q))
    return x.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("long"))


def leaning(size: Column) -> Column:
    """0 to 1000: documents with more context are somewhat likelier; see ``tilt``."""
    return F.floor(size * 1000 / (size + 256)).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", max_repeat: int = 3, tilt: float = 0.5, keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for every row; with ``keep`` the input's columns and copies.

    tilt: how far expected copies lean towards documents with more context (0: all of a source alike); the
    sum of expected words is the target for any tilt.
    """
    names = docs.columns
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), size_of(text_col).alias("size"), uniform(seed, id_col, text_col).alias("u"))
    rows = table(slim.withColumn("lean", leaning(F.col("size"))), "mix-sizes")
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("lean")).alias("tilt_sum"))
    per_source = table(targets(sizes, max_repeat), "mix-targets")
    x = with_odds(rows, small(per_source), max_repeat, tilt)
    need = x.groupBy("key").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    bins = x.where("q is not null").groupBy("key", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))
    bins = bins.join(need, "key").withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    # The bin in which the sample ends; all bins below it are taken whole.
    last = table(bins.where("before < need").groupBy("key").agg(F.max_by(F.struct("bin", "before", "need"), "bin").alias("l")).select("key", "l.*"), "mix-bins")
    edge = x.where("q is not null").join(small(last), ["key", "bin"])
    run = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("q", "id"))
    edge = edge.withColumn("run", run).where("run <= need").groupBy("key").agg(F.max(F.struct("q", "id")).alias("cut"), F.max("run").alias("filled"))
    cut = table(last.join(edge, "key", "left").select("key", "need", F.col("bin").alias("end"), "cut", (F.col("need") - F.coalesce("filled", "before")).alias("gap")), "mix-cuts")
    # One more document a source, if there is one whose size brings the source nearer to its target.
    y = _taken(x, small(cut)).where("q is not null and not drawn and abs(gap - size) < abs(gap)")
    fit = y.groupBy("key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "q", "id")).alias("fit"))
    final = table(cut.join(fit, "key", "left"), "mix-fits")
    for t in (last, cut):
        drop_table(t)
    if keep:
        wide = docs.withColumns({"__sl_key": key, "__sl_size": size_of(text_col), "__sl_u": uniform(seed, id_col, text_col)})
        wide = wide.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.col("__sl_key").alias("key"), F.col("__sl_size").alias("size"), F.col("__sl_u").alias("u"))
        x = with_odds(wide.withColumn("lean", leaning(F.col("size"))), small(per_source), max_repeat, tilt)
    out = _taken(x, small(final))
    fitted = F.coalesce(F.struct("q", "id") == F.struct("fit.q", "fit.id"), F.lit(False))
    copies = F.col("whole") + (F.col("drawn") | (fitted & F.col("q").isNotNull())).cast("long")
    if keep:
        return out.select("row.*", copies.alias("__sl_copies"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def _taken(x: DataFrame, cut: DataFrame) -> DataFrame:
    low = (F.col("bin") < F.col("end")) | ((F.col("bin") == F.col("end")) & (F.struct("q", "id") <= F.col("cut")))
    return x.join(cut, "key", "left").withColumn("drawn", F.coalesce(low, F.lit(False)))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as :func:`mix` takes it, with the columns of ``docs``."""
    x = mix(docs, keep=True, **options)
    return x.withColumn("__sl_copies", F.explode(F.array_repeat(F.lit(1), F.col("__sl_copies").cast("int")))).drop("__sl_copies")


def op9_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  (('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
rows_ AS (SELECT *, floor(size * 1000 / (size + 256))::BIGINT AS lean FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * lean)::BIGINT AS tilt_sum FROM rows_ GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
  row_number() OVER o AS place FROM s1 WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
s3 AS (SELECT *, CASE WHEN level * weight > cap THEN cap::DOUBLE ELSE (SELECT min_by(level, place) FROM s2 WHERE level * weight <= cap) * weight END AS target FROM s2),
x0 AS (SELECT r.*, source_size, target, greatest(0.0, least(3.0, (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END)
  + least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END, 3.0 - CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) * 0.5::DOUBLE
  * (lean - CASE WHEN source_size > 0 THEN tilt_sum / source_size ELSE 0.0 END) / 1000)) AS e
  FROM rows_ r JOIN s3 ON r.source IS NOT DISTINCT FROM s3.source),
x1 AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM x0),
x2 AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM x1),
x3 AS (SELECT *, max(target) OVER (PARTITION BY source) - sum(whole * size) OVER (PARTITION BY source) AS need,
  sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, id) AS run FROM x2),
x4 AS (SELECT *, q IS NOT NULL AND run <= need AS drawn FROM x3),
x5 AS (SELECT *, need - sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM x4),
x6 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN q IS NOT NULL AND NOT drawn AND need > 0 AND abs(gap - size) < abs(gap) THEN abs(gap - size) END NULLS LAST, q, id) = 1
  AND q IS NOT NULL AND NOT drawn AND need > 0 AND abs(gap - size) < abs(gap) AS fitted FROM x5)
SELECT id AS doc_id, size, source_size, target, ((whole + CASE WHEN drawn OR fitted THEN 1 ELSE 0 END) * size)::BIGINT AS taken, whole + CASE WHEN drawn OR fitted THEN 1 ELSE 0 END AS copies FROM x6
"""
