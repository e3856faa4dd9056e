"""Line dedup over overlapping windows of three lines.

Each run of three consecutive lines is hashed to 128 bits. Of a window that occurs more than once anywhere,
the first occurrence, by (doc_id, text hash, position), is kept; positions covered by any later occurrence
are removed, so overlapping windows merge into whole passages.

Edge cases: null texts stay null and have no lines; documents of fewer than three lines have no window and
stay; windows of three empty lines don't count; repeated rows (same id and text) are one document and all get
its result; null ids order first; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


def bound(value, f):
    """f(value) with ``value`` computed once, however often f uses it and whatever lambdas it does so in."""
    return F.transform(F.array(value), f)[0]


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text of every row. Only hashes are shuffled by window; counting
    pre-aggregates, and the join of windows with repeated ones is one that adaptive execution splits where it is hot."""
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.lit(1), F.col(text_col)).alias("h"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    lines = F.split("text", "\n", -1)

    def windows_of(ls):
        def window(i):
            at = [ls[i + k] for k in range(3)]
            return F.when(F.octet_length(at[0]) + F.octet_length(at[1]) + F.octet_length(at[2]) > 0, F.struct(i.alias("pos"), F.xxhash64(F.lit(3), *at).alias("a"), F.xxhash64(F.lit(5), *at).alias("b")))

        return F.when(F.size(ls) >= 3, F.transform(F.sequence(F.lit(0), F.size(ls) - 3), window))

    windows = base.select("key", F.explode(bound(lines, windows_of)).alias("w")).where("w is not null").select("key.id", "key.h", "w.pos", "w.a", "w.b")
    windows = table(windows, "line-windows")
    place = F.struct("id", "h", "pos")
    groups = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    later = windows.join(groups, ["a", "b"]).where(place != F.col("first"))
    covered = later.groupBy("id", "h").agg(F.collect_set("pos").alias("starts")).select(F.struct("id", "h").alias("key"), "starts")
    covered = covered.withColumn("gone", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(s, s + 1, s + 2)))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    out = base.join(covered.select("key", "gone"), "key", "left")

    def cleaned(ls):
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: ls[i]), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(bound(lines, cleaned))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), text.alias("text"))


def op5_line_windows(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
w AS (SELECT doc_id, text, pos, line, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM l WINDOW o AS (PARTITION BY doc_id, text ORDER BY pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k FROM w WHERE l3 IS NOT NULL AND line || l2 || l3 <> ''),
g AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
x AS (SELECT l.doc_id, l.text, count(*) AS n, count(g.pos) AS gone, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS clean FROM l LEFT JOIN g USING (doc_id, text, pos) GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(x.n, 0)::BIGINT AS n_lines, coalesce(x.gone, 0)::BIGINT AS n_removed, CASE WHEN x.gone > 0 THEN coalesce(x.clean, '') ELSE d.text END AS text
FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id AND d.text = x.text
"""
