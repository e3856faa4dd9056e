"""The token index: postings (token, key), and text conditions answered by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import SEPARATORS, contains_all, fts_tokens, like, like_constraints, tokens_of


def postings(state: DataFrame) -> DataFrame:
    """token, key: a row for each distinct token of each record."""
    # Words are made distinct before they are lower-cased too, as most of a text's words repeat.
    words = F.array_distinct(F.array_remove(F.split(F.col("text"), SEPARATORS), ""))
    return state.where("text is not null").select("key", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("token")).select("token", "key")


def arranged(log: DataFrame) -> DataFrame:
    """The postings of a log as they are written: each task sorts those of the texts it reads by token, so that a read of one
    token touches few row groups of each file. Texts are split once, and nothing is shuffled."""
    return postings(log).sortWithinPartitions("token", "key")


def write_postings(log: DataFrame, folder: str) -> None:
    to = arranged(log).write.option("compression", "zstd").option("parquet.bloom.filter.enabled#token", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    to.parquet(folder)


def _counted(ts: Column) -> Column:
    """(token, n) of each different token of a sorted array: the lengths of its runs."""
    starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (ts[i - 1] != ts[i]))
    run = lambda of: lambda at, k: F.struct(ts[at].alias("token"), (F.coalesce(F.get(of, k + 1), F.size(ts)) - at).cast("long").alias("n"))
    # Lambdas' variables, so that a text is split and its runs are found once.
    return F.transform(F.array(starts), lambda of: F.transform(of, run(of)))[0]


def dictionary(state: DataFrame) -> DataFrame:
    """token, n (occurrences), docs (records), in one aggregation: a record counts its tokens before they leave it."""
    counts = F.transform(F.array(F.sort_array(fts_tokens(F.col("text")))), lambda ts: F.when(F.size(ts) > 0, _counted(ts)))[0]
    each = state.where("text is not null").select(F.explode(counts).alias("e"))
    return each.select("e.*").groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def keys_with(index: DataFrame, tokens: list[str], prefixes: list[str] = ()) -> DataFrame:
    """Keys that have every token, and for every prefix a token that starts with it."""
    tests = [F.col("token") == t for t in tokens] + [F.col("token").startswith(p) for p in prefixes]
    any_ = F.lit(False)
    for t in tests:
        any_ = any_ | t
    # The condition on tokens reaches the index's scan; each key then needs one hit of every kind.
    hits = index.where(any_).groupBy("key").agg(*[F.max(t).alias(f"_{k}") for k, t in enumerate(tests)])
    return hits.where(" and ".join(f"_{k}" for k in range(len(tests)))).select("key")


def match(state: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """Records whose text has all tokens of ``query``, by the index."""
    wanted = sorted(set(tokens_of(query)))
    if not wanted:
        return state.where(F.lit(False))
    return state.join(keys_with(index, wanted), "key", "left_semi").where(contains_all(F.col("text"), query))


def match_like(state: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """Records whose text is LIKE ``pattern``: the index narrows where the pattern allows, the text decides."""
    known = like_constraints(pattern)
    out = state
    if known:
        keys = keys_with(index, [t for kind, t in known if kind == "token"], [t for kind, t in known if kind == "prefix"])
        out = out.join(keys, "key", "left_semi")
    return out.where(like(F.col("text"), pattern))


def tokens_with_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """Keys with a token that starts with ``prefix``."""
    return index.where(F.col("token").startswith(prefix)).select("key").distinct()
