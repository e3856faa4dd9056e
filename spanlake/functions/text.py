"""Tokens, token matches and LIKE patterns as Columns, with the planner's view of LIKE patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def fts_tokens(text: Column) -> Column:
    """Tokens of a text: maximal runs of letters and numbers, split first and lower-cased after; null for null."""
    return F.transform(F.filter(F.split(text, SEPARATORS), lambda t: t != ""), F.lower)


def tokens_of(text: str) -> list[str]:
    """:func:`fts_tokens` of a Python string, for query texts."""
    import regex

    return [t.lower() for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", text) if t]


def contains_all(text: Column, query: str) -> Column:
    """True where every token of ``query`` is a token of the text; never null, false if the query has no token.

    Lower-casing maps letter by letter but for the final sigma, so an ASCII token must occur in the lower-cased text:
    that cheap test comes before the text is split.
    """
    wanted = sorted(set(tokens_of(query)))
    if not wanted:
        return F.lit(False)
    test = F.lit(True)
    for t in wanted:
        if t.isascii():
            test = test & F.contains(F.lower(text), F.lit(t))
    return F.coalesce(test & (F.size(F.array_except(F.array(*map(F.lit, wanted)), fts_tokens(text))) == 0), F.lit(False))


def like(text: Column, pattern: str) -> Column:
    """Anchored, case-sensitive LIKE with % and _ and no escape character; false for null."""
    return F.coalesce(text.like(pattern.replace("\\", "\\\\")), F.lit(False))


def like_constraints(pattern: str) -> list[tuple[str, str]]:
    """What tokens every matching text must have: ("token", t) or ("prefix", p), sorted; see ``tests/test_text.py``.

    A token of the pattern's literal parts is whole if separators or the pattern's ends stand at both sides; if a
    wildcard follows it is a prefix. Of a prefix only leading ASCII counts, as lower case can depend on what follows.
    """
    import regex

    found: set[tuple[str, str]] = set()
    parts = re.split(r"([%_])", pattern)
    for k in range(0, len(parts), 2):
        literal, first, last = parts[k], k == 0, k == len(parts) - 1
        for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", literal):
            if m.start() == 0 and not first:
                continue
            if m.end() < len(literal) or last:
                found.add(("token", m[0].lower()))
            elif prefix := re.match(r"[\x00-\x7f]*", m[0])[0].lower():
                found.add(("prefix", prefix))
    return sorted(found)
