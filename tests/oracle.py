"""The semantics in plain Python: what the tests hold the engine against."""

from __future__ import annotations

import itertools
import math
from functools import cache

import regex

WORD_CHARACTER = regex.compile(r"[\p{Alphabetic}\p{N}]")


def tokens(text: str) -> list[str]:
    groups = itertools.groupby(text, key=lambda c: WORD_CHARACTER.match(c) is not None)
    return ["".join(g).lower() for inside, g in groups if inside]


def like(pattern: str, text: str) -> bool:
    @cache
    def rest(p: int, t: int) -> bool:
        if p == len(pattern):
            return t == len(text)
        if pattern[p] == "%":
            return rest(p + 1, t) or (t < len(text) and rest(p, t + 1))
        return t < len(text) and pattern[p] in ("_", text[t]) and rest(p + 1, t + 1)

    return rest(0, 0)


def resolve(writes: list[tuple]) -> dict[str, dict]:
    """writes: (op, key, ts, labels, numerics, text) in write order."""
    state: dict[str, dict] = {}
    for op, key, ts, labels, numerics, text in writes:
        if op == "del" or (op == "put" and labels.get("del") == "1"):
            state.pop(key, None)
        elif op == "put":
            state[key] = {"key": key, "ts": ts, "labels": dict(labels), "numerics": dict(numerics), "text": text}
        else:
            r = state.setdefault(key, {"key": key, "ts": ts, "labels": {}, "numerics": {}, "text": None})
            r["ts"] = max(r["ts"], ts)
            for n, v in numerics.items():
                r["numerics"][n] = r["numerics"].get(n, 0.0) + v
    return state


def matches(r: dict, s) -> bool:
    if s.time_range and not s.time_range[0] <= r["ts"] <= s.time_range[1]:
        return False
    if s.key_prefix and not r["key"].startswith(s.key_prefix):
        return False
    if any(r["labels"].get(n) != v for n, v in s.labels.items()):
        return False
    for n, (lo, hi) in s.ranges.items():
        v = r["numerics"].get(n)
        if v is None or not lo <= v <= hi:
            return False
    if s.text_match is not None:
        q = tokens(s.text_match)
        if r["text"] is None or not q or not set(q) <= set(tokens(r["text"])):
            return False
    if s.text_like is not None and (r["text"] is None or not like(s.text_like, r["text"])):
        return False
    if s.after is not None:
        ts, key = s.after
        asc = s.order_by is not None and not s.order_by.descending
        if not ((r["ts"] > ts if asc else r["ts"] < ts) or (r["ts"] == ts and r["key"] > key)):
            return False
    return True


def scan(state: dict[str, dict], s) -> list[dict]:
    rows = [r for r in state.values() if matches(r, s)]
    by = s.order_by

    def place(r):
        if by is None or by.metric is None:
            return (0, r["ts"] if by is not None and not by.descending else -r["ts"], r["key"])
        v = r["numerics"].get(by.metric)
        if v is None or math.isnan(v):
            return (1, 0, r["key"])
        return (0, -v if by.descending else v, r["key"])

    rows.sort(key=place)
    return rows[: s.limit] if s.limit else rows
