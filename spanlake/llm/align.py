"""Edit distances of integer sequences within a bound."""

from __future__ import annotations

import numpy as np

#: Up to so many edits the diagonals are walked one by one; beyond, a band of the table is filled column by column.
WALKED = 6


def edit_distance(a: np.ndarray, b: np.ndarray, bound: int) -> int | None:
    """The edit distance, or None if it is over ``bound``. The alignment stays in a band of ``bound`` diagonals."""
    if abs(len(a) - len(b)) > bound:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return max(len(a), len(b)) - n
    a, b = a[differ[0] :], b[differ[0] :]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    cut = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not len(a) or not len(b):
        found = max(len(a), len(b))
        return found if found <= bound else None
    found = _walk(a, b, min(bound, WALKED))
    return found if found is not None or bound <= WALKED else _band(a, b, bound)


def _walk(a: np.ndarray, b: np.ndarray, bound: int) -> int | None:
    """Furthest points on each diagonal for 0, 1, 2, ... edits (Ukkonen 1985)."""
    n, m = len(a), len(b)
    if abs(n - m) > bound:
        return None
    x, y = a.tolist(), b.tolist()
    far = {}
    for e in range(bound + 1):
        new = {}
        for d in range(-e, e + 1):
            if not e:
                i = 0
            else:
                i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            j, stop = i + d, 0
            while i < n and j < m and x[i] == y[j]:
                i, j, stop = i + 1, j + 1, stop + 1
                if stop == 32:
                    k = min(n - i, m - j)
                    differ = (a[i : i + k] != b[j : j + k]).argmax() if k else 0
                    step = k if k and a[i + differ] == b[j + differ] else int(differ)
                    i, j = i + step, j + step
                    break
            new[d] = i
        far = new
        if far.get(m - n, -1) >= n:
            return e
    return None


def _band(a: np.ndarray, b: np.ndarray, bound: int) -> int | None:
    """Banded alignment with a column of the band in the bits of an integer (Hyyro 2003).

    Bit r of column i stands for row i + bound + 1 - width + r of the longer sequence; the band moves down by a row
    with each column. The distance is followed along the band's lower diagonal to the last row, and then along it.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    bound = min(bound, n)
    width = 2 * bound + 2
    full, lead = (1 << width) - 1, width - 1 - bound
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist(), lead):
        at[x] = at.get(x, 0) | (1 << k)
    up, down = (full << lead) & full, 0
    found, last = bound, width - 1
    for i, x in enumerate(b[: n - bound].tolist()):
        match = (at.get(x, 0) >> i) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = down | (full & ~(same | up)), same & up
        if not same >> last:
            found += 1
            # Only the steps along the last row can still lower it.
            if found > bound + m - (n - bound):
                return None
        same >>= 1
        up, down = minus | (full & ~(same | plus)), same & plus
    bit = 1 << (width - 2)
    for i, x in enumerate(b[n - bound :].tolist(), n - bound):
        match = (at.get(x, 0) >> i) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = down | (full & ~(same | up)), same & up
        found += bool(plus & bit) - bool(minus & bit)
        bit >>= 1
        same >>= 1
        up, down = minus | (full & ~(same | plus)), same & plus
    return found if found <= bound else None


def best_substring(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``text`` nearest to ``item``; the earliest end, then the latest start."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, symbol in enumerate(item, 1):
        over = cost[:-1] + (text != symbol)
        down = cost + 1
        take = np.concatenate([[True], down[1:] < over])
        new = np.where(take, down, np.concatenate([[i], over]))
        begun = np.where(take, start, np.concatenate([[0], start[:-1]]))
        slack = new - steps
        low = np.minimum.accumulate(slack)
        # Where the value comes from the left, it comes from the last cell that set the running minimum.
        source = np.maximum.accumulate(np.where(slack <= low, steps, 0))
        cost, start = low + steps, begun[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end
