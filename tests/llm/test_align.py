import random

import numpy as np
import pytest

from spanlake.llm import align


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_edit_distance(seed):
    rng = random.Random(seed)
    for _ in range(600):
        a = [rng.randrange(1 + rng.randrange(9)) for _ in range(rng.randrange(40))]
        b = list(a) if rng.random() < 0.6 else [rng.randrange(5) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(12)):
            p, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[p : p + (kind != 1)] = [] if kind == 2 else [rng.randrange(6)]
        want, bound = table(a, b), rng.randrange(45)
        got = align.edit_distance(np.array(a, np.int64), np.array(b, np.int64), bound)
        assert got == (want if want <= bound else None), (a, b, bound)
        if a and b:
            assert align._band(np.array(a), np.array(b), max(bound, abs(len(a) - len(b)))) == (want if want <= min(max(bound, abs(len(a) - len(b))), max(len(a), len(b))) else None)


def test_long_sequences():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 500, 3000)
    b = np.delete(a, rng.choice(3000, 120, replace=False))
    assert align.edit_distance(a, b, 600) == 120 and align.edit_distance(a, b, 119) is None
    assert align.edit_distance(a, a, 0) == 0 and align.edit_distance(a[:0], a[:3], 3) == 3


def test_best_substring():
    rng = random.Random(5)
    for _ in range(200):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 8))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        cost, a, z = align.best_substring(np.array(item), np.array(text, np.int64))
        best = min(table(item, text[x:y]) for x in range(len(text) + 1) for y in range(x, len(text) + 1))
        assert cost == best == table(item, text[a:z])
