"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows and exact edit verification.

Documents and items are sequences of lower-case words. An item of n words leaks where a part of a document is
within k = floor(n / 5) edits of it (similarity 0.8 or more).

1. CGK random walks start at every word of a document: a walk writes the word it stands at and steps on by a random
   bit of the step and the word, which turns few edits into a small Hamming distance. Words are sampled at ``PLACES``
   steps, ``STRIDE`` apart; every run of ``RUN`` samples is a key of the LSH. A walk covers about nine words; so that
   a window as long as an item is compared as a whole, an item's walks start at each of its ``STEP``-th words. Where a
   key of an item's walk is one of a document's, the window that stands so beside the item is a candidate.
2. The number of walks is set for each class of like lengths: all of its items are edited at random k times (and tried
   ``TRIALS`` times at least) and searched by this same index, with one walk more until a share of ``RECALL`` is found
   or there are ``MOST_WALKS``.
3. Items under ``SHORT`` words are found by an exact way instead: k edits leave one of k + 1 blocks of words intact.
4. Of candidates, those go on around which enough of the item's words stand, and the exact semi-global edit distance
   of the item to the text around decides.

Items are a query set: they go to all documents without a shuffle of these. They come to the driver and are broadcast
in parts of ``PART_BYTES`` of text; a benchmark with more is dealt over several passes, one after the other.

Edge cases: null and empty texts match nothing and null or wordless items are never found; items under five
words must occur verbatim; ids may be null or repeated, each row gives its own result; an empty table on either
side gives no match. Words are compared by 32-bit hashes. Only ids and texts are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import best_substring
from .common import arrow_batches, drop_table, table
from .words import WordHashes, hashed_words, mix64

SIMILARITY, RECALL = 0.8, 0.995
PLACES, STRIDE, RUN, STEP = 6, 3, 3, 2
TRIALS, MOST_WALKS, SHORT, PART_BYTES = 128, 8, 20, 8 << 20
#: Words that are walked together, and words that a walk can reach.
CHUNK, REACH = 1 << 16, PLACES * STRIDE
#: Odd multipliers of the samples of a run.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def walk(h: np.ndarray, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, places reached), each (PLACES, n), of walks from the first n words of ``h``, which has REACH more.

    The random bits of a word are those of a hash of it, one for each step; STRIDE = 3 steps are put together by
    selecting among the bits of the words that can be reached.
    """
    raw = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 1_000_003 + 12_345)).view(np.uint8).reshape(len(h), 8)
    byte = [np.ascontiguousarray(raw[:, c]) for c in range((REACH + 7) // 8)]
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(k, np.uint8)])
    words, at = h.astype(np.uint32), np.arange(n)
    out, reached = np.empty((PLACES, n), np.uint32), np.empty((PLACES, n), np.int64)
    for i in range(PLACES):
        out[i], reached[i] = words[at], at
        if i + 1 < PLACES:
            one, two, three = ((byte[t // 8] >> np.uint8(t % 8)) & np.uint8(1) for t in range(STRIDE * i, STRIDE * i + 3))
            step = one + (two ^ (one & (two ^ ahead(two, 1))))
            far, further = (step >= 1).view(np.uint8), (step >= 2).view(np.uint8)
            step += three ^ (far & (three ^ ahead(three, 1))) ^ (further & (ahead(three, 1) ^ ahead(three, 2)))
            at = at + step[at]
    return out, reached


def runs(samples: np.ndarray):
    """(number of the run, keys) for each run of RUN samples."""
    by = [samples * f for f in FACTORS]
    for t in range(PLACES - RUN + 1):
        key = by[0][t] + by[1][t + 1] + by[2][t + 2] + np.uint32(t * 0x27D4EB2F & 0xFFFFFFFF)
        yield t, key ^ (key >> np.uint32(15))


def starts_in(n: int) -> np.ndarray:
    """Words of an item of n words at which its walks start; a walk goes on for about half its steps."""
    last = max(0, n - REACH // 2)
    return np.unique([*range(0, last + 1, STEP), last])


class Index:
    """Keys of one walk of some items, with the item and the start in it that each belongs to."""

    def __init__(self, number: int, words: list[np.ndarray], which: np.ndarray) -> None:
        self.number = number
        ends = np.cumsum([len(words[i]) for i in which])
        begins = ends - [len(words[i]) for i in which]
        starts = [starts_in(len(words[i])) for i in which]
        at = np.concatenate([b + s for b, s in zip(begins, starts, strict=True)])
        owner, start = np.repeat(which, [len(s) for s in starts]), np.concatenate(starts)
        end = np.repeat(ends, [len(s) for s in starts])
        h = np.concatenate([*[words[i] for i in which], np.zeros(REACH, np.uint64)])
        samples, reached = walk(h, number, int(ends[-1]))
        keys, owners, places = [], [], []
        for t, key in runs(samples[:, at]):
            # A run that stands on one word twice says little.
            ok = (reached[t + 2, at] < end) & (reached[t, at] < reached[t + 1, at]) & (reached[t + 1, at] < reached[t + 2, at])
            keys.append(key[ok])
            owners.append(owner[ok])
            places.append(start[ok])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.start = keys[order], np.concatenate(owners)[order].astype(np.int32), np.concatenate(places)[order].astype(np.int32)
        self.shift = np.uint32(32 - min(24, max(10, (64 * len(keys)).bit_length())))
        self.filter = np.zeros(1 << (32 - int(self.shift)), bool)
        self.filter[self.keys >> self.shift] = True

    def find(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, start of the window) for the first n words of ``h``, which has REACH more; starts may lie before them."""
        found = [(np.zeros(0, np.int64),) * 2]
        for _, key in runs(walk(h, self.number, n)[0]):
            at = np.flatnonzero(self.filter[key >> self.shift])
            low = np.searchsorted(self.keys, key[at])
            many = np.searchsorted(self.keys, key[at], "right") - low
            hit = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            found.append((self.owner[hit].astype(np.int64), np.repeat(at, many) - self.start[hit]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def gram_hashes(h: np.ndarray, g: int) -> np.ndarray:
    x = h[: max(0, len(h) - g + 1)] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, g):
        x = mix64(x) + h[k : len(h) - g + 1 + k]
    return mix64(x + np.uint64(g))


class Blocks:
    """The k + 1 blocks of short items, by the blocks' length."""

    def __init__(self, words: list[np.ndarray], edits: list[int], which: np.ndarray) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i in which.tolist():
            size = len(words[i]) // (edits[i] + 1)
            for b in range(edits[i] + 1):
                rows.setdefault(size, []).append((int(gram_hashes(words[i][b * size : (b + 1) * size], size)[0]), i, b * size))
        self.sizes = {}
        for g, r in rows.items():
            r.sort()
            known = np.array([x for x, _, _ in r], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[known >> np.uint64(44)] = True
            self.sizes[g] = seen, known, np.array([i for _, i, _ in r], np.int64), np.array([o for _, _, o in r], np.int64)

    def find(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = [(np.zeros(0, np.int64),) * 2]
        for g, (seen, known, owner, place) in self.sizes.items():
            x = gram_hashes(h[: n + g - 1], g)
            at = np.flatnonzero(seen[x >> np.uint64(44)])
            low = np.searchsorted(known, x[at])
            many = np.searchsorted(known, x[at], "right") - low
            hit = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            found.append((owner[hit], np.repeat(at, many) - place[hit]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


class Items:
    """A part of the items with their indexes. ``walks``: the number of walks of each item (0: found by blocks)."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        h, n = hashed_words(texts, WordHashes())
        ends = np.cumsum(n)
        keep = [k for k in range(len(ids)) if n[k]]
        self.ids = [ids[k] for k in keep]
        self.words = [h[ends[k] - n[k] : ends[k]] for k in keep]
        self.sets = [np.unique(w) for w in self.words]
        self.edits = [math.floor(len(w) * (1 - SIMILARITY) + 1e-9) for w in self.words]
        size = np.array([len(w) for w in self.words], np.int64)
        self.walks, self.indexes, self.recall = np.zeros(len(size), np.int64), [], {}
        if (size < SHORT).any():
            self.indexes.append(Blocks(self.words, self.edits, np.flatnonzero(size < SHORT)))
        if (size >= SHORT).any():
            self._add_walks(size)

    def _add_walks(self, size: np.ndarray) -> None:
        """Indexes of walks until each class of lengths reaches RECALL on its own items, edited at random."""
        rng = np.random.default_rng(9)
        classes = np.floor(4 * np.log2(np.maximum(size, 1))).astype(np.int64)
        names = np.unique(classes[size >= SHORT])
        of, docs = [], []
        for name in names.tolist():
            items = np.flatnonzero((classes == name) & (size >= SHORT))
            for i in np.tile(items, math.ceil(TRIALS / len(items))).tolist():
                of.append(i)
                docs.append(edited(self.words[i], self.edits[i], rng))
        of, gap = np.array(of), REACH
        # The edited items in one text, far enough from each other.
        ends = np.cumsum([len(d) + gap for d in docs])
        begins = ends - [len(d) + gap for d in docs]
        text = rng.integers(1, 1 << 32, int(ends[-1]) + REACH).astype(np.uint64)
        for b, d in zip(begins.tolist(), docs, strict=True):
            text[b : b + len(d)] = d
        found, left = np.zeros(len(of), bool), names
        for number in range(MOST_WALKS):
            which = np.flatnonzero(np.isin(classes, left) & (size >= SHORT))
            index = Index(number, self.words, which)
            self.indexes.append(index)
            self.walks[which] = number + 1
            for a in range(0, int(ends[-1]), CHUNK):
                n = min(CHUNK, int(ends[-1]) - a)
                i, s = index.find(text[a : a + n + REACH], n)
                d = np.searchsorted(ends, np.maximum(s + a, 0), "right")
                d = np.minimum(d, len(of) - 1)
                k = np.array(self.edits)[i]
                found[d[(of[d] == i) & (np.abs(s + a - begins[d]) <= k)]] = True
            self.recall = {name: float(found[classes[of] == name].mean()) for name in names.tolist()}
            left = np.array([c for c in left.tolist() if self.recall[c] < RECALL], np.int64)
            if not len(left):
                return


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    x = words.tolist()
    for _ in range(edits):
        p, kind = int(rng.integers(0, len(x))), int(rng.integers(0, 3))
        x[p : p + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 32))]
    return np.array(x, np.uint64)


def candidates(h: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Different (item, start of the window) of a sequence of words, sorted."""
    padded, out = np.concatenate([h, np.zeros(REACH, np.uint64)]), [np.zeros(0, np.int64)]
    span = np.int64(len(h) + 2 * (1 << 31))
    for a in range(0, len(h), CHUNK):
        n = min(CHUNK, len(h) - a)
        for index in items.indexes:
            i, s = index.find(padded[a : a + n + REACH], n)
            out.append(np.unique(i * span + (s + a + (1 << 31))))
    both = np.unique(np.concatenate(out))
    return both // span, both % span - (1 << 31)


def leaks(texts: list[str | None], items: Items, hashes: WordHashes) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, words, edits): the best part for each text and item, the earliest of equals."""
    h, n = hashed_words(texts, hashes)
    if not len(h) or not items.words:
        return []
    ends = np.cumsum(n)
    begins = ends - n
    item, start = candidates(h, items)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    cuts = [*np.flatnonzero(np.diff(item, prepend=-1)).tolist(), len(item)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        x = int(item[a])
        w, known, k, size = items.words[x], items.sets[x], items.edits[x], len(items.words[x])
        for b in range(a, z, 4096):
            s = start[b : min(b + 4096, z)]
            # The text that a window's middle stands in; a part that matches holds it.
            d = np.minimum(np.searchsorted(ends, np.clip(s + size // 2, 0, len(h) - 1), "right"), len(n) - 1)
            lo, hi = np.maximum(s - k, begins[d]), np.minimum(s + size + 3 * k, ends[d])
            at = lo[:, None] + np.arange(size + 4 * k)
            got = h[np.minimum(at, len(h) - 1)]
            inside = known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got
            enough = (inside & (at < hi[:, None])).sum(axis=1) >= size - k
            if not k:
                enough &= (got[:, :size] == w).all(axis=1) & (hi - lo == size)
                _, first = np.unique(d[enough], return_index=True)
                for y, t in zip(d[enough][first].tolist(), s[enough][first].tolist(), strict=True):
                    best.setdefault((x, y), (0, t - int(begins[y]), size))
                continue
            looked = {}
            for y, t, low, high in zip(d[enough].tolist(), s[enough].tolist(), lo[enough].tolist(), hi[enough].tolist(), strict=True):
                # One look takes in the windows of all shifts from here.
                if t + size + k <= looked.get(y, -1):
                    continue
                looked[y] = high
                cost, p, q = best_substring(w, h[low:high])
                if cost <= k and q > p:
                    best[x, y] = min(best.get((x, y), (cost + 1, 0, 0)), (cost, low + p - int(begins[y]), q - p))
    return [(y, x, first, words, cost) for (x, y), (cost, first, words) in best.items()]


def item_parts(benchmark: DataFrame, id_col: str, text_col: str):
    """The query set in parts of at most about PART_BYTES of text, made one after the other."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    for p in range(parts):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()
        got.sort(key=lambda r: (r["i"] is None, r["i"], r["t"]))
        yield Items([r["i"] for r in got], [r["t"] for r in got])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits, similarity: a row for each document and item that it leaks."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for items in item_parts(benchmark, item_col, item_text):
        if found:
            found[-1] = table(found[-1], "leaks")  # one part is broadcast at a time
        found.append(_leaks_of(texts, spark.sparkContext.broadcast(items)))
    return reduce(DataFrame.unionByName, found)


def _leaks_of(texts: DataFrame, shared) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        hashes, items = WordHashes(), shared.value
        for b in batches:
            ids, rows = b.column(0).to_pylist(), sorted(leaks(b.column(1).to_pylist(), items, hashes))
            if rows:
                d, i, start, size, edits = zip(*rows, strict=True)
                longest = [max(len(items.words[x]), z) for x, z in zip(i, size, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[x] for x in d], pa.int64()), "item_id": pa.array([items.ids[x] for x in i], pa.int64()), "start_word": pa.array(start, pa.int64()), "n_words": pa.array(size, pa.int64()), "edits": pa.array(edits, pa.int64()), "similarity": pa.array([1 - e / z for e, z in zip(edits, longest, strict=True)], pa.float64())})

    return texts.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, edits long, similarity double")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    spark = docs.sparkSession
    arrow_batches(spark)
    left, before = docs, None
    for items in item_parts(benchmark, item_col, item_text):
        if left is not docs:
            left = table(left, "unleaked")
            if before is not None:
                drop_table(before)
            before = left
        left = _kept_by(left, docs.columns.index(text_col), spark.sparkContext.broadcast(items))
    return left


def _kept_by(docs: DataFrame, place: int, shared) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            texts = b.column(place).to_pylist()
            keep = np.ones(len(texts), bool)
            keep[[x[0] for x in leaks(texts, shared.value, hashes)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_cgk_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
