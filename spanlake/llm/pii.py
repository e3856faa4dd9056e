"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field runs over the document's candidate tokens (runs of digits with their
separators, and words with an @; all else is fixed to "no entity"): a chain links neighbours, and skip edges
link each token to the last ``FAN`` ones before it that are the same (the last eight digits, the dotted number, the
address without regard to case) and to the last ``FAN`` that are similar (all digits but the last two, the same
network of a dotted number, the same part before an @), with potentials of their own. So all tokens of a group of
like ones are connected, and none is joined with all others. Loopy sum-product message passing gives marginals with
the base spans' labels observed, so what is an entity in one place becomes one in its other places, also where it is
written in a way that no pattern takes. A span is added where the most likely label is an entity with probability
``SURE`` at least, a like token bears that label and no base span overlaps.

Weights are trained by pseudo-likelihood, with the base spans of a bounded sample of documents (``TRAIN_DOCS``
different texts with at most ``TRAIN_NODES`` candidate tokens each), passed on to tokens that are the same or similar, as labels
and a third of the shape features hidden, so that the edges' weights are learnt. The sample is what lies below a
threshold of a hash of the text, set from the count, so it is there at any size of table.

Memory: documents go through the field in groups of at most ``NODES`` tokens, a document with more alone; tokens
whose stretch of neighbours holds no like ones are left out. Features are kept as lists of places.

Edge cases: null and empty texts have no span; repeated rows and ids are treated alike; without documents to
learn from nothing is added; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_NODES, SURE = 2000, 300, 0.6
#: Like tokens before it that a token is linked with, of either sort; tokens of one run of the field; steps of the hash.
FAN, NODES, STEPS = 2, 20_000, 1 << 53
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The same matches as without the look-behind and the possessive marks, in linear time on long runs of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().+-]{0,2}[0-9])*")
NOT_DIGIT = re.compile(r"[^0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CONTEXT = 64
SHAPE = 24


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, in order."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        # No local part holds an @, so a match's start is fixed by its @ and the end of the match before.
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def nodes_of(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, key of the same tokens or "", key of similar tokens or "") of candidate tokens, in order."""
    words, at, free = [], text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > free and not text[start - 1].isspace() and text[start - 1] != "@":
            start -= 1
        while end < len(text) and not text[end].isspace() and text[end] != "@":
            end += 1
        cut = text[start:end].rstrip(".,;:!?)>]\"'")
        start += len(cut) - len(cut.lstrip("(<[\"'"))
        cut = text[start : start + len(cut)].rstrip(".,;:!?)>]\"'")
        if start < at < start + len(cut) - 1:
            low = cut.lower()
            words.append((start, start + len(cut), low, low[: at - start + 1]))
            free = end
        at = text.find("@", at + 1)
    out, w = [], 0
    for m in NUMBER.finditer(text):
        while w < len(words) and words[w][1] <= m.start():
            out.append(words[w])
            w += 1
        if w == len(words) or words[w][0] >= m.end():
            digits = NOT_DIGIT.sub("", m[0])
            if m[0].count(".") == 3 and len(digits) + 3 == m.end() - m.start():
                out.append((m.start(), m.end(), "." + m[0], "n" + m[0].rpartition(".")[0]))
            elif len(digits) >= 8:
                out.append((m.start(), m.end(), digits[-8:], f"{len(digits)}:{digits[:-2]}"))
            else:
                out.append((m.start(), m.end(), "", ""))
    return out + words[w:]


def features(text: str, start: int, end: int) -> list[int]:
    """Active features: shape, then hashed words before and after."""
    word = text[start:end]
    digits = NOT_DIGIT.sub("", word)
    n = len(digits)
    on = [0]
    on += [1] if "@" in word else []
    on += [2] if word.startswith("+") else []
    on += [3] if word.count(".") == 3 and n + 3 == len(word) else []
    on += [4] if word == digits else []
    on += [5] if " " in word else []
    on += [6] if "-" in word else []
    on += [7] if "(" in word or ")" in word else []
    on.append(8 + min(n, 21) // 3)
    on += [16] if 12 <= n <= 19 and luhn(digits) else []
    on += [17] if 3 in on and all(len(p) <= 3 and int(p) <= 255 for p in word.split(".")) else []
    on += [18] if "@" in word and DOMAIN.search(word) else []
    on += [19] if 9 <= n <= 15 else []
    before = text[max(0, start - 40) : start].split()
    after = text[end : end + 40].split()
    on.append(SHAPE + zlib.crc32((before[-1] if before else "^").lower().encode("utf-8", "surrogatepass")) % CONTEXT)
    on.append(SHAPE + CONTEXT + zlib.crc32((after[0] if after else "$").lower().encode("utf-8", "surrogatepass")) % CONTEXT)
    return on


WIDTH = SHAPE + 2 * CONTEXT
K = len(KINDS) + 1


class Graph:
    """Candidate tokens of documents with their edges. ``on`` and ``of``: active features and the nodes they belong to."""

    def __init__(self) -> None:
        self.where: list[tuple[int, int, int]] = []
        self.on: list[int] = []
        self.of: list[int] = []
        self.label: list[int] = []
        self.edges: tuple[list, list, list] = ([], [], [])

    def add(self, d: int, text: str, base: list[tuple[int, int, int]], *, every: bool = False) -> None:
        """Document ``d``; without ``every`` only stretches of neighbours with like tokens."""
        nodes = nodes_of(text)
        stretch = np.cumsum([0, *[b[0] - a[1] > 40 for a, b in zip(nodes, nodes[1:], strict=False)]])[: len(nodes)].tolist()
        like, last = [], ({}, {})
        for k, node in enumerate(nodes):
            seen: set[int] = set()
            for kind in (0, 1):
                if key := node[2 + kind]:
                    before = last[kind].setdefault(key, [])
                    for j in before[-FAN:]:
                        if j not in seen:
                            seen.add(j)
                            like.append((kind, j, k))
                    before.append(k)
        if not every:
            used = {stretch[k] for _, i, j in like for k in (i, j)}
        at, b, before = {}, 0, None
        for k, (start, end, _, _) in enumerate(nodes):
            if not every and stretch[k] not in used:
                continue
            while b < len(base) and base[b][2] <= start:
                b += 1
            over = next((x for x in base[b : b + 4] if x[0] < end and start < x[2]), None)
            at[k] = node = len(self.where)
            self.where.append((d, start, end))
            f = features(text, start, end)
            self.on += f
            self.of += [node] * len(f)
            self.label.append(0 if over is None else over[1] + 1)
            if before is not None and stretch[before] == stretch[k]:
                self.edges[0].append((at[before], node))
            before = k
        for kind, i, j in like:
            self.edges[1 + kind].append((at[i], at[j]))

    def arrays(self):
        """(active features, their nodes, labels, [chain, same, similar] edges)."""
        pairs = [np.array(e, np.int64).reshape(-1, 2) for e in self.edges]
        return np.array(self.on, np.int64), np.array(self.of, np.int64), np.array(self.label, np.int64), pairs


def shared_labels(y: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Labels for training: what a pattern finds in one place is that entity in its like places too."""
    y = y.copy()
    for edges in (skip, skip[::-1, ::-1]):
        for a, b in edges.tolist():
            if not y[b]:
                y[b] = y[a]
    return y


def train(on: np.ndarray, of: np.ndarray, y: np.ndarray, edges: list[np.ndarray], steps: int = 150, rate: float = 0.5, decay: float = 1e-3):
    """(unary weights, [weights of each kind of edge]) by pseudo-likelihood with Adam; edge weights are symmetric."""
    if not len(y):
        return None
    rng = np.random.default_rng(3)
    x = np.zeros((len(y), WIDTH), np.float32)
    x[of, on] = 1
    x[:, 1:SHAPE][rng.random((len(x), SHAPE - 1)) < 1 / 3] = 0
    one = np.eye(K, dtype=np.float32)[y]
    around = []
    for e in edges:
        s = np.zeros((len(x), K), np.float32)
        np.add.at(s, e[:, 0], one[e[:, 1]])
        np.add.at(s, e[:, 1], one[e[:, 0]])
        around.append(s)
    z = np.concatenate([x, *around], axis=1)
    w = np.zeros((z.shape[1], K))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = z @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = z.T @ (p - one) / len(z) + decay * w
        for a in range(WIDTH, len(w), K):
            g[a : a + K] = (g[a : a + K] + g[a : a + K].T) / 2
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:WIDTH], [w[a : a + K] for a in range(WIDTH, len(w), K)]


def scores(on: np.ndarray, of: np.ndarray, n: int, unary: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    s = np.zeros((n, K))
    for a in range(0, len(on), step):
        np.add.at(s, of[a : a + step], unary[on[a : a + step]])
    return s


def marginals(s: np.ndarray, edges: list[np.ndarray], weights: list[np.ndarray], observed: np.ndarray, rounds: int = 12, damp: float = 0.3) -> np.ndarray:
    """Loopy sum-product over a whole graph at once; ``observed`` labels over 0 are given."""
    s = np.where((observed > 0)[:, None], np.where(np.arange(K) == observed[:, None], 0.0, -30.0), s)
    s -= s.max(axis=1, keepdims=True)
    all_edges = np.concatenate(edges)
    m = len(all_edges)
    if not m:
        p = np.exp(s)
        return p / p.sum(axis=1, keepdims=True)
    a, b = np.concatenate([all_edges, all_edges[:, ::-1]]).T
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    kind = np.tile(np.repeat(np.arange(len(edges)), [len(e) for e in edges]), 2)
    potentials = [np.exp(w - w.max()) for w in weights]
    message = np.zeros((2 * m, K))

    def inbound() -> np.ndarray:
        total = s.copy()
        for k in range(K):
            total[:, k] += np.bincount(b, message[:, k], len(s))
        return total

    for _ in range(rounds):
        out = inbound()[a] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        for k, potential in enumerate(potentials):
            of = kind == k
            out[of] = out[of] @ potential
        new = np.log(np.maximum(out, 1e-30))
        new -= new.max(axis=1, keepdims=True)
        message = damp * message + (1 - damp) * new
    total = inbound()
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(g: Graph, model) -> list[tuple[int, int, int, int]]:
    """(document, start, kind, end) of the spans that the field adds."""
    on, of, observed, edges = g.arrays()
    if not len(edges[1]) + len(edges[2]):
        return []
    unary, weights = model
    p = marginals(scores(on, of, len(observed), unary), edges, weights, observed)
    best = np.where(observed > 0, observed, p.argmax(axis=1))
    backed = np.zeros(len(best), bool)
    for e in edges[1:]:
        backed[e[best[e[:, 0]] == best[e[:, 1]]].ravel()] = True
    chosen = np.flatnonzero((observed == 0) & (best > 0) & (p.max(axis=1) >= SURE) & backed)
    return [(*g.where[k][:2], int(best[k]) - 1, g.where[k][2]) for k in chosen.tolist()]


def all_spans(texts: list[str], model) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    bases = [base_spans(t) if t else [] for t in texts]
    added: list[list] = [[] for _ in texts]
    if model is not None:
        g = Graph()
        for d, text in enumerate(texts):
            if text:
                g.add(d, text, bases[d])
            if len(g.where) >= NODES or d + 1 == len(texts):
                for k, start, kind, end in added_spans(g, model):
                    added[k].append((start, kind, end))
                g = Graph()
    return list(zip(bases, added, strict=True))


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def training_texts(docs: DataFrame, *, text_col: str = "text", sample: int = TRAIN_DOCS) -> DataFrame:
    """h, t: about ``sample`` different texts with digits or an @, 2 * ``sample`` at most, by a hash of the text."""
    texts = docs.select(F.xxhash64(F.lit(11), text_col).alias("h"), F.col(text_col).alias("t")).where(F.col(text_col).rlike("[0-9@]"))
    share = min(1.0, sample / max(1, texts.count()))
    low = texts.where(F.pmod("h", F.lit(STEPS)) < math.ceil(share * STEPS))
    # Copies of a text have its hash: they count as one, and a text that fills a third of the table travels once a task.
    return low.groupBy("h").agg(F.any_value("t").alias("t")).orderBy("h").limit(2 * sample)


def learn(docs: DataFrame, *, text_col: str = "text", sample: int = TRAIN_DOCS):
    """The model; what comes to the driver has ``TRAIN_NODES`` candidate tokens a text at most."""
    arrow_batches(docs.sparkSession, 500)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = Graph()
                g.add(0, t, base_spans(t), every=True)
                if 0 < len(g.where) <= TRAIN_NODES:
                    on, of, y, edges = g.arrays()
                    y = shared_labels(shared_labels(y, edges[1]), edges[2])
                    packed = [x.astype("<i2").tobytes() for x in (on, of, y, *edges)]
                    yield pa.RecordBatch.from_pydict({"h": pa.array([h], pa.int64()), **{f"c{k}": pa.array([x], pa.binary()) for k, x in enumerate(packed)}})

    columns = ", ".join(f"c{k} binary" for k in range(6))
    got = sorted(training_texts(docs, text_col=text_col, sample=sample).mapInArrow(run, f"h long, {columns}").collect(), key=lambda r: r["h"])
    parts, at = [[np.zeros(0, np.int64)] for _ in range(6)], 0
    for r in got:
        found = [np.frombuffer(r[f"c{k}"], "<i2").astype(np.int64) for k in range(6)]
        for k, x in enumerate(found):
            parts[k].append(x + at if k not in (0, 2) else x)
        at += len(found[2])
    on, of, y, *edges = [np.concatenate(x) for x in parts]
    return train(on, of, y, [e.reshape(-1, 2) for e in edges])


def find_private(docs: DataFrame, model=None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, n_added, and has_pii (there is any span); no shuffle."""
    arrow_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model if model is not None else learn(docs, text_col=text_col))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = all_spans([t or "" for t in b.column(1).to_pylist()], shared.value)
            columns = {"doc_id": b.column(0)}
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(show(base).encode()).hexdigest() for base, _ in found], pa.string())
            columns["spans"] = pa.array([show(base + more) for base, more in found], pa.string())
            columns["n_added"] = pa.array([len(more) for _, more in found], pa.int64())
            columns["has_pii"] = pa.array([bool(base or more) for base, more in found], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, has_pii boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op3_skip_chain_pii(spark, sf_dir: str) -> DataFrame:
    return find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
