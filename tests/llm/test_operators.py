"""Each operator against brute force, an exact round trip, SQL or held-out labels; then the odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanlake.llm import decontam, dedup, embeddings, lines, mixing, pii, quality, tokenfile, toxicity, warc
from tests.llm.test_align import table as slow_distance

WORDS = [f"w{k}" for k in range(400)]
#: Columns whose names operators use themselves.
CLASH = ["id", "key", "n", "block", "unit", "bucket", "label", "h", "size", "u", "p", "q", "score", "payload", "digest", "row"]


def odd_docs(spark, rows):
    """rows (doc_id, text, source) with more columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASH})


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(rng):
    long = prose(rng, 20_000)
    return [(1, None, "a"), (2, "", None), (3, "hi", "b"), (4, "hi", "b"), (4, "hi", "b"), (None, "no id here at all", None), (5, long, "a"), (6, prose(rng, 60), None), (7, "  \n\n \n", "c")]


def components(nodes, links):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


# 1. Near-dedup.


def test_near_classes(spark):
    rng, rows = random.Random(2), []
    for k in range(40):
        base = prose(rng, rng.randrange(30, 90)).split()
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.03, 0.08, 0.3]))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w), "s"))
    texts = {i: [WORDS.index(x) for x in t.split()] for i, t, _ in rows}
    close = lambda a, b: abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and slow_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    pairs = [(a, b) for a in texts for b in texts if a < b and len({*texts[a]} & {*texts[b]}) > 10 and close(texts[a], texts[b])]
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_classes(odd_docs(spark, rows)).collect()}
    want = components(texts, pairs)
    assert all(want[a] == want[c] for a, c in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)


def test_near_classes_of_odd_rows(spark):
    docs = odd_docs(spark, odd_rows(random.Random(1)))
    got = sorted(((r["doc_id"], r["class_id"]) for r in dedup.near_classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (5, 5), (6, 6), (7, 7), (None, None)], key=str)
    kept = dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def changed(rng, words, share, evenly=False):
    """A sequence with a share of its words replaced by new ones."""
    w, edits = words.copy(), int(len(words) * share + 1e-9)
    at = np.arange(edits) * len(w) // edits if evenly else rng.choice(len(w), edits, replace=False)
    w[at] = rng.integers(1 << 33, 1 << 40, edits).astype(np.uint64)
    return w


def shared_bucket(a, b):
    return len(np.intersect1d(dedup.buckets(a), dedup.buckets(b))) > 0


def test_short_texts_with_edits_always_meet():
    rng = np.random.default_rng(4)
    for n in range(5, dedup.SHORT + 1):
        for _ in range(40):
            a, edits = rng.integers(1, 1 << 32, n).astype(np.uint64), n // 5
            b = a.tolist()
            for k in range(edits):
                p, kind = int(rng.integers(len(b))), rng.integers(3)
                b[p : p + (kind != 1)] = [] if kind == 2 and len(b) > n - edits else [(1 << 33) + k]
            b = np.array(b, np.uint64)
            if len(b) > dedup.SHORT or len(a) == len(b) and (a == b).all() or edits > max(len(a), len(b)) // 5:
                continue
            assert shared_bucket(a, b), (n, b)


@pytest.mark.parametrize("n", [41, 50, 100, 300])
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(n)
    pairs = [(a, changed(rng, a, 0.2)) for a in rng.integers(1, 1 << 32, (400, n)).astype(np.uint64)]
    assert np.mean([shared_bucket(a, b) for a, b in pairs]) >= 0.97


def test_near_classes_of_short_texts(spark):
    base = [f"x{k}" for k in range(10)]
    rows = [(1, " ".join(base), "s"), (2, " ".join([*base[:5], "new", *base[6:]]), "s"), (3, "a b c d e f", "s"), (4, "a b c z e f", "s"), (5, "p q r s t", "s"), (6, "p q z s y", "s")]
    got = {r["doc_id"]: r["class_id"] for r in dedup.near_classes(odd_docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


# 2. Token files.


def test_tokens_round_trip(spark):
    rng = random.Random(3)
    rows = [*odd_rows(rng), *[(100 + k, "".join(rng.choice(["a", " ", "\n", "  ", "é", "1", "'s", "\0", "<|endoftext|>", "Foo", "\t", "😀", "!"]) for _ in range(rng.randrange(15))), "s") for k in range(300)]]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in tokenfile.encode_documents(odd_docs(spark, rows)).collect()), key=lambda r: r[1])
    assert got == want


def test_shards_tell_all_by_themselves(spark):
    from spanlake.llm.common import new_dir

    # A third of the rows has one id, and equal rows are many.
    rng = random.Random(12)
    rows = [(5, "same again") for _ in range(600)] + [(None, None)] * 40 + [(k, prose(rng, 3)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = new_dir(spark, "token-test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = tokenfile.write_shards(docs, folder, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [sum(b["docs"] for b in tokenfile.read_footer(r["path"])) for r in shards.collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * len(rows) and sum(sizes) == len(rows)
    got = sorted((tuple(r) for r in tokenfile.read_shards(shards).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    ids = [r[0] for r in got]
    assert ids[:40] == [None] * 40 and ids[40:] == sorted(ids[40:]) and len(ids) == len(rows)


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10), (1000, 10**9), (70, 10**6)):
        v = np.sort(rng.integers(0, top, n))
        e, _ = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(v).to_bytes())
        assert e.decode().tolist() == v.tolist() == [e.select(i) for i in range(n)]
    size = len(tokenfile.EliasFano.encode(np.arange(0, 10**6, 100)).to_bytes())
    assert size < 10_000 * 1.5 + 1000  # under 12 bits for each of 10,000


# 3. Personal data.

EMAIL, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits(m[0])))) % 10 == 0]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(5)
    for _ in range(6000):
        t = "".join(rng.choice(["1", "42", "255", ".", ".", "@", "a", "b-", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "x@y.zz", "é", "10.0.0.1", "+49 30 123456"]) for _ in range(rng.randrange(16)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_repeats_of_an_entity_are_found(spark):
    rng, rows = random.Random(6), []
    for k in range(300):
        phone = "".join(rng.choice("123456789") for _ in range(10))
        # With and without its plus; other numbers of ten digits are no entities.
        rows.append((k, f"call +{phone} today or later {phone} again, order {rng.randrange(10**9, 10**10)} is sent", "s"))
    got = {r["doc_id"]: r for r in pii.find_private(odd_docs(spark, rows)).collect()}
    added = sum(r["n_added"] for r in got.values())
    right = 0
    for k, t, _ in rows:
        base = plain_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(pii.show(base).encode()).hexdigest() and set(pii.show(base).split(",")) <= set(got[k]["spans"].split(","))
        again = t.index("later ") + 6
        right += f"phone:{again}:{again + 10}" in got[k]["spans"]
    assert right >= 0.9 * len(rows) and added <= 1.1 * right


def test_private_data_of_odd_rows(spark):
    got = pii.find_private(odd_docs(spark, odd_rows(random.Random(1)))).collect()
    assert len(got) == 9 and all(r["spans"] == "" and not r["has_pii"] for r in got)


def test_similar_tokens_back_each_other_without_a_base_span():
    unary, no = np.zeros((pii.WIDTH, pii.K)), np.zeros((pii.K, pii.K))
    unary[0, 4] = 5
    text = "call 5551234567 now, I said 5551234567"
    (base, added), (held, same), (_, none) = pii.all_spans([text, text + " or a@b.cc", "call 5551234567 now"], (unary, [no] * 3))
    assert not base and held and added == same and len(added) == 2 and not none


def test_broken_forms_of_an_entity_are_found(spark):
    """Held-out planted documents: an entity in a form that a pattern takes, and again in one that none takes."""
    rng = random.Random(16)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))

    def made(k):
        user, host, phone, order = f"{name()}.{name()}", name(), "".join(rng.choice("123456789") for _ in range(11)), rng.randrange(10**9, 10**10)
        return [
            (f"write to {user}@{host}.org soon. Order {order} went out, reply to {user}@{host} please", f"{user}@{host} please", f"{user}@{host}", 0),
            (f"call +{phone} or ask. Ticket {order} is open; the line {phone} is free", f"{phone} is", phone, 3),
        ][k % 2]

    plans = [made(k) for k in range(400)]
    got = {r["doc_id"]: r for r in pii.find_private(odd_docs(spark, [(k, p[0], "s") for k, p in enumerate(plans)])).collect()}
    right, added = 0, sum(r["n_added"] for r in got.values())
    for k, (text, tail, form, kind) in enumerate(plans):
        start = text.rindex(tail)
        right += f"{pii.KINDS[kind]}:{start}:{start + len(form)}" in got[k]["spans"].split(",")
    assert right >= 0.9 * len(plans) and right >= 0.95 * added, (right, added)


def brute_marginals(s, edges, weights, observed):
    """By the sum over all labellings."""
    n, total = len(s), np.zeros_like(s)
    for y in itertools.product(range(pii.K), repeat=n):
        if any(o and y[k] != o for k, o in enumerate(observed)):
            continue
        p = np.exp(sum(s[k, y[k]] for k in range(n)) + sum(w[y[a], y[b]] for e, w in zip(edges, weights, strict=True) for a, b in e))
        for k in range(n):
            total[k, y[k]] += p
    return total / total.sum(axis=1, keepdims=True)


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(5)
    none = np.zeros((0, 2), np.int64)
    for trial in range(12):
        s, weights = rng.normal(size=(5, pii.K)), [(w + w.T) / 2 for w in rng.normal(size=(3, pii.K, pii.K))]
        observed = np.array([0, 0, int(rng.integers(0, pii.K)), 0, 0])
        tree = [np.array([[0, 1], [1, 2]]), np.array([[1, 3]]), np.array([[2, 4]])]
        assert np.allclose(pii.marginals(s, tree, weights, observed, rounds=60), brute_marginals(s, tree, weights, observed), atol=1e-6)
        # With a loop the messages are an approximation.
        loop = [np.array([[0, 1], [1, 2], [2, 3]]), np.array([[0, 3]]), none if trial % 2 else np.array([[0, 4]])]
        weak = [0.5 * w for w in weights]
        assert np.abs(pii.marginals(s, loop, weak, observed, rounds=60) - brute_marginals(s, loop, weak, observed)).max() < 0.1


def test_long_texts_full_of_numbers_stay_linear():
    text = " ".join(f"{k * 7919 % 10**8:08d}" for k in range(30_000)) + " +49 30 1234567 x 49301234567"
    g = pii.Graph()
    g.add(0, text, pii.base_spans(text))
    assert len(g.where) <= 30_010 and sum(len(e) for e in g.edges) <= len(g.where) * (1 + 2 * pii.FAN)


def test_the_training_sample_is_there_at_any_size(spark):
    docs = spark.createDataFrame([("a 1",)] * 50 + [(f"b {k}",) for k in range(50)] + [(None,), ("none",)], "text string")
    got = [r["t"] for r in pii.training_texts(docs, sample=1000).collect()]
    assert sorted(got) == sorted({"a 1", *(f"b {k}" for k in range(50))})
    assert math.ceil(2000 / 1e15 * pii.STEPS) > 1000
    assert pii.find_private(docs.select(F.lit(1).alias("doc_id"), "text").limit(0)).count() == 0


# 4. Decontamination.


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.randrange(8, 30))) for k in range(25)] + [(98, None), (99, "")]
    rows, planted, clean = [], set(), set()
    for k in range(150):
        w, item = prose(rng, 80).split(), items[rng.randrange(25)]
        part, edits = item[1].split(), rng.choice([0, 0.1, 0.2, None])
        if edits is not None:
            for _ in range(int(len(part) * edits)):
                p, kind = rng.randrange(len(part)), rng.randrange(3)
                part[p : p + (kind != 1)] = [] if kind == 2 else ["zz"]
            w[40:40] = part
            planted.add((k, item[0]))
        else:
            clean.add(k)
        rows.append((k, " ".join(w), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (None, items[3][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_docs(spark, rows)
    found = decontam.find_leaks(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(planted - got) <= 0.02 * len(planted) and (None, 3) in got and not {d for d, _ in got} & clean
    text = dict((i, t) for i, t, _ in rows)
    for r in found:
        part = text[r["doc_id"]].split()[r["start_word"] : r["start_word"] + r["n_words"]]
        item = items[r["item_id"]][1].split()
        assert slow_distance(part, item) == r["edits"] <= len(item) // 5
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, *_ in rows} - {d for d, _ in got}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 == decontam.find_leaks(docs.limit(0), bench).count()


def least_edits(item, text):
    """The edit distance of ``item`` to the nearest part of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_are_those_of_all_pairs():
    rng = random.Random(31)
    common = WORDS[:12]  # words that stand everywhere
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(WORDS)
    items = [[word() for _ in range(n)] for n in (1, 2, 4, 5, 7, 9, 11, 14, 19, 20, 21, 24, 30, 33, 40, 59, 90)]
    docs = []
    for k in range(170):
        w, item = [word() for _ in range(rng.randrange(150))], items[k % len(items)]
        part = list(item)
        for _ in range(rng.randrange(len(item) // 5 + 2)):
            p, kind = rng.randrange(len(part) or 1), rng.randrange(3)
            part[p : p + (kind != 1)] = [] if kind == 2 else [word()]
        at = rng.choice([0, len(w), rng.randrange(len(w) + 1)])
        docs.append(w[:at] + part + w[at:])
    index = decontam.Items(list(range(len(items))), [" ".join(i) for i in items])
    got = decontam.leaks([" ".join(d) for d in docs], index, decontam.WordHashes())
    want = {(d, i): e for d, text in enumerate(docs) for i, item in enumerate(items) if (e := least_edits(item, text)) <= len(item) // 5 and len(text) >= len(item) - e}
    assert set((d, i) for d, i, *_ in got) <= set(want) and all(e == want[d, i] for d, i, _, _, e in got)
    short = {(d, i) for d, i in want if len(items[i]) < decontam.SHORT}
    assert short <= {(d, i) for d, i, *_ in got}  # found by an exact way
    assert len(got) >= 0.98 * len(want) and len(want) > 200
    for d, i, start, size, e in got:
        assert slow_distance(docs[d][start : start + size], items[i]) == e


@pytest.mark.parametrize("n", [20, 26, 40, 80, 300])
def test_recall_of_windows_at_the_edit_limit(n):
    rng = np.random.default_rng(n)
    word = lambda k: [f"v{x}" for x in rng.integers(1, 1 << 40, k)]
    items = [word(n) for _ in range(150)]
    index, docs = decontam.Items(list(range(150)), [" ".join(w) for w in items]), []
    for w in items:
        part = list(w)
        for p in rng.choice(n, n // 5, replace=False).tolist():
            part[p] = "zz"
        docs.append(" ".join([*word(30), *part, *word(30)]))
    found = {(d, i) for d, i, *_ in decontam.leaks(docs, index, decontam.WordHashes())}
    assert sum((k, k) in found for k in range(150)) >= 0.98 * 150 and min(index.recall.values()) >= decontam.RECALL


def test_short_first_items_do_not_set_the_search_for_long_ones():
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(1, 1 << 40, n)]
    long = [word(300) for _ in range(12)]
    texts = [" ".join(word(4)) for _ in range(200)] + [" ".join(w) for w in long]
    items, docs = decontam.Items(list(range(len(texts))), texts), []
    for w in long:
        w = list(w)
        for p in rng.choice(300, 60, replace=False).tolist():
            w[p] = "zz"
        docs.append(" ".join(w))
    found = {(d, items.ids[i]) for d, i, *_ in decontam.leaks(docs, items, decontam.WordHashes())}
    assert found == {(k, 200 + k) for k in range(12)}


def test_a_benchmark_beyond_one_part_takes_several_passes(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, prose(rng, 25)) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_docs(spark, [(k, f"{prose(rng, 9)} {items[k][1]} {prose(rng, 9)}", "s") for k in range(0, 30, 2)] + [(99, prose(rng, 60), "s")])
    monkeypatch.setattr(decontam, "PART_BYTES", 800)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()} == {(k, k) for k in range(0, 30, 2)}
    assert [r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()] == [99]


# 5. Lines, 6. WARC, 9. Mixing: SQL.


@pytest.mark.parametrize(("name", "sql", "source"), [("op5_line_windows", lines.SQL, "documents"), ("op6_warc_bundles", warc.SQL, "pages"), ("op9_pareto_mixing", mixing.SQL, "documents")])
def test_sql(spark, sf_dir, name, sql, source):
    from spanlake.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM read_parquet('{sf_dir}/{source}.parquet')")
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    df = QUERIES[name](spark, sf_dir)
    want = sorted(str([dict(zip([d[0] for d in cur.description], r, strict=True))[c] for c in names]) for r in cur.fetchall())
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == want


def test_lines_of_odd_rows(spark):
    rows = [*odd_rows(random.Random(1)), (20, "a\nb\nc\nd", "s"), (21, "x\na\nb\nc\nd\ny", "s"), (22, "b\nc\nd", "s"), (23, "p\nq\np\nq\np\nq", "s")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup_lines(odd_docs(spark, rows)).collect()}
    assert got[20] == (4, 0, "a\nb\nc\nd") and got[21] == (6, 4, "x\ny") and got[22] == (3, 3, "") and got[23] == (6, 4, "p\nq") and got[1] == (0, 0, None) and got[2] == (1, 0, "")


def test_bundles(spark):
    big = "é" * 600
    rows = [(1, "http://a b\r\n", big), (2, None, big), (3, "u", None), (4, "u", "x"), (5, "u", "x"), (None, "u", big), (9, "u", big), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})
    from spanlake.llm.common import new_dir

    folder = new_dir(spark, "warc-test")
    manifest = warc.write_bundles(warc.mark_revisits(pages), folder)
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(manifest).collect()}
    assert got == {(1, 1200, "revisit", 9), (2, 1200, "revisit", 9), (3, 0, "response", None), (4, 1, "response", None), (5, 1, "response", None), (None, 1200, "revisit", 9), (9, 1200, "response", None)}
    hits = [h for r in manifest.collect() for h in warc.lookup(r["path"], 4)]
    assert len(hits) == 1 and hits[0][1] == b"x" and hits[0][0]["WARC-Type"] == "response"
    assert warc.archive(pages.limit(0)).count() == 0


def test_mixing_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [*odd_rows(rng), *[(100 + k, prose(rng, rng.randrange(1, 200)), rng.choice("abcd")) for k in range(400)]]
    docs = odd_docs(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["target"], r["source_size"]), []).append(r)
    for (target, source_size), rs in by.items():
        # A source comes nearer to its target than its largest document is long.
        assert target <= 3 * source_size + 1e-6 and abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


# 7. Toxicity, 8. Quality.


@pytest.mark.parametrize(("module", "label", "folds", "held", "least"), [(toxicity, "toxic", 5, 0, 0.9), (quality, "quality", 3, 1, 0.9)])
def test_held_out_accuracy(spark, module, label, folds, held, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = module.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % folds == held for r in got)
    assert np.mean([r["predicted"] == r[label] for r in got]) >= least
    # Held-out labels change nothing.
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    other = labels.withColumn(label, F.when(crc == held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r["doc_id"]: r["score"] for r in module.classify(docs.limit(50), x).collect()} for x in (labels, other))
    assert a == b


def test_training_is_plain_ftrl(spark):
    rng, texts, ys = random.Random(21), [], []
    for k in range(160):
        ys.append(k % 3 == 0)
        texts.append(" ".join(rng.choice(WORDS[:40] if ys[-1] else WORDS[30:90]) for _ in range(rng.randrange(1, 30))))
    sample = spark.createDataFrame([(1000 - k, t, int(y)) for k, (t, y) in enumerate(zip(texts, ys, strict=True))], "key long, text string, label int")
    at, w, bias = toxicity.learn(sample, epochs=3)
    a, beta, l1, l2 = 0.3, 1.0, 6.0, 1.0
    z, n = {}, {}

    def weight(i):
        if i == "bias":
            return -z.get(i, 0.0) / ((beta + n.get(i, 0.0) ** 0.5) / a)
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + n[i] ** 0.5) / a + l2)

    for _ in range(3):
        for t, y in list(zip(texts, ys, strict=True))[::-1]:
            on = {*toxicity.grams([t], toxicity.Stems())[0].tolist(), "bias"}
            now = {i: weight(i) for i in on}
            g = 1 / (1 + math.exp(-sum(now.values()))) - y
            for i in on:
                step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / a
                z[i], n[i] = z.get(i, 0.0) + g - step * now[i], n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want, rel=1e-9) and len(want) > 3 and bias == pytest.approx(weight("bias"))


def test_votes_are_those_of_the_exact_neighbours():
    rng = np.random.default_rng(9)
    n, dims = 90, quality.WORDS + quality.SHAPES
    x = np.zeros((n, dims), np.float32)
    x[:, :40] = rng.integers(0, 3, (n, 40))
    y = rng.integers(0, 2, n)
    model = quality.fit(x.copy(), y, dims=12)
    asked = np.concatenate([x[:5], np.zeros((1, dims), np.float32), rng.integers(0, 2, (30, dims)).astype(np.float32)])
    got = quality.vote(asked, model, neighbours=7)
    w, v, known, _, share = model
    for row, score in zip(asked, got, strict=True):
        z = (row * w) / max(np.linalg.norm(row * w), 1e-30) @ v
        if not np.linalg.norm(z):
            assert score == share
            continue
        cos = [float(np.dot(z / np.linalg.norm(z), k)) for k in known]
        best = sorted(range(n), key=lambda i: (-cos[i], i))[:7]
        weights = [max(cos[i], 0) ** quality.POWER for i in best]
        assert score == pytest.approx(sum(a * y[i] for a, i in zip(weights, best, strict=True)) / sum(weights), abs=1e-3)


def test_of_equal_neighbours_the_first_count():
    cos = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2], [0.1, 0.2, 0.3, 0.4, 0.5]], np.float32)
    assert quality.nearest(cos, 2).tolist() == [[0, 1], [0, 1], [3, 4]] and quality.nearest(cos, 9).shape == (3, 5)


def test_repeated_ids_do_not_swell_the_sample(spark):
    from spanlake.llm.labelled import training_sample

    docs = spark.createDataFrame([(1, f"t{k}") for k in range(30)] + [(2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = [tuple(r)[1:] for r in training_sample(docs, labels, "toxic", 7, 6, 10).collect()]
    assert sorted(got) == [("", 1), ("t0", 1)]


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_of_odd_rows(spark, module, label):
    docs = odd_docs(spark, odd_rows(random.Random(1)))
    some = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1), (6, 1)], f"doc_id long, {label} int")
    for labels in (some, some.limit(0)):
        got = module.classify(docs, labels).collect()
        assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert module.classify(docs.limit(0), some).count() == 0


def test_rejected_documents_go(spark):
    docs = odd_docs(spark, odd_rows(random.Random(1)))
    assert quality.keep_good(docs, spark.createDataFrame([(6, 1)], "doc_id long, quality int")).columns == docs.columns


# 10. Embeddings.


def test_near_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    dim = len(rows[0][1])
    extra = [(9001, None), (9002, [0.0] * dim), (9003, [float("nan")] * dim), (9004, [None] * dim), (9005, []), (9006, rows[0][1]), (9006, rows[0][1]), (9007, [float(x) * 1e30 for x in rows[0][1]])]
    all_rows = rows + [(i, v) for i, v in extra]
    vectors = spark.createDataFrame(all_rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASH})
    got = [tuple(r) for r in embeddings.near_vectors(vectors).collect()]
    good = [k for k, (_, v) in enumerate(all_rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([all_rows[k][1] for k in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= 0.95, 1)
    ids = [all_rows[k][0] for k in good]
    links = dict.fromkeys([i for i, _ in all_rows], 0)
    for a, b in zip(*np.nonzero(near), strict=True):
        links[ids[a]] += 1
        links[ids[b]] += 1
    links[9006] //= 2
    found = {i: n for i, n, *_ in got}
    assert len(got) == len(all_rows) and all(found[i] <= links[i] for i in links)
    assert sum(found.values()) >= 0.95 * sum(links.values())
    want = components(links, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if ids[a] != ids[b]])
    assert all(want[c] == want[i] for i, _, c, _ in got) and all(kept == (c == i) for i, _, c, kept in got)
    assert {i: c for i, _, c, _ in got if i in (9001, 9002, 9003, 9004, 9005)} == {i: i for i in (9001, 9002, 9003, 9004, 9005)}
    assert embeddings.near_vectors(vectors.limit(0)).count() == 0


def test_recall_at_the_threshold_with_many_hashes(spark):
    rng, rows = np.random.default_rng(8), []
    for k in range(100):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        rows += [(2 * k, x.tolist()), (2 * k + 1, (0.9501 * x + np.sqrt(1 - 0.9501**2) * z / np.linalg.norm(z)).tolist())]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), hashes=5).collect()
    assert sum(r["n_links"] for r in got) >= 0.98 * 200


# The pipeline.


def test_pipeline_against_brute_force(spark, tmp_path):
    """Planted junk, copies, near copies and leaks; what each stage should keep is worked out in plain Python or SQL."""
    rng, rows, labels = random.Random(41), [], []
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    clean = lambda: " ".join(sentence(rng.randrange(6, 12)) for _ in range(rng.randrange(3, 9)))
    junk = lambda: " ".join(rng.choice(["!!!!!", "$$$", "CLICK", "HERE", "0000", "xXx", ">>>", "WIN"]) for _ in range(rng.randrange(20, 60)))
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([9, 16, 24, 31])))) for k in range(8)]
    for k in range(420):
        bad = k % 3 == 0
        text = junk() if bad else clean()
        if not bad and k % 7 == 1:
            text = rng.choice([t for _, t, _, b in rows if not b] or [text])
            w = text.split()
            for _ in range(rng.randrange(len(w) // 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif not bad and k % 11 == 4:
            text = f"{text} {items[k % 8][1]} {sentence(5)}"
        rows.append((k, text, rng.choice(["a", "b", None]), bad))
        if k % 2:
            labels.append((k, 1 - bad, 0))
    one = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    one("documents", [(k, t, "en", s, len(t)) for k, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one("labels", labels, "doc_id long, quality int, toxic int")
    one("benchmark", items, "item_id long, text string")
    # 1. No junk.
    left = {k: (t, s) for k, t, s, bad in rows if not bad}
    # 2. The least id of each component of texts within a fifth of edits.
    word = {w: n for n, w in enumerate(sorted({x for t, _ in left.values() for x in re.findall(r"\w+", t.lower())} | {x for _, t in items for x in t.split()}))}
    split = {k: [word[x] for x in re.findall(r"\w+", t.lower())] for k, (t, _) in left.items()}
    close = lambda a, b: len(set(a) & set(b)) > 5 and abs(len(a) - len(b)) <= max(len(a), len(b)) // 5 and slow_distance(a, b) <= max(len(a), len(b)) // 5
    ids = sorted(left)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if close(split[a], split[b])]
    assert len(links) > 20
    first = components(ids, links)
    # 3. No text with a part within a fifth of edits of an item.
    asked = [[word[x] for x in t.split()] for _, t in items]
    kept = [k for k in ids if first[k] == k and all(least_edits(i, split[k]) > len(i) // 5 for i in asked)]
    assert len(kept) < sum(first[k] == k for k in ids)
    # 4. The mixture by SQL, 5. its ids by the library.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, ?)", [(k, left[k][0], left[k][1], len(left[k][0])) for k in kept])
    cur = con.execute(mixing.SQL)
    at = {d[0]: n for n, d in enumerate(cur.description)}
    copies = {r[at["doc_id"]]: r[at["taken"]] // r[at["size"]] for r in cur.fetchall()}
    tok, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for k in sorted(copies):
        got = np.array([*tok.encode(left[k][0], add_special_tokens=False).ids, 0], "<u4")
        for _ in range(int(copies[k])):
            want.append((k, start, len(got), zlib.crc32(got.tobytes())))
            start += len(got)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()) == sorted(want)


def test_stages_give_the_columns_of_documents(spark, sf_dir):
    from spanlake.llm.common import clear

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.table(stage(spark, kept, sf_dir), "test")
        assert kept.columns == docs.columns
    assert 0 < kept.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert clear(spark) > 0 and clear(spark) == 0
