"""Exact top-k over bit slices, spelling variants and ranked lexical search, against brute force and on edge cases."""

import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.llm import bit_sliced, lexical, spelling
from roadlake.llm.words import words_of

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string"

# ---- exact top-k over a bit-sliced index


def top_rows(rows, is_query, k=5):
    """Brute force: (query_id, rank, vec_id, score)."""
    fine = []
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            fine.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in x)))
    asked = {}
    for i, x in fine:
        if is_query(i):
            asked[i] = min(asked.get(i, x), x)
    out = []
    for i, q in asked.items():
        found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i and len(x) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def asked(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS)
    return sorted(tuple(r) for r in bit_sliced.search(df, F.col("vec_id") % 10 == 0, **kw).collect())


@pytest.mark.parametrize("d", [1, 3, 17])
def test_bit_slices_equal_brute_force(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(c) for c in rng.normal(0, 0.4, d).astype(np.float32)]) for i in range(230)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies: ties at the boundary
    assert asked(spark, rows, block_rows=64, block_queries=8) == top_rows(rows, lambda i: i % 10 == 0)


def test_bit_slices_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.5]), (10, None), (20, [nan, 1.0]), (30, [inf, 0.0]), (40, [None, 0.0]), (50, [0.0, 0.0]), (60, []), (61, []), (70, [1.0]),
        (1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.25, 0.0]), (2, [-0.5, 0.5]), (3, [100.0, -3.5]), (None, [9.0, 9.0]), (80, [0.1, 0.2]), (80, [-0.1, 0.2]),
    ]
    assert asked(spark, rows) == top_rows(rows, lambda i: i % 10 == 0)
    assert asked(spark, [r for r in rows if r[0] and r[0] % 10]) == [] == asked(spark, [])
    extra = spark.createDataFrame([(*r, 1, 2, 3) for r in rows[:9]], VECTORS + ", rank int, q int")
    assert bit_sliced.search(extra, F.col("vec_id") % 10 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_best_rows_from_the_top_slice_down():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.randrange(16) for _ in range(100)]
        slices = np.stack([np.packbits([v >> b & 1 for v in values] + [0] * 28, bitorder="little").view(np.uint64) for b in range(4)])
        rows = np.packbits(np.arange(128) < 100, bitorder="little").view(np.uint64)
        k = rng.randrange(1, 12)
        assert sorted(bit_sliced.best(slices, rows, k)) == sorted(heapq.nsmallest(k, range(100), key=lambda i: (-values[i], i)))


# ---- spelling variants


def thinned_words(docs, every=97, least_length=5, least=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_rows(docs, **kw):
    words = thinned_words(docs, **kw)
    form, near = {}, {}
    for w, n in words.items():
        around = [v for v in words if one_apart(w, v)]
        near[w] = len(around)
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


def variants(spark, docs, **kw):
    df = spelling.variants(spark.createDataFrame(docs, DOCS), **kw)
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("every", [97, 3])
def test_variants_equal_brute_force(spark, every):
    rng = random.Random(every)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(stems[: 1 + int(59 * rng.random() ** 2)]) for _ in range(40)).title()) for i in range(150)]
    assert variants(spark, docs, every=every, bucket_keys=64) == variant_rows(docs, every=every)


def test_variants_edges(spark):
    long = "ab" * 3000
    docs = [(1, None), (2, ""), (None, "kitten kitten kitten mitten"), (3, "mitten mitten, mitten! MITTEN kiten kiten kiten kiten kiten kiten kiten"), (3, "mitten mitten"), (4, "aaaaaa " * 12 + "aaaaab " * 5 + "aaaaa " * 30), (5, f"{long} {long}c {long} {long} {long}c {long}c {long}"), (6, "cafés cafés cafés cafēs €××××× x÷yz÷ab " * 9)]
    assert variants(spark, docs) == variant_rows(docs)
    assert variants(spark, []) == []
    extra = spark.createDataFrame([(1, "hello " * 9, 2, 3, "x")], DOCS + ", word int, n int, root string")
    assert [r.word for r in spelling.variants(extra).collect()] == [r[0] for r in variant_rows([(1, "hello " * 9)])]


def test_a_collision_of_keys_links_nothing(spark, monkeypatch):
    docs = [(1, "alpha alpha alpha gamma gamma gamma gamme gamme gamme delta delta delta")]
    whole = spelling.deletions
    monkeypatch.setattr(spelling, "mix", lambda x, seed=0: np.asarray(x, np.uint64) * np.uint64(0))
    key, own = whole(np.array([[97, 98, 99, 100, 101]], np.uint32))
    assert len(set(key.ravel().tolist()) | set(own.tolist())) == 1  # every key is the same now
    ids = {w: i for i, w in enumerate(sorted(thinned_words(docs)))}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(ids.values(), pa.int64()), pa.array(ids.keys())], names=["id", "word"])
    rows = spelling.shared(pa.Table.from_batches(spelling.keyed(0)(iter([batch]))))
    names = list(ids)
    rows = rows.append_column("word", pa.array([names[i] for i in rows.column("id").to_pylist()])).append_column("n", pa.array([3] * rows.num_rows))
    found = spelling.near(rows).to_pydict()
    assert sorted(zip([names[i] for i in found["id"]], found["form"])) == [("gamma", "gamme"), ("gamme", "gamma")]


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(60)] + [("x", "w000"), ("y", "w060")]
    found = dict(map(tuple, spelling.roots_of(spark.createDataFrame(chain, "word string, root string")).collect()))
    assert found == {w: "w060" for w, _ in chain}


# ---- ranked lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranking(docs, items, k=10):
    """Brute force: (item_id, rank, doc_id, score)."""
    docs = [(i, Counter(terms_of(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms_of(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, size in docs:
            m = 25 + (75 * size * n) // total
            s = sum(times * weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in own.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def searched(spark, docs, items, shard_bytes=2000, **kw):
    index = lexical.index(spark.createDataFrame(docs, DOCS), shard_bytes=shard_bytes)
    return sorted(tuple(r) for r in lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), **kw).collect())


def test_search_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)] + ["Ñandú", "日本", "a1", "ß"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(rng.choice(words[: 1 + int(123 * rng.random() ** 3)]) for _ in range(n))
    docs = [(rng.randrange(10_000) * 200 + i, text(rng.randrange(1, 60))) for i in range(200)]
    docs += [(3_000_000 + i, docs[0][1]) for i in range(15)]  # copies tie
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)]
    want = ranking(docs, items)
    assert searched(spark, docs, items) == want == searched(spark, docs, items, shard_bytes=1 << 25, block_items=3)


def test_search_edges(spark):
    docs = [(1, None), (2, ""), (3, "..., --"), (None, "alpha beta"), (None, "alpha"), (4, "alpha " * 500), (5, "alpha beta"), (5, "alpha beta"), (6, "x" * 50_000 + " gamma"), (7, "delta")]
    items = [(1, "alpha BETA"), (2, None), (3, ""), (4, "unknown"), (None, "alpha"), (5, "alpha"), (5, "beta beta"), (6, "Gamma " + "X" * 50_000)]
    assert searched(spark, docs, items) == ranking(docs, items)
    assert searched(spark, [], items) == [] == searched(spark, docs, [])
    index = lexical.index(spark.createDataFrame([(1, "alpha", "a", 2), (2, "beta", "b", 3)], DOCS + ", term string, shard long"))
    items = spark.createDataFrame([(1, "alpha", 5, 6)], "item_id long, text string, doc_id long, rank int")
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical.search(index, items).collect()] == [(1, 1, 1)]


def test_postings_round_trip():
    values = np.array([0, 1, 127, 128, 300, 1 << 40, (1 << 62) + 5, 7], np.int64)
    data, at = lexical.encode(values)
    assert lexical.decode(data).tolist() == values.tolist() and at[-1] == len(data)
    assert lexical.decode(lexical.encode(values[:0])[0]).tolist() == []


def test_merge_keeps_the_best_over_windows():
    rng = np.random.default_rng(2)
    lists = []
    for _ in range(12):
        places = np.flatnonzero(rng.random(5 * lexical.WINDOW) < rng.random() * 0.05)
        lists.append((places, rng.integers(1, 9, len(places))))
    total = Counter()
    for places, gains in lists:
        for p, g in zip(places.tolist(), gains.tolist()):
            total[p] += g
    assert lexical.merged(lists, 10) == [(s, p) for p, s in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:10]]


def test_words_of_parts():
    texts = ["", "Aa bb", "c" * 100, "é€é x", "", "b b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for size in (1, 3, 50, 1000):
        got = [(d, bytes(b[i:j]).decode()) for doc, b, at in words_of(data, offsets, lexical.terms, size) for d, i, j in zip(doc.tolist(), at[:-1], at[1:])]
        assert got == [(i, w) for i, t in enumerate(texts) for w in terms_of(t)]
