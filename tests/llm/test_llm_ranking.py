"""Search, nearest vectors and hard negatives against brute force and SQL."""

import math
import os
import random
import re
from collections import Counter

import pytest
from compare import connect, differences

from chronopanel.llm import catalog, nearest, negatives, search
from chronopanel.llm.shared import importable
from chronopanel.llm.vectors import best, block_rows, products

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RANKINGS = ["op11_ranked_search", "op12_nearest_vectors", "op13_hard_negatives"]


@pytest.mark.parametrize("name", RANKINGS)
def test_against_sql(spark, name):
    if not os.path.exists(FOLDER):
        pytest.skip("test tables not present")
    assert differences(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.SQL[name]) == ""


def plain_rank(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    counts = [Counter(terms(t)) for _, t in docs]
    n, whole = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df, out = Counter(w for c in counts for w in c), []
    for item, text in items:
        scores = []
        for (key, _), c in zip(docs, counts):
            score = 0
            for w in terms(text):
                if c[w]:
                    m = 100 - 25 + 25 * sum(c.values()) * n // whole
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def documents(rng, n):
    words = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "naïve", "語彙", "a1b2", "😀x"]
    rows = [(k, " ".join(rng.choices(words, weights=[1 + 400 // (i + 1) for i in range(len(words))], k=rng.randint(1, 40)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "--- ,.; \t\n"), (3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]),
             (n + 3, "W0,w0;W1\x00w2" + " w3"), (n + 4, "w0 w39 über " * 3000)]
    rows += [(n + 10 + i, rows[5][1]) for i in range(n // 3)]  # one text in a third of all rows
    return rows


@pytest.mark.parametrize("stages, most_docs, most_bytes, bundle", [(4, 8192, 8 << 20, 256), (3, 7, 1 << 20, 2), (1, 50, 300, 256), (6, 11, 1 << 20, 3)])
def test_rank(spark, stages, most_docs, most_bytes, bundle):
    importable(spark)
    rng = random.Random(stages)
    docs = documents(rng, 120)
    items = [(i, docs[rng.randrange(100)][1] + " w39") for i in range(6)] + [(6, None), (7, ""), (8, "nowhere"), (1, "w1 w1 W2 語彙"), (None, "w3 über")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, term string, item long").repartition(3)
    asked = spark.createDataFrame([(k, t, "y") for k, t in items], "item_id long, text string, shard string")
    got = search.rank(df, asked, 5, stages=stages, most_docs=most_docs, most_bytes=most_bytes, bundle=bundle)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_rank(docs, items, 5)


def test_rank_of_empty_tables(spark):
    importable(spark)
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert [tuple(r) for r in search.rank(docs, items).collect()] == plain_rank([(1, "a b")], [(1, "a b")], 20)
    assert search.rank(none, items).count() == search.rank(docs, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def vectors(rng, n, dim=6):
    """Clusters, a vector that a third of all rows share, ties, and rows that take no part."""
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(5)]
    rows = [(k, [c + rng.gauss(0, 0.02) for c in rng.choice(centres)], rng.choice([0, 1, 2, 9, None, -3])) for k in range(n)]
    rows += [(n + k, rows[10][1], k % 4) for k in range(n // 2)]
    rows += [(5, rows[5][1], 1), (None, rows[7][1], 2), (None, rows[7][1], 2), (2 * n, [0.0] * dim, 1), (2 * n + 1, [0.0] * dim, 2)]
    return rows + [(3 * n, None, 1), (3 * n + 50, [0.1, None] * 3, 1), (3 * n + 100, [float("nan")] * dim, 0), (4 * n, [float("inf")] * dim, 0),
                   (4 * n + 50, [0.5, -0.5], 1), (4 * n + 100, [0.25, 0.5], 2), (5 * n, [], 1), (5 * n + 50, [], 1)]


def whole(rows):
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(k, [math.floor(256 * x) for x in v], y) for k, v, y in rows if sound(v)]


def scored(rows, i, same):
    """Other rows of the same length by score, key (null last): (-score, null, key)."""
    return sorted((-sum(a * b for a, b in zip(rows[i][1], r[1])), r[0] is None, r[0] or 0)
                  for j, r in enumerate(rows) if j != i and len(r[1]) == len(rows[i][1]) and same(r))


def named(e):
    return None if e[1] else e[2]


@pytest.fixture(params=[None, 7, 40])
def blocks(request, monkeypatch):
    if request.param:
        for module in (nearest, negatives):
            monkeypatch.setattr(module, "block_rows", lambda n, factor: request.param)


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame([(k, v, y, 1, "z") for k, v, y in rows], "vec_id long, embedding array<double>, label int, node int, cell string").repartition(3)


def test_nearest(spark, blocks):
    from pyspark.sql import functions as F

    rows = vectors(random.Random(5), 90)
    own, want = whole(rows), []
    for i, (k, _, _) in enumerate(own):
        if k is not None and k % 5 == 0:
            want += [(k, n + 1, named(e), -e[0]) for n, e in enumerate(scored(own, i, lambda r: True)[:4])]
    for pivots in (3, 64):
        got = nearest.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, 4, pivots=pivots)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_nearest_copies_only_what_a_group_needs(spark, monkeypatch):
    """Two far clusters: hardly a row of one is sent to the queries of the other, and the result is the same."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(k, [(3 if k % 2 else -3) + rng.gauss(0, 0.01), rng.gauss(0, 0.01), 1.0], 0) for k in range(400)]
    sent, solve = spark.sparkContext.accumulator(0), nearest._solve

    def counted(k):
        inner = solve(k)

        def run(asks, data):
            sent.add(data.num_rows if asks.num_rows else 0)
            return inner(asks, data)

        return run

    monkeypatch.setattr(nearest, "_solve", counted)
    monkeypatch.setattr(nearest, "block_rows", lambda n, factor: 20 if factor == 8 else 1000)
    got = nearest.top_k(frame(spark, rows), F.col("vec_id") % 10 < 2, 3, pivots=20).collect()
    own = whole(rows)
    want = [(k, n + 1, named(e), -e[0]) for i, (k, _, _) in enumerate(own) if k % 10 < 2 for n, e in enumerate(scored(own, i, lambda r: True)[:3])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < sent.value < 0.7 * 400 * 4


def plain_mine(rows, k, positives, low, high, anchor):
    own, out = [r for r in whole(rows) if r[2] is not None], []
    for i, (key, _, y) in enumerate(own):
        if not anchor(key):
            continue
        others = scored(own, i, lambda r: r[2] != y)
        for p in scored(own, i, lambda r: r[2] == y)[:positives]:
            inside = [e for e in others if low * -p[0] <= 100 * -e[0] <= high * -p[0]][:k]
            out += [(key, named(p), n + 1, named(e), -p[0], -e[0]) for n, e in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [(80, 100), (0, 100), (95, 120)])
def test_negatives(spark, blocks, window):
    from pyspark.sql import functions as F

    rows = vectors(random.Random(8), 90)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 6 == 0, F.col("label"), 4, 3, window)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_mine(rows, 4, 3, *window, lambda k: k is not None and k % 6 == 0)


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    for rows in ([], [(1, [1.0], 1)], [(0, None, 1)], [(0, [1.0], None)]):
        df = frame(spark, rows)
        assert nearest.top_k(df, F.col("vec_id") == 0).count() == 0
        assert negatives.mine(df, F.col("vec_id") == 0, F.col("label")).count() == 0


def test_blocks_of_products():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (5, 8)), rng.integers(-300, 300, (9, 6))
    assert (products(a, b) == a[:, :6] @ b.T).all()
    big = np.array([[2**27, 3]])
    assert products(big, big)[0, 0] == 2**54 + 9
    with pytest.raises(OverflowError):
        products(big * 4, big)
    found = list(best(np.array([[3, 5, 5, 1]]), 3))
    assert [(int(c[0]), int(s[0])) for _, c, s in found] == [(1, 5), (2, 5), (0, 3)]
    assert block_rows(1, 8) == 64 and block_rows(10**12, 32) == 65_536
    deal = nearest.grouped({0: 5, 1: 30, 2: 4, 3: 9}, np.array([[0.0], [1], [2], [3]]), 10)
    assert deal[1][1] == 3 and len({g for j, (f, n) in deal.items() for g in range(f, f + n)}) == 6
