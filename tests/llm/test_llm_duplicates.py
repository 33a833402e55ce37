"""SimHash, line and vector duplicates, and components, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from chronopanel.llm import embeddings, lines, shared, simhash
from chronopanel.llm.shared import importable


class Groups:
    def __init__(self):
        self.up = {}

    def head(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.head(a), self.head(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 80)],
                                   [(random.Random(1).randint(0, 9) + 10 * k, 10 * k + j) for k in range(9) for j in (3, 5)]])
def test_components(spark, edges):
    got = shared.components(spark.createDataFrame(edges + edges[:2] + [(None, 4)], "a long, b long"))
    g = Groups()
    for a, b in edges:
        if a != b:
            g.join(a, b)
    assert sorted((r.node, r.component) for r in got.collect()) == sorted((k, g.head(k)) for k in list(g.up))


# --------------------------------------------------------------------- SimHash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)


def corpus(n=220, seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["ÄÖ", "Éa", "x y"]
    out = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 60, 200]))
        out.append((k, " ".join(words)))
        if k % 3 == 0 and words:
            changed = list(words)
            changed[rng.randrange(len(changed))] = "changed"
            out.append((1000 + k, rng.choice(["\n", "  ", "\t"]).join(changed)))
    return out + [(2000, None), (2001, ""), (2002, " \n\t"), (5, out[5][1]), (None, "no key here at all"), (None, None)]


def expected_groups(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    g = Groups()
    for i in range(len(rows)):
        g.head(i)
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                g.join(i, j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[g.head(i)] = min(k, least.get(g.head(i), k))
    return [(k, format(f, "016x"), least.get(g.head(i))) for i, ((k, _), f) in enumerate(zip(rows, fps))], g


@pytest.mark.parametrize("how", [{}, {"hot": 20, "blocks": 6}, {"blocks": 8}])
def test_simhash_groups(spark, how):
    importable(spark)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS `key`", "'z' AS component_id")
    got = simhash.near_duplicates(df, **how).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected_groups(rows)[0]))


def test_simhash_keeps_one_of_each_group(spark):
    rows = corpus(60)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS fingerprint", "'b' AS `own`")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    exp, g = expected_groups(rows)
    groups = {g.head(i): e[2] for i, e in enumerate(exp)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, groups.values()))
    assert simhash.keep_one(df.filter("false")).count() == 0


def test_bucket_links_span_dense_buckets():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([
        c ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
        for c in center] + [rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    a, b = simhash.bucket_links(np.zeros(len(fps), np.int64), fps)
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all() and len(a) < len(fps)
    g, want = Groups(), Groups()
    for i in range(len(fps)):
        g.head(i), want.head(i)
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4):
            want.join(i, int(j))
    for i, j in zip(a.tolist(), b.tolist()):
        g.join(i, j)
    assert [g.head(i) for i in range(len(fps))] == [want.head(i) for i in range(len(fps))]


# ----------------------------------------------------------------------- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last = row
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def plain_dedup(rows, least):
    order = lambda k, n: (k is not None, k or 0, n)
    at = {}
    for k, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= least:
                at[line] = min(at.get(line, order(k, n)), order(k, n))
    gone = {x for x in at for y in at if at[y] < at[x] and x != y and lines.within_one(x, y)}  # itself tested against edit distances below
    out = []
    for k, t in rows:
        keep = [line for n, line in enumerate((t or "").split("\n"))
                if len(line) < least or line not in gone and at[line] == order(k, n)]
        out.append((k, None if t is None else "\n".join(keep)))
    return out


def line_rows(seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abc ", k=rng.randint(5, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaa", "日本語の行です。", "日本語の行です", "é" * 8]
    rows = []
    for k in range(40):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            if rng.random() < 0.5:
                i = rng.randrange(len(line))
                line[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "yz", "a"])
            own.append("".join(line))
        rows.append((k, "\n".join(own)))
    return rows + [(50, None), (51, ""), (52, "\n\n"), (None, rows[3][1]), (3, rows[3][1]), (60, "long " * 8000), (61, "long " * 7999 + "lung ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    importable(spark)
    rows = line_rows(seed)
    rng = random.Random(seed)
    mixed = rng.sample(rows, len(rows))
    df = spark.createDataFrame(mixed, "doc_id long, text string").selectExpr("*", "1 AS `line`", "doc_id AS `key`", "'t' AS a")
    got = lines.deduplicate(df, least=6)
    assert got.columns == [*df.columns, "lines_dropped"]
    want = plain_dedup([r for r in rows if r[0] not in (60, 61)], 6) + [(60, "long " * 8000), (61, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_short_lines_go_as_exact_repeats(spark):
    importable(spark)
    rows = [(1, "yes\n\n- a\n \nyes"), (2, "- b\nyes\n\n \n日本語の行です。"), (3, "日本語の行です。\n日本語の行です\n- b\n}"), (4, "}\n\n")]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.lines_dropped) for r in got} == {
        1: ("yes\n\n- a\n ", 1), 2: ("- b\n\n \n日本語の行です。", 1), 3: ("日本語の行です\n}", 2), 4: ("\n", 1)}


def test_lines_of_rows_that_share_a_key(spark):
    importable(spark)
    rows = [(k, t.format(k=k)) for k in (None, 7) for t in ("again {k}\nfirst {k}\nagain {k}", "one {k}\ntwo {k}\nthree {k}")]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        str((k, t.removesuffix(f"\nagain {k}"), int("again" in t))) for k, t in rows)


def test_lines_of_an_empty_table(spark):
    assert lines.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_and_distance():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(2))
        assert lines.within_one(a, b) == (distance(a, b) <= 1)
        if a:
            whole, _ = lines.variant_hashes(a)
            for i in range(len(a)):
                short = a[:i] + a[i + 1:]
                assert not short or whole[i + 1] == lines.variant_hashes(short)[0][0]


# --------------------------------------------------------------------- vectors


def vector_rows(n=700, dim=16):
    rng = np.random.default_rng(5)
    rows = []
    centers = rng.standard_normal((12, dim))
    for k in range(n):
        label = int(rng.integers(0, 2)) if k % 9 else None
        v = centers[rng.integers(0, 12)] + 0.07 * rng.standard_normal(dim) if k % 2 else rng.standard_normal(dim)
        rows.append((k, [float(x) for x in v], label))
    copies = [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, 60, 2)] + [rows[1]]
    odd = [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [None, *[1.0] * (dim - 1)], 1),
           (2004, [float("inf")] * dim, 1), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[2][1], rows[2][2])]
    return rows + copies + odd


@pytest.mark.parametrize("hot", [3000, 40])
def test_vectors(spark, hot):
    importable(spark)
    rows = vector_rows()
    ok = [i for i, (_, v, y) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, g, low = [0] * len(rows), Groups(), {}
    for i in range(len(rows)):
        g.head(i)
    for i in ok:
        for j in ok:
            a, b = rows[i], rows[j]
            if i < j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    g.join(i, j)
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[g.head(i)] = min(r[0], low.get(g.head(i), r[0]))
    want = [(r[0], links[i], low.get(g.head(i)), r[0] == low.get(g.head(i))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS family")
    got = embeddings.near_duplicates(df, hot=hot)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_calibration():
    plan = embeddings.Plan(0.98, 0.999)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 32))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    d = plan.directions(32, 4)[0]
    assert ((np.abs(x @ d - y @ d) <= plan.window).sum(axis=1) >= plan.least).mean() > 0.998
    assert ((np.abs(x @ d - x[::-1] @ d) <= plan.window).sum(axis=1) >= plan.least).mean() < 0.01
