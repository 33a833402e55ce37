"""Near copies by shingle similarity, against all pairs, and the recall at the threshold."""

import random

import numpy as np
import pytest
from test_llm_duplicates import Groups

from chronopanel.llm import similar
from chronopanel.llm.shared import importable


def plain_sets(text, width=5):
    words = (text or "").lower().split() if (text or "").isascii() else [w for w in (text or "").split()]
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / max(1, len(a | b))


def expected(rows, similarity=0.8):
    """Key of the row that stays for every group."""
    sets, g = [plain_sets(t) for _, t in rows], Groups()
    for i, a in enumerate(sets):
        g.head(i)
        for j in range(i):
            if jaccard(a, sets[j]) >= similarity:
                g.join(i, j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(g.head(i), []).append(k)
    return sorted((min((k for k in ks if k is not None), default=None) for ks in groups.values()), key=str)


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def altered(rng, own, share):
    out = list(own)
    for i in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("how", [{}, {"hot_rows": 5}, {"hot_bytes": 4000}])
def test_keep_one(spark, how):
    importable(spark)
    rng, rows = random.Random(3), []
    base = [words(rng, rng.randint(30, 300)) for _ in range(40)]
    for k, own in enumerate(base):
        rows.append((k, " ".join(own)))
        for share in (0.005, 0.01, 0.02, 0.05):  # on both sides of the threshold
            rows.append((100 + len(rows), " ".join(altered(rng, own, share))))
    rows += [(1000 + i, "  ".join(altered(rng, base[7], 0.004)).upper()) for i in range(30)]  # a large group
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "Two  WORDS"), (2005, "word " * 50), (2006, "word " * 90),
             (None, " ".join(base[3])), (None, "a text without a key of its own"), (None, "a text without a key of its own"),
             (9, "another text under a key that is there"), (9, " ".join(base[9]))]
    df = spark.createDataFrame([(k, t, "z", 1, 2) for k, t in rows], "doc_id long, text string, own_set string, node int, g int").repartition(4)
    got = similar.keep_one(df, **how)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == expected(rows)
    assert similar.keep_one(df.filter("false")).count() == 0


def test_recall_at_the_threshold():
    """Pairs with a similarity from 0.8 to 0.82 share a band and stay within the radius."""
    rng, found, pairs, bits = random.Random(4), 0, 0, []
    while pairs < 400:
        own = words(rng, rng.randint(100, 1500))
        other = altered(rng, own, rng.uniform(0.01, 0.03))
        a, b = similar.hashes(" ".join(own)), similar.hashes(" ".join(other))
        x, y = np.unique(a), np.unique(b)
        both = len(np.intersect1d(x, y))
        if not 0.8 <= both / (len(x) + len(y) - both) < 0.82:
            continue
        pairs += 1
        bits.append((similar.majority(a) ^ similar.majority(b)).bit_count())
        found += bool((similar.bands(x) == similar.bands(y)).any()) and bits[-1] <= similar.RADIUS
    assert found >= 0.985 * pairs and max(bits) < similar.RADIUS


def test_measures_agree_with_the_operator():
    from chronopanel.llm import simhash

    for text in ("", "one", "One two three four five six seven", "a b " * 700):
        assert similar.majority(similar.hashes(text, 4)) == simhash.fingerprint(text, 4)


def plain_kept(rows, similarity):
    """Keys that stay where sets of shingle hashes are compared two by two."""
    sets, g = [np.unique(similar.hashes(t)) for _, t in rows], Groups()
    for i, a in enumerate(sets):
        g.head(i)
        for j in range(i):
            both = len(np.intersect1d(a, sets[j], assume_unique=True))
            if both >= similarity * (len(a) + len(sets[j]) - both):
                g.join(i, j)
    return sorted({min(rows[j][0] for j in range(len(rows)) if g.head(j) == g.head(i)) for i in range(len(rows))})


def test_pairs_without_a_common_band_are_found(spark):
    """At 0.8 a pair in 600 shares no band, and repeats move fingerprints apart: all pairs at or above the threshold still end in one group."""
    importable(spark)
    rng, rows, missed = random.Random(8), [], 0
    while missed < 3:  # pairs that bands lose
        own = words(rng, rng.randint(40, 120))
        other = altered(rng, own, rng.uniform(0.01, 0.04))
        x, y = (np.unique(similar.hashes(" ".join(w))) for w in (own, other))
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both) and not (similar.bands(x) == similar.bands(y)).any():
            missed += 1
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(other))]
    base = words(rng, 60)  # nearly the same sets, one with a line repeated until it outweighs all others
    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + (base[-6:]) * 300))]
    passage = words(rng, 30)  # common to many texts that are otherwise their own
    rows += [(len(rows) + i, " ".join(words(rng, 40) + passage)) for i in range(30)]
    rows += [(len(rows) + i, " ".join(words(rng, rng.randint(1, 12)))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == plain_kept(rows, 0.8)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_prefixes_of_similar_sets_meet(similarity):
    """Whatever comes last in the order, and at the threshold itself."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        own, other = np.sort(pool[:n]), None
        gone = int(rng.integers(0, n + 1))
        other = np.unique(np.concatenate([own[gone:], pool[n:n + int(rng.integers(0, gone + 1))]]))
        common = np.sort(rng.choice(pool, len(pool) // 3, replace=False))
        held = rng.integers(3, 9, len(common))
        both = len(np.intersect1d(own, other))
        if len(other) and both >= similarity * (len(own) + len(other) - both):
            assert len(np.intersect1d(similar.prefix(own, similarity, common, held), similar.prefix(other, similarity, common, held)))


def test_parities_never_put_sets_further_apart_than_they_are():
    rng = np.random.default_rng(7)
    for n, m, both in [(0, 0, 0), (1, 1, 1), (1, 9, 0), (40, 50, 40), (400, 420, 380), (3000, 2500, 2400), (17, 900, 17)]:
        pool = np.unique(rng.integers(0, 2**64, n + m - both + 8, dtype=np.uint64))
        own, other = np.sort(pool[:n]), np.sort(pool[n - both:n - both + m])
        apart = similar.least_apart(similar.parities(own), similar.parities(other))
        assert apart <= n + m - 2 * both and (n < 100 or m > 2 * n or apart >= 0.5 * (n + m - 2 * both))
