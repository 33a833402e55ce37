"""Language, quality, licenses and pages: held-out accuracy, brute force, planted cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronopanel.llm import html, language, licenses, quality
from chronopanel.llm.shared import importable

# -------------------------------------------------------------------- language

STEMS = {"aa": "the and of ing tion over under with".split(), "bb": "der die und ung keit schaft für zwö".split(),
         "cc": "que los ción mente para ñor".split()}


def sentence(rng, lang, n):
    own = STEMS[lang]
    return " ".join("".join(rng.choices(own, k=rng.randint(1, 3))) for _ in range(n)) + "."


def language_rows(n=400):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        lang = rng.choice(list(STEMS))
        text = sentence(rng, lang, rng.randint(5, 60))
        if k % 6 == 0:  # a passage in another language
            text += "\n" + sentence(rng, rng.choice(list(STEMS)), 3)
        rows.append((k, text, lang if k % 11 else None))
    return rows


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = [1, 0, 5, 64, 65, 200, 3]
    e = rng.normal(size=(sum(sizes), 3)) * 3
    t, s = np.exp(rng.normal(size=(3, 3))), np.array([0.2, 0.3, 0.5])
    p, moves, opening, ll = language.Chains(sizes).marginals(e, t, s, pairs=True)
    at, want_moves, want_ll = 0, np.zeros((3, 3)), 0.0
    for n in (n for n in sizes if n):
        own = np.exp(e[at:at + n])
        a, x = [], s
        for k in range(n):
            x = (x @ t) * own[k]
            a.append(x)
        b = [np.ones(3)]
        for k in range(n - 1, 0, -1):
            b.append(t @ (own[k] * b[-1]))
        b.reverse()
        z = a[-1].sum()
        want_ll += math.log(z)
        assert np.allclose(np.array(a) * np.array(b) / z, p[at:at + n])
        for k in range(1, n):
            want_moves += a[k - 1][:, None] * t * (own[k] * b[k])[None] / z
        at += n
    assert np.allclose(moves, want_moves) and math.isclose(ll, want_ll)
    # Brute force over all labellings of a short chain.
    e = e[:4]
    score = {y: math.prod([(s @ t)[y[0]], *[t[y[i - 1], y[i]] for i in range(1, 4)], *[math.exp(e[i, y[i]]) for i in range(4)]])
             for y in itertools.product(range(3), repeat=4)}
    q = language.Chains([4]).marginals(e, t, s)
    for i in range(4):
        for j in range(3):
            assert math.isclose(q[i, j], sum(v for y, v in score.items() if y[i] == j) / sum(score.values()))


def test_features():
    numbers, first = language.word_features(["abc", "x", "abc"], {"abc": 0})
    cut = np.split(numbers, first[1:])
    assert cut[0].tolist() == cut[2].tolist() and len(cut[0]) == 4 + 3 + 2 + 1 and len(cut[1]) == 2 + 1
    assert language.BUCKETS in cut[0]


def test_language_of_documents(spark):
    importable(spark)
    rows = language_rows()
    odd = [(9000, None, "aa"), (9001, "", "bb"), (9002, "123 — !?", "aa"), (None, sentence(random.Random(1), "bb", 30), None), rows[3],
           (9003, sentence(random.Random(2), "cc", 30_000), "cc")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' AS label", "1 AS score", "'q' AS own")
    model = language.fit(df, sample_rows=80)
    assert model.languages == ["aa", "bb", "cc"]
    assert (model.transition.argmax(axis=1) == np.arange(3)).all()
    got = language.identify(df, model).withColumn("held", language.held_out()).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {k: y for k, _, y in rows if y}
    held = [r for r in got if r.held and r.doc_id in truth]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (9000, 9001, 9002))
    assert by[None].lang_pred == "bb" and not by[None].held and by[9003].lang_pred == "cc" and by[9003].n_words == 30_000
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep(df, sample_rows=80)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {k for k, _, _ in rows if k % 6} and not {9000, 9001, 9002} & {r.doc_id for r in kept.collect()}


def test_words_in_another_language_get_their_own():
    rng = random.Random(3)
    rows = language_rows()
    m = language.train([t for _, t, y in rows if y], [y for _, _, y in rows if y])
    a, b = sentence(rng, "aa", 30), sentence(rng, "bb", 12)
    p = m.words([language.WORD.findall(f"{a} {b} {a}".lower())]).argmax(axis=1)
    assert np.mean(p == np.repeat([0, 1, 0], [30, 12, 30])) > 0.97


def test_runs_of_words_by_language(spark):
    importable(spark)
    rng = random.Random(4)
    rows = language_rows()
    m = language.train([t for _, t, y in rows if y], [y for _, _, y in rows if y])
    a, b = sentence(rng, "aa", 40), sentence(rng, "bb", 25)
    mixed = f"\u0130\u0130 12, {a} — {b} ... {a}!"
    odd = [(1, mixed), (2, None), (3, ""), (4, "7 — !?"), (None, b), (1, mixed), (5, "\u0130"), (6, f"{a} " * 900)]
    df = spark.createDataFrame(odd + [(100 + k, t) for k, t, _ in rows], "doc_id long, text string").selectExpr("*", "'x' AS runs", "2 AS start")
    got = language.label_runs(df, m).collect()
    plain = sorted((tuple(r) for r in language.identify(df, m).collect()), key=str)
    assert sorted((tuple(r)[:4] for r in got), key=str) == plain  # the documents' columns are those of the same labels
    # Brute force: every word of every text labelled and joined in a plain loop.
    texts = [r.text for r in df.select("text").collect()]
    for r, text in zip(got, texts):
        text, want = text or "", []
        p = m.words([language.WORD.findall(text.lower())])
        lengths = [len(c.lower()) for c in text]
        place = [i for i, n in enumerate(lengths) for _ in range(n)]
        for w, q in zip(language.WORD.finditer(text.lower()), p):
            lo, hi, name = place[w.start()], place[w.end() - 1] + 1, m.languages[q.argmax()]
            if not want or want[-1][2] != name:
                want.append([lo, hi, name, 0, 0, 0.0])
            run = want[-1]
            run[1], run[3], run[4], run[5] = hi, run[3] + 1, run[4] + hi - lo, run[5] + q.max() * (hi - lo)
        assert [(x.start, x.end, x.lang, x.words, x.letters) for x in r.runs] == [tuple(x[:5]) for x in want]
        assert np.allclose([x.probability for x in r.runs], [x[5] / x[4] for x in want])
        assert sum(x.words for x in r.runs) == r.n_words
    by = {r.doc_id: r for r in got}
    assert [r.runs for r in got if r.doc_id in (2, 3, 4)] == [[], [], []] and len([r for r in got if r.doc_id == 1]) == 2
    long = sorted(by[1].runs, key=lambda x: -x.words)[:3]
    assert {x.lang for x in long} == {"aa", "bb"} and any(abs(x.start - mixed.index(b)) < 20 for x in long if x.lang == "bb")
    none = language.label_runs(df, language.train([], [])).collect()
    assert all(r.lang_pred == "und" and {x.lang for x in r.runs} <= {"und"} and all(x.probability == 0 for x in r.runs) for r in none)
    assert language.label_runs(df.limit(0), m).count() == 0


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, "zzz qqq " * 9, "held") for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2] + language_rows(60)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=30)
    assert "held" not in model.languages


def test_long_texts_teach(spark):
    rows = [(k, f"{w * 1000} " * (1000 if k == 1 else 2), w) for k, w in ((1, "ab"), (3, "cd"), (4, "cd"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(~language.held_out())
    assert language.fit(df, rounds=2).languages == sorted({r.lang for r in df.select("lang").collect()}) and df.filter("lang = 'ab'").count()


def test_no_labels_and_no_rows(spark):
    importable(spark)
    shape = "doc_id long, text string, lang string"
    none, unlabelled = spark.createDataFrame([], shape), spark.createDataFrame([(1, "a b", None)], shape)
    assert language.identify(none, language.fit(none)).count() == 0
    r = language.identify(unlabelled, language.fit(unlabelled)).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


# --------------------------------------------------------------------- quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cov = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(cov)


def test_measures():
    rng = random.Random(9)
    texts = ["", None, " \t\n", "a", "x y\nx y\n\nx y", "a b c d e f g h a b c d e f g h i", "é  | *", "a " * 3000]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "c"]) + rng.choice([" ", "\n", "  ", "\x0b"]) for _ in range(rng.randint(0, 60))))
    got = quality.measure([t or "" for t in texts])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[c][i]) for c in names) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_binomial_tail():
    for n, p in ((1, 0.3), (12, 0.05), (40, 0.5)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(quality.binomial_tail(k, n, p), want, rel_tol=1e-9)
    assert quality.binomial_tail(3, 0, 0.1) == 1.0


def quality_rows(n=900):
    rng = random.Random(10)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(40)]
        bad = k % 4 == 0
        rows.append((k, (" | " if bad else " ").join(words), ["x", "y", None][k % 3]))
        labels.append((k, 0 if bad else 1))
    return rows, labels


def test_quality_verdicts(spark):
    importable(spark)
    rows, labels = quality_rows()
    odd = [(5000, None, "x"), (5001, "", None), (5002, "too short", "x"), (None, rows[1][1], "x"), rows[1], (5003, "w v " * 20_000, "y"),
           (5004, rows[2][1], "rare")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS kept", "2 AS n_words", "'s' AS stratum", "3 AS step", "doc_id AS own")
    marks = spark.createDataFrame(labels + labels[:9] + [(5004, 1), (None, 1), (77777, 0), (3, None), (5, 9)], "doc_id long, quality int")
    got = quality.judge(df, marks).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        text = next(t for k, t, _ in rows + odd if k == r.doc_id)
        n = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    by = {r.doc_id: r.kept for r in got}
    assert not any(by[k] for k, y in labels if y == 0)
    assert np.mean([by[k] for k, y in labels if y == 1]) > 0.98
    assert not by[5000] and not by[5001] and not by[5002] and by[None] and by[5004]
    kept = quality.keep(df, marks)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_certificates(spark):
    """Every certified step passes the exact test on the certifying half, and too few labels certify nothing."""
    importable(spark)
    rows, labels = quality_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = quality.measures(df).join(df.select("doc_id", "lang"), "doc_id").selectExpr("doc_id AS key", "coalesce(lang, '-') AS stratum", "*")
    own = own.withColumn("base_failed", quality.base_failed()).select("*", *[v.alias(f"m_{k}") for k, v in quality.rules().items()])
    marks = spark.createDataFrame(labels, "key long, quality int")
    cuts = quality.thresholds(own, marks, risk=0.05).collect()
    assert len(cuts) == 3 and all(c.step >= 0 and c.certified_steps > 0 for c in cuts)
    for c in cuts:
        assert quality.binomial_tail(c.good_rejected, c.good, 0.05) <= 0.05 / 3
    strict = quality.thresholds(own, marks, risk=0.001).collect()
    assert all(c.step == -1 and c.symbols == quality.GRID for c in strict)


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# -------------------------------------------------------------------- licenses


def test_notices(spark):
    importable(spark)
    mit = licenses.PASSAGES["MIT"]
    edited = mit.replace("free of charge", "free of any charge").replace("publish,", "")
    texts = [
        "Und so. Licensed under CC BY-NC 4.0.\nMore.", "licensed UNDER cc by 4.0", "Released under the MIT License.", "İİ Released under the MIT License",
        "Released under the Foo License, and under the MIT License", mit, "x " * 50 + edited + " y" * 50, None, "", "free of charge",
        "This work is licensed under the GNU General Public License, version 3. This work is licensed under the GNU General Public License, version 2.",
        "w " * 20_000 + "Licensed under the Apache License, Version 2.0", "Licensed under the Apache",
    ]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS coverage", "2 AS template")
    got = licenses.find(df).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add((r.license_id, texts[r.doc_id][r.start_char:r.end_char]))
    assert found == {
        0: {("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")}, 1: {("CC-BY-4.0", "licensed UNDER cc by 4.0")},
        2: {("MIT", "Released under the MIT License")}, 4: {("MIT", "under the MIT License")}, 3: {("MIT", "Released under the MIT License")},
        5: {("MIT", mit)}, 6: {("MIT", edited)},
        10: {("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
             ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2")},
        11: {("Apache-2.0", "Licensed under the Apache License, Version 2.0")},
    }
    assert sum(r.doc_id == 0 for r in got) == 2
    assert all(licenses.COVERAGE <= r.coverage <= 1 for r in got)
    assert licenses.find(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.find(df, templates=[licenses.template("X", "x", "too short a text")])


LONG = {  # headers and deeds as projects write them
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": licenses.PASSAGES["BSD-2-Clause whole"],
    "BSD-3-Clause": licenses.PASSAGES["BSD-3-Clause whole"].replace("*", "").replace("the copyright holder nor", "Foo Inc. nor"),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC0-1.0": licenses.PASSAGES["CC0-1.0 text"].replace("*", ""),
    "MPL-2.0": licenses.PASSAGES["MPL-2.0"].replace("*", ""),
    "MIT": "Copyright 2020 Foo. " + licenses.PASSAGES["MIT whole"],
}


def test_long_notices_are_told_apart(spark):
    importable(spark)
    texts = {k: "Before it. " + t + " And after." for k, t in LONG.items()}
    two = "Licensed under CC0 1.0 Licensed under CC0 1.0 Licensed under CC BY-SA 4.0 Licensed under CC BY 4.0"
    none = "This library is free software; it is under the terms of the GNU Library General Public License, version 2. Licensed under CC BY-XX 4.0"
    df = spark.createDataFrame([*texts.items(), ("two", two), ("none", none)], "doc_id string, text string")
    got = {}
    for r in licenses.find(df).collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.license_id))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {k: [k] for k in LONG} | {
        "two": ["CC0-1.0", "CC0-1.0", "CC-BY-SA-4.0", "CC-BY-4.0"]}


def test_scan_against_all_shared_grams():
    """Winnowed fingerprints lead to what all common grams of all templates lead to."""
    rng, index = random.Random(33), licenses.Index(licenses.standard_templates())
    grams = {}
    for k, t in enumerate(index.templates):
        for p in range(len(t.words) - licenses.GRAM + 1):
            grams.setdefault(t.words[p:p + licenses.GRAM], []).append((k, p))
    found = 0
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 5)):
            own = list(rng.choice(index.templates).words)
            if rng.random() < 0.3 and len(own) > 30:
                own[rng.randrange(10, 20)] = "changed"
            words += own + rng.choices(["the", "license", "under", "4", "0", "public"], k=rng.randint(0, 9))
        codes = licenses.gram_hashes(licenses.word_hashes(words))
        winnowed = licenses.scan(words, index.hits(codes, licenses.winnow(codes)), index, licenses.COVERAGE)
        every = np.array([(j, k, p) for j in range(len(codes)) for k, p in grams.get(tuple(words[j:j + licenses.GRAM]), ())], np.int64)
        assert winnowed == licenses.scan(words, every, index, licenses.COVERAGE)
        found += len(winnowed)
    assert found > 80


def test_winnowing_meets_every_shared_run():
    rng = random.Random(11)
    least = licenses.GRAM + licenses.WINDOW - 1
    for _ in range(300):
        run = [f"r{rng.randint(0, 4)}" for _ in range(least)]
        sides = [[f"{s}{rng.randint(0, 9)}" for _ in range(rng.randint(0, 9))] + run + [f"{s}{rng.randint(0, 9)}" for _ in range(rng.randint(0, 9))]
                 for s in "ab"]
        prints = [set(g[licenses.winnow(g)].tolist()) for g in (licenses.gram_hashes(licenses.word_hashes(s)) for s in sides)]
        assert prints[0] & prints[1]


def test_alignment_against_all_subsequences():
    rng = random.Random(12)
    for _ in range(200):
        want, words = [tuple(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(2)]
        got = licenses.align(want, list(words), 0, band=8)
        h = np.zeros((len(want) + 1, len(words) + 1), int)
        for i in range(len(want)):
            for j in range(len(words)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if want[i] == words[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert (got[3] if got else 0) == h.max()


# ----------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot of them, on each and every page.</div>
<div id="wrap">{main}<div class="sidebar"><p>A long side text that could be taken for a part of the article, but is not one.</p></div></div>
<section id="comments"><p>A reader wrote a long comment about this article, which is not to be kept at all.</p></section><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize("main", [
    "<article><h2>Head</h2><p>{0}<p>Of.<p>{1}</article>", "<div class='post'><h2>Head</h2><p>{0}</p><p>Of.</p><p>{1}</p></div>",
    "<main><section><h2>Head</h2><p>{0}</p></section><section><p>Of.</p><p>{1}</p></section></main>",
    "<td><h2>Head</h2>{0}<br>Of.<br><br>{1}<form><input><p>Sign up now for our letter of news</p></form></td>"])
def test_article(main):
    a = "Some <b>bo</b>ld words &amp; a <a href='x>y'>link</a> in\n a   paragraph that goes on for a while, as they do, with commas."
    b = "Another&nbsp;paragraph, with &lt;tags&gt; in words, that is as long as the first one or even somewhat longer than it."
    want = "Head Some bold words & a link in a paragraph that goes on for a while, as they do, with commas. Of. " \
           "Another paragraph, with <tags> in words, that is as long as the first one or even somewhat longer than it."
    assert html.main_text(PAGE.format(main=main.format(a, b))) == want


def test_article_split_under_body():
    part = lambda w: "<div>" + 3 * f"<p>{60 * (w + ' ')}</p>" + "</div>"
    want = lambda w: " ".join(180 * [w])
    assert html.main_text(f"<body>{part('left')}{part('next')}</body>") == f"{want('left')} {want('next')}"
    assert html.main_text(f"<body><nav>no</nav><h1>A title</h1>{part('left')}<div class=ad>no</div></body>") == f"A title {want('left')}"


TITLE, FIRST, SECOND = "A Title", "The first paragraph of a story, with commas, that goes on for a while. " * 3, "The second one follows, as they do, and is as long. " * 3
STORY = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
TOLD = " ".join(f"{TITLE} {FIRST} {SECOND}".split())
READER = "A reader wrote this comment of some length, in two sentences. Nobody had asked for it, but here it is, in full."
TEMPLATES = {
    "named after a search": ('<div class="search-article">{}</div>', TOLD),
    "wrapper told by what it has": ('<div class="wrapper has-sidebar">{}<div class="sidebar"><p>On the side.</p></div></div>', TOLD),
    "a post on cookies": ('<div class="post cookie-recipes">{}</div>', TOLD),
    "state of the page in its class": ('<div id="page" class="nav-open">{}</div>', TOLD),
    "form around the page": ('<form id="aspnet"><nav><a href="/x">menu</a></nav>{}<div class="comments"><p>' + READER + "</p></div></form>", TOLD),
    "parts named like boxes": (
        '<article>{}<div class="related-work"><p>Others did as much.</p></div><section id="notice-of-appeal"><p>It was appealed.</p></section></article>',
        TOLD + " Others did as much. It was appealed."),
    "short article, box beside": ("<article><p>Four words, no more.</p></article><div>one two three four five six seven eight nine ten eleven twelve</div>",
                                  "Four words, no more."),
    "reader without a name": ("<article>{}</article><div><p>" + READER + "</p></div>", TOLD),
    "title before the article": (
        '<header class="site-header"><h1>Site</h1></header><main><header><h1>Big</h1></header><p>' + SECOND + "</p><article>{}</article><div><p>"
        + READER + "</p></div></main>", "Big " + " ".join(SECOND.split()) + " " + TOLD),
    "boxes in the article": (
        '<article>{}<div class="share-buttons">Share this</div><aside>An aside.</aside><div class="ad">Buy it.</div><div class="related-posts"><p>More of it.</p></div>'
        '<form class="newsletter-signup"><p>Your address</p><input></form></article>', TOLD),
    "more comments than story": ('<div class="post">{}</div><ol class="comment-list">' + 5 * f'<li class="comment-body"><p>{READER}</p></li>' + "</ol>", TOLD),
    "comments as articles": ("<main><article>{}</article>" + 5 * f'<article class="comment"><p>{READER}</p></article>' + "</main>", TOLD),
    "two articles": ("<div><article>{}</article><article><p>" + SECOND + "</p></article></div>", TOLD + " " + " ".join(SECOND.split())),
    "hidden by attribute, not by class": ('<div class="md hidden block">{}</div><div class="x" hidden>No.</div>', TOLD),
    "role": ('<div role="main">{}</div><div><p>' + READER + "</p></div>", TOLD),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_page_templates(name):
    page, want = TEMPLATES[name]
    head, foot = '<html><head><title>t</title></head><body><nav><a href="/">Home</a> <a href="/b">B</a></nav>', "<footer>Imprint</footer></body></html>"
    assert html.main_text(head + page.replace("{}", STORY) + foot) == want


def naive_choice(page):
    """Densities by recursion over the tree, and the chosen subtree, on a page without articles."""
    n = len(page.tag)
    kids = [[k for k in range(1, n) if page.parent[k] == e] for e in range(n)]
    own = [sum(len("".join(r.split())) for k, r in page.runs if k == e and not page.drop[e]) for e in range(n)]
    counted = lambda e: [k for k in kids[e] if not page.drop[k] and not page.mark[k]]
    chars = lambda e: own[e] + sum(map(chars, counted(e)))
    tags = lambda e: sum(1 + tags(k) for k in counted(e))
    linked = lambda e, within: (own[e] if within else 0) + sum(linked(k, within or page.tag[k] == "a") for k in counted(e))
    anchors = lambda e: sum((page.tag[k] == "a") + anchors(k) for k in counted(e))
    up = lambda e: [e] + (up(page.parent[e]) if e else [])
    links = [linked(e, any(page.tag[k] == "a" for k in up(e))) for e in range(n)]
    body = page.body
    share = links[body] / max(chars(body), 1)
    weights = [min((1, 1, html.MARKED, 0)[page.mark[k]] for k in up(e)) for e in range(n)]
    density = []
    for e in range(n):
        c, t, a, b = chars(e), max(tags(e), 1), links[e], max(anchors(e), 1)
        if not c or page.drop[e]:
            density.append(0.0)
            continue
        base = max(np.log(np.log(c / max(c - a, 1) * a + share * c + np.e)), 0.1)
        density.append(weights[e] * c / t * np.log(c / max(a, 1) * t / b) / base)
    total = [sum(density[k] for k in kids[e] if not page.mark[k]) for e in range(n)]
    usable = [e for e in range(n) if body in up(e) and not page.drop[e] and weights[e]]
    core = max(usable, key=lambda e: (round(total[e], 9), round(density[e], 9), -e))
    if not total[core]:
        core = body
    path = up(core)[:up(core).index(body) + 1]
    least, chosen = min(density[e] for e in path), core
    for e in path[1:]:
        if any(density[k] >= least - 1e-9 and k not in path and not page.drop[k] and not page.mark[k] and page.tag[k] not in html.INLINE for k in kids[e]):
            chosen = e
    return density, total, None if weights[core] < 1 else chosen


def test_densities_and_choice_against_recursion():
    rng, compared = random.Random(31), 0

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            words = " ".join(rng.choices(["one", "three", "sixteen", "a"], k=rng.randint(0, 12)))
            if depth and rng.random() < 0.7:
                tag = rng.choice(["div", "div", "section", "ul", "a", "aside", "script", 'div class="ad-box"', 'div id="comments"'])
                out.append(f"<{tag}>{words}{tree(depth - 1) if tag != 'script' else ''}</{tag.split()[0]}>")
            else:
                out.append(f"<p>{words}</p>")
        return "".join(out)

    for _ in range(150):
        page = html.Page(f"<html><body>{tree(3)}</body></html>")
        page.unmark()
        density, total, _, _ = page.densities()
        want_density, want_total, want = naive_choice(page)
        assert np.allclose(density, want_density) and np.allclose(total, want_total)
        if want is not None:  # a marked element with the greatest sum loses its mark, which changes the densities
            compared += 1
            assert page.choose()[:1] == [want]
    assert compared > 100


def test_odd_pages(spark):
    importable(spark)
    for page, want in (("", ""), ("plain &eacute; text", "plain é text"), ("<p>a<p>b", "a b"), ("<!-- only", ""), ("<p>x < y</p>", "x < y"),
                       ("<script>no", ""), ("<div hidden>no</div><p>yes</p>", "yes"), ("<p>a<!-- <p>no --> b</p>", "a b")):
        assert html.main_text(page) == want
    deep = "<div>" * 5000 + "<p>deep text here</p>" + "</div>" * 5000
    rows = [(1, "u", PAGE.format(main="<article><p>one two</p></article>")), (2, None, None), (None, "v", "<p>w</p>"), (3, "d", deep), (2, None, None),
            (4, "l", "<body>" + "<p>many words in it</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS own", "0 AS n_chars")
    got = html.extract(df).collect()
    assert sorted(((str(r.page_id), r.n_chars) for r in got)) == sorted([("1", 7), ("2", 0), ("None", 1), ("3", 14), ("2", 0), ("4", 17 * 20_000 - 1)])
    assert all(len(r.text) == r.n_chars for r in got) and html.extract(df.filter("false")).count() == 0
