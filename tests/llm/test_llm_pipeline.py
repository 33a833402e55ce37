"""The registered queries over a whole small table, and the pipeline stage by stage, against brute force."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_llm_duplicates import Groups, expected_groups, plain_dedup
from test_llm_similar import expected
from test_llm_text import plain_counts

import __spark_entry__ as entry
from chronopanel.llm import catalog, lines, packing, quality, tokens
from chronopanel.llm.shared import importable

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CONTRACT = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_packed_sequences": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                             "sequence_id": "bigint", "offset": "bigint"},
    "op5_simhash_groups": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_vector_groups": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
                          "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.exists(FOLDER):
        pytest.skip("test tables not present")
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def of(name):
        if name not in done:
            df = catalog.QUERIES[name](spark, FOLDER)
            assert CONTRACT.get(name, {}).items() <= dict(df.dtypes).items()
            done[name] = df.collect()
        return done[name]

    return of


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_tokens(result, docs):
    import tiktoken

    plain = tokens.from_file(catalog.JSON_MODEL[1])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(catalog.RANK_MODEL[1], "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {k: plain.encode(t or "", add_special_tokens=False).ids for k, t, _ in docs}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    at, want = 0, {}
    for k, _, _ in docs:
        want[k] = (at, len(ids[k]) + 1, crc(ids[k] + [2]))
        at += len(ids[k]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result("op2_token_files")} == want
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in result("op10_bpe_round_trip")} == {
        k: (sha(np.array(tik.encode_ordinary(t or ""), "<u4").tobytes()), sha((t or "").encode())) for k, t, _ in docs}
    check_packed(result("op3_packed_sequences"), {k: ids[k] + [0] for k in ids})


def check_packed(rows, ids):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(own):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=2049), 2048)
    assert len(bins) <= bound * 1.02 + 1


def test_language(result, docs):
    rows, truth = result("op1_language_id"), {k: y for k, _, y in docs}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean(held) > 0.95


def test_groups(result, docs):
    want = expected_groups([(k, t) for k, t, _ in docs])[0]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in result("op5_simhash_groups")) == sorted(want)


def test_lines(result, docs):
    # The brute force compares all pairs of lines of nearly equal length that share their first or last characters.
    at, by = {}, {}
    for k, t, _ in docs:
        for n, line in enumerate((t or "").split("\n")):
            if len(line) >= lines.LEAST and line not in at:
                at[line] = (k, n)
                by.setdefault((0, line[:8]), []).append(line)
                by.setdefault((1, line[-8:]), []).append(line)
    gone = {y for own in by.values() for i, y in enumerate(own) for x in own[:i] if lines.within_one(x, y)}
    want = {k: "\n".join(line for n, line in enumerate((t or "").split("\n")) if len(line) < lines.LEAST or line not in gone and at[line] == (k, n))
            for k, t, _ in docs}
    assert {r.doc_id: r.text for r in result("op7_line_dedup")} == want


def test_quality(result, docs):
    text = {k: t for k, t, _ in docs}
    for r in result("op8_quality_rules"):
        n = plain_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.kept and r.base_failed)


def test_vectors_and_pages_and_licenses(result, spark, docs):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    g, links = Groups(), {r.vec_id: 0 for r in rows}
    for i, a in enumerate(rows):
        g.head(a.vec_id)
        x = np.array(a.embedding)
        for b in rows[:i]:
            y = np.array(b.embedding)
            if a.label == b.label and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a.vec_id] += 1
                links[b.vec_id] += 1
                g.join(a.vec_id, b.vec_id)
    assert {r.vec_id: (r.n_links, r.component_id) for r in result("op6_vector_groups")} == {k: (n, g.head(k)) for k, n in links.items()}
    pages = result("op9_main_text")
    assert len(pages) == spark.read.parquet(f"{FOLDER}/pages.parquet").count() and all(len(r.text) == r.n_chars > 0 for r in pages)
    text = {k: t for k, t, _ in docs}
    notices = {r.doc_id for r in result("op4_license_scan")}
    assert notices == {k for k, t in text.items() if "icensed under" in (t or "") or "Released under" in (t or "")}


# -------------------------------------------------------------------- pipeline


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "and", "of", "ing", "tion", "er", "re"], k=rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    importable(spark)
    rng, rows = random.Random(21), []
    for k in range(150):
        rows.append((k, "\n".join(prose(rng, rng.randint(6, 20)) for _ in range(rng.randint(3, 8))), "en"))
    for k in range(150, 180):
        words = rows[k - 150][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, "\n".join([" ".join(words), "A line of its own that is long enough to stay."]), "en"))
    rows += [(180, rows[4][1], "en"), (181, None, "en"), (182, "", None), (183, "spam " * 60, "en"), (184, "1 2 3 4 5 6 " * 4, "en"),
             (185, rows[9][1] + "\n" + prose(rng, 2000), None), (5, rows[5][1], "en")]
    full = [(k, t, y, f"s{k % 3}", None if t is None else len(t)) for k, t, y in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0 if k == 183 else 1) for k in range(186)], "doc_id long, quality int").write.parquet(
        f"{folder}/labels.parquet")
    return folder, full


def test_pipeline(spark, corpus):
    import corpus_pipeline as C

    folder, full = corpus
    assert [n for n, _ in C.STAGES] == ["quality_rules", "language_id", "line_dedup", "near_duplicates", "pack_sequences"]
    from chronopanel.llm.shared import read, store

    docs, seen = read(spark, folder, "documents"), {}
    columns = docs.columns
    for name, stage in C.STAGES:
        docs = store(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs.collect()
        assert name == "pack_sequences" or docs.columns == columns
    good = sorted(str(r[0]) for r in full if plain_counts(r[1])[0] >= 20 and 100 * plain_counts(r[1])[4] <= 30 * plain_counts(r[1])[0])
    assert sorted(str(r.doc_id) for r in seen["quality_rules"]) == good
    kept = sorted(r.doc_id for r in seen["language_id"])
    assert kept == sorted(r.doc_id for r in seen["quality_rules"] if r.doc_id != 184)  # no letters
    before = [(r.doc_id, r.text) for r in seen["language_id"]]
    want = [(k, t) for (k, t), (_, old) in zip(plain_dedup(before, lines.LEAST), before)
            if t == old or any(len(x) >= lines.LEAST for x in t.split("\n"))]
    assert sorted((r.doc_id, r.text) for r in seen["line_dedup"]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"]) and 180 not in {k for k, _ in want}
    rows = [(r.doc_id, r.text) for r in seen["line_dedup"]]
    assert sorted((r.doc_id for r in seen["near_duplicates"]), key=str) == expected(rows)  # all pairs of shingle sets
    plain = tokens.from_file(catalog.JSON_MODEL[1])
    check_packed(seen["pack_sequences"], {
        r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [0] for r in seen["near_duplicates"]})
    assert C.run(spark, folder).count() == len(seen["pack_sequences"])


def test_line_stage_keeps_own_short_lines(spark):
    import corpus_pipeline as C

    footer, own = "Released under the terms given at the end of the book.", "Own verse,\nits short lines,\nand no more."
    rows = [(1, f"A first document with a line of its own.\n{footer}"), (2, f"{own}\n{footer}"), (3, f"Own verse,\n \n{footer}"), (4, " \n")]
    got = C.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L AS n_chars"), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {
        1: (rows[0][1], len(rows[0][1])), 2: (own, len(own)), 4: (" \n", 2)}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_quality_sql_free_rules_name_their_measures():
    assert set(quality.RULES) == set(quality.rules())


def test_line_stage_with_a_column_of_the_counter(spark):
    import corpus_pipeline as C

    rows = [(1, "One line that both of these documents hold.", 7), (2, "One line that both of these documents hold.\nAnd more.", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_dropped long").selectExpr("*", "1L AS n_chars")
    got = C.line_dedup(spark, docs, "")
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == {(1, rows[0][1], 7, 43), (2, "And more.", 8, 9)}
    assert lines.deduplicate(docs).columns == ["doc_id", "text", "n_chars", "lines_dropped"]


def test_found_languages_decide_who_shares_a_sequence(spark):
    import corpus_pipeline as C

    english = ["the man and the woman went to the house by the river and talked of the weather in the evening", "he said that she would have been there with them when the work was done this year"]
    german = ["der Mann und die Frau gingen am Abend zum Haus an dem Fluss und sprachen nicht mehr", "sie sagte dass es auch in diesem Jahr nicht ohne die anderen gehen werde und schwieg"]
    rows = [(k, own[k % 2] + f" {own[k // 2 % 2]}", y if k % 8 else None) for k in range(80) for y, own in ((("en", english), ("de", german))[k // 40],)]
    docs = spark.createDataFrame([(k, t, y, "s", len(t)) for k, t, y in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labelled = C.language_id(spark, docs, "")
    assert labelled.columns == docs.columns
    assert {r.doc_id: r.lang for r in labelled.collect()} == {k: "en" if k < 40 else "de" for k in range(80)}
    packed = C.pack_sequences(spark, labelled, "").collect()
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, set()).add("en" if r.doc_id < 40 else "de")
    assert all(len(own) == 1 for own in by.values()) and {r.doc_id for r in packed} == set(range(80))
    mixed = docs.withColumn("lang", F.lit(None).cast("string"))
    assert len({r.sequence_id for r in C.pack_sequences(spark, mixed, "").collect()}) < len(by) + 1


@pytest.mark.parametrize("group", [7, 1000])
def test_packing_by_a_column(spark, group):
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 64), rng.choice(["a", "b", None])) for k in range(400)]
    packed, proof = packing.pack(spark.createDataFrame(rows, "k long, length long, kind string"), capacity=64, group=group, by="kind")
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.sequence_id, []).append(r)
    assert sorted(tuple(r)[:3] for own in bins.values() for r in own) == rows
    assert all(len({r.kind for r in own}) == 1 and sum(r.length for r in own) <= 64 for own in bins.values())
    bound = sum(packing.lower_bound(np.bincount([n for _, n, y in rows if y == x], minlength=65), 64) for x in ("a", "b", None))
    assert proof["bound"] == bound <= len(bins) == proof["bins"] <= bound * 1.1 + 3
