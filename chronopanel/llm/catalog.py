"""The operators of this package as queries over the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, html, language, licenses, lines, nearest, negatives, packing, quality, search, simhash, tokenfile
from .shared import importable, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

JSON_MODEL = ("file", public_tokenizers.path("byte_bpe_50k.json"))
RANK_MODEL = ("ranks", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
VOCABULARY = 50_257
SEQUENCE = 2048


def query(fn: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents by a model that saw three quarters of the keys."""
    docs = read(spark, folder, "documents")
    found = language.label_runs(docs, language.fit(docs))
    return found.select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "n_words", F.size("runs").alias("n_runs"))


@query
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as bit-packed token files in key order, read back."""
    docs = tokenfile.ordered(read(spark, folder, "documents"))
    encoded = bpe.encode(docs, JSON_MODEL, "key", append=2)
    back = tokenfile.read(tokenfile.write(encoded, VOCABULARY))
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    encoded = bpe.encode(read(spark, folder, "documents"), JSON_MODEL, append=0)
    items = packing.pieces(encoded, SEQUENCE).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed, _ = packing.pack(items, capacity=SEQUENCE)
    return packed


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in all documents, with coverage and spans."""
    return licenses.find(read(spark, folder, "documents"))


@query
def op5_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op6_vector_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Links, groups and representatives of all vectors, within their labels."""
    return embeddings.near_duplicates(read(spark, folder, "embeddings"))


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that stand, exactly or within one edit, earlier in the corpus."""
    return lines.deduplicate(read(spark, folder, "documents")).select("doc_id", "text", "lines_dropped")


@query
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of all documents, thresholds certified on the labelled ones."""
    found = quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(read(spark, folder, "pages"))


@query
def op10_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents by ranks, and the bytes they decode to, as digests."""
    encoded = bpe.encode(read(spark, folder, "documents"), RANK_MODEL)
    both = bpe.decode(
        encoded.select(F.struct("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")).alias("own"), "ids"),
        RANK_MODEL, key="own")
    return both.select("own.*", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of all for every item of the benchmark."""
    return search.rank(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best of all vectors for every fiftieth."""
    return nearest.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with some labels moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


SQL["op11_ranked_search"] = f"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, whole GROUP BY term),
lengths AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM sizes, whole),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{search.UPPER}', '{search.LOWER}'), '{search.TERM}')) AS term FROM benchmark),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""

_WHOLE = """
WITH whole AS (
    SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

SQL["op12_nearest_vectors"] = _WHOLE.format(label="label") + """,
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""

SQL["op13_hard_negatives"] = _WHOLE.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END") + """,
scores AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id
    WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND c.label IS NOT NULL),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
    s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scores s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""
