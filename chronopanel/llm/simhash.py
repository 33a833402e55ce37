"""Near duplicates by SimHash, with pivot distance tables (operator 5).

Fingerprints within ``bits`` of each other agree on at least ``blocks - bits``
of ``blocks`` bit blocks, so they meet in the bucket of such a combination.
Inside a bucket every fingerprint has its row of Hamming distances to fixed
reference fingerprints, computed beforehand; a pair is discarded when any
coordinate differs by more than ``bits`` (the triangle inequality), and the
survivors are verified.  Equal fingerprints are one node from the start, and a
bucket yields links that span its groups, never all pairs.  A bucket with more
than ``hot`` fingerprints is cut to chunks, and every pair of chunks is a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, partitions, store, text_slices

BITS, BLOCKS, PIVOTS, HOT, SMALL = 4, 6, 32, 20_000, 24


def fingerprint(text: str, width: int = 4, seed: int = 42, most: int = 1 << 20) -> int:
    """64 bits; ASCII lower case, words between ASCII white space, a bit is set when over half the shingle hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[width - 1:] if len(words) >= width else ends[-1:]).tolist()
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, most):
        hashes = [xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[lo:lo + most], stops[lo:lo + most])]
        flags = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += flags.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``(key, fp)`` per row, ``fp`` as signed long; a text without words (or null) has fingerprint zero."""

    def run(batches):
        for part, texts in text_slices(batches, text):
            own = np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own)], names=[key, "fp"])

    schema = T.StructType([docs.schema[key], T.StructField("fp", T.LongType())])
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def references(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, by a published 64-bit mixing step from a counter."""
    out, state, mask = [], 0, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def pivot_table(fps: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ references(n)[None, :]).astype(np.int8)


def _survive(table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Pairs whose coordinates all differ by at most ``bits``; a few coordinates at a time, on what is left."""
    left = np.arange(len(i))
    for lo in range(0, table.shape[1], 4):
        near = (np.abs(table[i[left], lo:lo + 4] - table[j[left], lo:lo + 4]) <= bits).all(axis=1)
        left = left[near]
        if not len(left):
            break
    return left


def _link(fps: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    kept = _survive(table, i, j, bits)
    i, j = i[kept], j[kept]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
    return i[near], j[near]


def bucket_links(bucket: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that span the groups of every bucket; rows are sorted by bucket.

    Small buckets compare their rows at every distance apart; in large ones a
    search from each unreached row takes what it reaches out of the comparison.
    """
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = pivot_table(fps)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(cuts, n))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    small = size <= SMALL
    for gap in range(1, SMALL):
        i = np.flatnonzero(small[:-gap] & (bucket[gap:] == bucket[:-gap])) if gap < n else np.zeros(0, np.int64)
        if not len(i):
            break
        a, b = _link(fps, i, i + gap, table, bits)
        left.append(a), right.append(b)
    for lo, size in zip(cuts[sizes > SMALL], sizes[sizes > SMALL]):
        rows = lo + np.argsort(table[lo:lo + size, 0], kind="stable")  # unreached rows by first coordinate
        while len(rows) > 1:
            front, rows = rows[:1], rows[1:]
            while len(front) and len(rows):
                at, front = front[0], front[1:]
                first = table[rows, 0]
                a, b = np.searchsorted(first, [table[at, 0] - bits, table[at, 0] + bits + 1])
                if a == b:
                    continue
                _, got = _link(fps, np.full(b - a, at), rows[a:b], table, bits)
                if len(got):
                    left.append(np.full(len(got), at)), right.append(got)
                    rows = rows[~np.isin(rows, got)]
                    front = np.concatenate([front, got])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _edges(bits: int):
    """Streams rows ``(bucket, cell, fp, rep)`` sorted by bucket and cell; a bucket may span batches."""

    def run(batches):
        held = None
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own)]
            n = len(own[0])
            if not n:
                continue
            last = (own[0] == own[0][-1]) & (own[1] == own[1][-1])
            cut = n - int(last.sum())
            held = [c[cut:] for c in own]
            yield from emit([c[:cut] for c in own])
        if held is not None:
            yield from emit(held)

    def emit(own):
        bucket, cell, fp, rep = own
        if not len(fp):
            return
        _, whole = np.unique(np.stack([bucket, cell]), axis=1, return_inverse=True) if cell.any() else (None, bucket)
        a, b = bucket_links(whole.reshape(-1), fp.view(np.uint64), bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return run


def links(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` between representatives of distinct fingerprints ``(fp, rep)`` that span all groups.

    ``blocks`` over ``bits`` grows with the corpus: 6 blocks make 15 keys of
    about 21 bits, 8 make 70 keys of 32 bits.
    """
    if not bits < blocks <= 64:
        raise ValueError("blocks must exceed bits")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    piece = [f"(shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L)" for lo, hi in zip(edges, edges[1:])]
    keys = [
        f"xxhash64({c}, {', '.join(piece[i] for i in chosen)})"
        for c, chosen in enumerate(combinations(range(blocks), blocks - bits))
    ]
    rows = nodes.select("fp", "rep", F.explode(F.expr(f"array({', '.join(keys)})")).alias("bucket"))
    crowded = store(
        rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
        .select("bucket", F.ceil(F.col("n") / hot).cast("int").alias("chunks")), "simhash-crowded")
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.least(c, F.col("chunk")) * F.col("chunks") + F.greatest(c, F.col("chunk")) + 1)
    dealt = (
        rows.join(crowded, "bucket", "left").withColumn("chunk", chunk)
        .withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pair)))
        .select("bucket", "cell", "fp", "rep")
    )
    n = partitions(nodes.sparkSession)
    found = dealt.repartition(n, "bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(
        _edges(bits), "a long, b long")
    return found.distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, blocks: int = BLOCKS, hot: int = HOT,
    width: int = 4, seed: int = 42,
) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row.

    Fingerprints that differ in ``bits`` bits or fewer are linked, and
    ``component_id`` is the smallest key reachable, a row's own included.  Texts
    without words (null, empty, white space) share fingerprint zero and are
    linked like any other.  Repeated rows come back repeated.  Rows with a null
    key belong to a component but never name it (null if it has no other key).
    Only ``key`` and ``text`` are read, so further columns cannot clash.
    """
    rows = store(fingerprints(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")),
                              "key", "text", width, seed), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("key").alias("low")), "fingerprint-nodes")
    # Groups are named by fingerprints first, so that a group of null keys still holds together.
    group = components(links(nodes.select("fp", F.col("fp").alias("rep")), bits, blocks, hot), "simhash")
    named = nodes.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("g", F.coalesce("component", "fp"))
    least = named.groupBy("g").agg(F.min("low").alias("component_id"))
    labels = named.join(least, "g").select("fp", "component_id", "g")
    return rows.join(labels, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.col("g").alias("group_fp"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one of each group: that with the smallest key.

    Of a group without keys, or of repeated rows with the smallest key, any one
    stays.  All columns of ``docs`` are returned under their own names.
    """
    groups = store(near_duplicates(docs, key, text, **how).withColumnRenamed(key, "key"), "simhash-groups")
    heads = groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("group_fp").agg(
        F.min(F.struct("key", "fingerprint")).alias("h")).select("h.key", "h.fingerprint")
    rows = groups.groupBy("key").agg(F.count("*").alias("rows")).withColumnRenamed("key", "k")
    heads = store(heads.join(rows, F.col("key").eqNullSafe(F.col("k"))).drop("k"), "simhash-heads")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    named = whole.withColumn("key", F.col("own")[key].cast("long"))
    once = named.join(heads.filter("rows = 1 AND key IS NOT NULL").select("key"), "key", "left_semi").select("own.*")
    # Keys of several rows, and rows without a key, are told apart by fingerprint.
    more = heads.filter("rows > 1 OR key IS NULL").select(F.col("key").alias("k"), F.col("fingerprint").alias("f"))
    some = named.join(more, F.col("key").eqNullSafe(F.col("k")), "left_semi").select("own", F.col("own")[text].alias("text"))
    some = fingerprints(some, "own", "text", how.get("width", 4), how.get("seed", 42)).select(
        "own", F.col("own")[key].cast("long").alias("key"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))
    some = some.join(more, F.col("key").eqNullSafe(F.col("k")) & (F.col("fingerprint") == F.col("f")), "left_semi")
    return once.unionByName(some.groupBy("key", "fingerprint").agg(F.first("own").alias("own")).select("own.*"))
