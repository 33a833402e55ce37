"""Ranked lexical search by pipelined term partitioning (operator 11).

Documents are indexed in shards as they are read: a shard is a bounded run of
documents, and holds one posting list per term.  Query terms have owners, one after
the other from the rarest to the commonest, each with about the same number of
postings.  Bundles of items travel through the owners' stages: each stage cogroups
the bundles' sparse accumulators of a shard (documents touched so far, integer
scores) with the owner's posting lists there, adds the contributions and passes
the accumulators on.  The last stage keeps each item's best of the shard.

A document leaves the accumulators only when its score and all that later owners
can add stay below the k-th score that the item has reached in the shard, which no
result can fall below; so nothing is lost.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, store

STAGES, BUNDLE, SHARD_DOCS, SHARD_BYTES = 4, 256, 8192, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000  # what a term's tf part stays below
#: The same by bytes: whatever of ASCII is no letter or digit parts terms, other bytes belong to one.
FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))
INDEX = "shard long, term string, n long, docs binary, tfs binary, keys array<long>, sizes binary, terms long"


class _Shard:
    """Postings of a run of documents, gathered in memory."""

    def __init__(self):
        self.vocabulary: dict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.keys, self.sizes, self.parts, self.bytes = [], [], [], 0

    def add(self, keys: list, texts: list[bytes]) -> None:
        words = [t.translate(FOLD).split() for t in texts]
        sizes = [len(w) for w in words]
        ids = np.array([self.vocabulary[w] for own in words for w in own], np.int64)
        at = np.repeat(np.arange(len(self.sizes), len(self.sizes) + len(sizes)), sizes)
        self.parts.append(np.unique(ids << 32 | at, return_counts=True))
        self.keys += keys
        self.sizes += sizes
        self.bytes += sum(map(len, texts))

    def rows(self, shard: int):
        """One row per term, and one without a term for the documents themselves."""
        place, tfs = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(place, kind="stable")
        place, tfs = place[order], tfs[order].astype("<u4")
        docs, starts = (place & 0xFFFFFFFF).astype("<u4"), np.flatnonzero(np.diff(place >> 32, prepend=-1))
        n, names = len(starts), list(self.vocabulary)  # terms in the order of their numbers
        ends = np.append(starts, len(place)).astype(np.int64)
        lists = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * 4), pa.py_buffer(v)]).cast(pa.binary())
                 for v in (docs, tfs)]
        yield pa.RecordBatch.from_arrays([
            pa.array([shard] * n, pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.diff(ends)), *lists,
            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=_names)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.array([None], pa.string()), pa.array([sum(s > 0 for s in self.sizes)]), pa.nulls(1, pa.binary()),
            pa.nulls(1, pa.binary()), pa.array([self.keys], pa.list_(pa.int64())),
            pa.array([np.array(self.sizes, "<u4").tobytes()]), pa.array([sum(self.sizes)])], names=_names)


_names = [c.split()[0] for c in INDEX.split(", ")]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", most_docs: int = SHARD_DOCS, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """An inverted index in shards of at most ``most_docs`` documents and, but for the last text, ``most_bytes``.

    Per shard and term: ``n`` documents, their places in the shard and the term's
    occurrences (32-bit little-endian lists).  A row without a term holds the
    shard's document keys, their lengths in terms, the sum of these, and in ``n`` the
    number of documents that have a term.  Every row of ``docs`` is a document of
    its own; null and empty texts have no terms.
    """

    def run(batches):
        held, number, first = _Shard(), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            sizes = [n or 0 for n in pc.binary_length(raw).to_pylist()]
            for lo, hi in slices(sizes):
                for at in range(lo, hi, most_docs):
                    to = min(hi, at + most_docs)
                    if held.sizes and (held.bytes + sum(sizes[at:to]) > most_bytes or len(held.sizes) + to - at > most_docs):
                        yield from held.rows(first + number)
                        held, number = _Shard(), number + 1
                    held.add(batch.column(0).slice(at, to - at).to_pylist(), [t or b"" for t in raw.slice(at, to - at).to_pylist()])
        if held.sizes:
            yield from held.rows(first + number)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, INDEX)


def _stage(k: int, documents: int, terms: int, last: bool):
    """One owner's turn over the accumulators of a bundle and a shard."""

    def run(carried: pa.Table, owned: pa.Table) -> pa.Table:
        scores: dict[int, np.ndarray] = {}
        lists, shard = [], None
        for r in owned.to_pylist():
            if r["term"] is None:
                shard = r
            else:
                lists.append(r)
        # Rows of one shard always come with the shard's own row.
        lengths = np.frombuffer(shard["sizes"], "<u4")
        # In unbounded whole numbers: the product of three counts can pass 64 bits.
        m = np.array([75 + 25 * n * documents // terms for n in lengths.tolist()], np.int64)

        def of(item):
            if item not in scores:
                scores[item] = np.zeros(len(lengths), np.int64)
            return scores[item]

        for item, docs, part in zip(*(carried[c].to_pylist() for c in ("item", "docs", "scores"))):
            of(item)[np.frombuffer(docs, "<u4")] = np.frombuffer(part, "<i8")
        rest: dict[int, int] = {}
        for r in lists:
            docs, tf = np.frombuffer(r["docs"], "<u4"), np.frombuffer(r["tfs"], "<u4").astype(np.int64)
            gain = r["w"] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
            for e in r["items"]:
                of(e["item"])[docs] += e["q"] * gain
                rest[e["item"]] = e["rest"]
        if last:
            return _chosen(scores, shard["keys"], k)
        out = []
        for item, own in scores.items():
            at = np.flatnonzero(own)
            if item in rest and len(at) > k:
                at = at[own[at] + rest[item] >= np.partition(own[at], len(at) - k)[len(at) - k]]
            if len(at):
                out.append((item, at.astype("<u4").tobytes(), own[at].astype("<i8").tobytes()))
        item, docs, part = zip(*out) if out else ((), (), ())
        first = owned.slice(0, 1)
        return pa.table({
            "bundle": pa.array([first["bundle"][0].as_py()] * len(out), pa.int32()), "shard": pa.array([first["shard"][0].as_py()] * len(out), pa.int64()),
            "item": pa.array(item, pa.int64()), "docs": pa.array(docs, pa.binary()), "scores": pa.array(part, pa.binary())})

    return run


def _chosen(scores: dict[int, np.ndarray], keys: list, k: int) -> pa.Table:
    """Each item's ``k`` best documents, of equals that with the smaller key, null keys last."""
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    items, found, best = [], [], []
    for item, own in scores.items():
        at = np.flatnonzero(own)
        if len(at) > k:
            at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((place[at], -own[at]))][:k]
        items += [item] * len(at)
        found += [keys[i] for i in at]
        best += own[at].tolist()
    return pa.table({"item": pa.array(items, pa.int64()), "key": pa.array(found, pa.int64()), "score": pa.array(best, pa.int64())})


def _owners(weighted: DataFrame, stages: int) -> list[int]:
    """Least weight of each owner but the last, from counts per weight class, so that owners have about equal postings."""
    classes = weighted.groupBy((F.col("w") / 100).cast("int").alias("c")).agg(F.sum("df").alias("n")).collect()
    total, held, cuts = sum(r["n"] for r in classes), 0, []
    for r in sorted(classes, key=lambda r: -r["c"]):
        held += r["n"]
        if len(cuts) < stages - 1 and held * stages >= total * (len(cuts) + 1):
            cuts.append(r["c"] * 100)
    return cuts


def rank(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", stages: int = STAGES, bundle: int = BUNDLE, most_docs: int = SHARD_DOCS, most_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item with a score above zero.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower
    case.  N documents with a term, L terms in all, n those of a document:
    weight w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L; the score sums
    w * (10^9 tf div (1000 tf + 12m)) over the item's terms, repeats included, in whole
    numbers.  Equal scores go by ascending key, null keys last.  Null and empty
    texts have no terms and, as items, no rows; rows that share a key are documents
    and items of their own; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    result = f"{item_key} long, rank int, {key} long, score long"
    asked = store(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).cast("long").alias("item_key"),
                               F.col(item_text).cast("string").alias("asked")), "search-items")
    words = store(
        asked.select("item", F.explode(F.regexp_extract_all(F.translate("asked", UPPER, LOWER), F.lit(TERM), 0)).alias("term"))
        .groupBy("item", "term").agg(F.count("*").alias("q")), "search-words")
    wanted = store(words.select(F.col("term").alias("own")).distinct(), "search-terms")
    # A shard's own row meets no term but is dealt by a name that none can have, should this join be shuffled.
    index = postings(docs, key, text, most_docs, most_bytes).withColumn("own", F.coalesce("term", F.concat(F.lit(" "), "shard")))
    index = store(index.join(wanted.withColumn("asked", F.lit(True)), "own", "left").filter("asked OR term IS NULL")
                  .drop("own", "asked"), "search-index")

    shards = index.filter("term IS NULL")
    size = shards.agg(F.sum("n").alias("documents"), F.sum("terms").alias("terms")).first()
    if not size["terms"]:
        return spark.createDataFrame([], result)
    weight = F.floor(1000 * F.log((2.0 * size["documents"] + 2) / (2.0 * F.col("df") + 1)))
    weighted = store(index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df")).withColumn("w", weight), "search-weights")
    cuts = _owners(weighted, stages)
    owner = F.lit(0)
    for c in cuts:
        owner = owner + (F.col("w") < c).cast("int")
    bundles = -(-asked.count() // bundle)
    part = words.join(weighted, "term").withColumn("owner", owner)
    later = Window.partitionBy("item").orderBy(F.desc("owner")).rowsBetween(Window.unboundedPreceding, -1)
    rest = part.groupBy("item", "owner").agg(F.sum(F.col("q") * F.col("w") * UNIT).alias("own")).select(
        "item", "owner", F.coalesce(F.sum("own").over(later), F.lit(0)).alias("rest"))
    plan = store(
        part.join(rest, ["item", "owner"]).withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
        .groupBy("owner", "bundle", "term", "w").agg(F.collect_list(F.struct("item", "q", "rest")).alias("items")), "search-plan")

    carried = spark.createDataFrame([], "bundle int, shard long, item long, docs binary, scores binary")
    shards = shards.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    for turn in range(len(cuts) + 1):
        owned = index.join(plan.filter(F.col("owner") == turn).drop("owner"), "term").select(
            "bundle", "shard", "term", "w", "items", "docs", "tfs", F.lit(None).cast("array<long>").alias("keys"),
            F.lit(None).cast("binary").alias("sizes"))
        owned = owned.unionByName(shards.select("bundle", "shard", "term", "docs", "tfs", "keys", "sizes"), allowMissingColumns=True)
        last = turn == len(cuts)
        carried = carried.groupBy("bundle", "shard").cogroup(owned.groupBy("bundle", "shard")).applyInArrow(
            _stage(k, size["documents"], size["terms"], last),
            "item long, key long, score long" if last else "bundle int, shard long, item long, docs binary, scores binary")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    top = carried.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(asked, "item").select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")
