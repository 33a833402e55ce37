"""Near-duplicate vectors by collision counts over one-dimensional projections (operator 6).

Projections of unit vectors on Gaussian directions differ, for a pair of given
cosine, by a normal amount of known spread.  So the share of projections in
which a window around one vector holds the other is binomial with a known rate,
and the least count that a pair must reach is set from the recall wanted.

Every table sorts the vectors of a label by one projection inside coarse cells (the
signs of a few others).  Inside a cell, windows around each vector in sorted
order give the pairs whose collisions are counted over the counting projections;
pairs that reach the count are verified by their cosine.  The number of signs
grows with the logarithm of a label's size and the number of tables with it, so
that a cell holds a few hundred vectors and the recall stays.  A pair is counted
in the first table where it meets, so no pairs are shuffled; a cell yields link
counts and links that span its groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, partitions, store

COSINE, RECALL, CELL, HOT, COUNTING, SEED = 0.98, 0.999999, 256, 3000, 32, 20_240_601


class Plan:
    """Windows, counts and directions for a cosine and a recall; the same in every task."""

    def __init__(self, cosine: float, recall: float, counting: int = COUNTING, seed: int = SEED):
        self.cosine, self.recall, self.counting, self.seed = cosine, recall, counting, seed
        self.spread = math.sqrt(2 - 2 * cosine)  # of a projection's difference, for a pair at the threshold
        self.window = 2.0 * self.spread
        self.rate = math.erf(2.0 / math.sqrt(2))
        miss, tail, least = (1 - recall) / 2, 0.0, 0
        for i in range(counting + 1):
            tail += math.comb(counting, i) * self.rate**i * (1 - self.rate) ** (counting - i)
            if tail > miss:
                least = i
                break
        self.least = least
        self.same_sign = 1 - math.acos(cosine) / math.pi
        self._directions: dict = {}

    def tables(self, signs: int) -> int:
        """Tables after which a pair at the threshold has met in one, up to half the misses allowed."""
        meet = self.same_sign**signs * self.rate
        return max(1, math.ceil(math.log((1 - self.recall) / 2) / math.log1p(-meet)))

    def directions(self, dim: int, signs: int):
        key = dim, signs
        if key not in self._directions:
            n, rng = self.tables(signs), np.random.RandomState(self.seed)
            self._directions[key] = (
                rng.standard_normal((dim, self.counting)), rng.standard_normal((dim, n)),
                rng.standard_normal((dim, n * signs)))
        return self._directions[key]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _deal(plan: Plan):
    """One row per vector and table: its cell there, its cells and sorting projections everywhere."""

    def run(batches):
        for batch in batches:
            dims, signs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for dim, k in sorted(set(zip(dims.tolist(), signs.tolist()))):
                part = batch.filter(pa.array((dims == dim) & (signs == k)))
                for lo in range(0, part.num_rows, 512):
                    rows = part.slice(lo, 512)
                    n, (_, sort, coarse) = rows.num_rows, plan.directions(dim, k)
                    x = unit(_matrix(rows.column(5), dim))
                    tables = sort.shape[1]
                    place = x @ sort
                    bits = ((x @ coarse) > 0).reshape(n, tables, k)
                    cells = (bits * (np.int64(1) << np.arange(k, dtype=np.int64))).sum(axis=2, dtype=np.int64)
                    again = rows.take(pa.array(np.repeat(np.arange(n), tables)))
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), tables).cast(pa.list_(t)).take(
                        pa.array(np.repeat(np.arange(n), tables))) for v, t in ((cells, pa.int64()), (place, pa.float64()))]
                    yield pa.RecordBatch.from_arrays(
                        [*again.columns, pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                         pa.array(cells.reshape(-1)), *lists],
                        names=["node", "family", "dim", "signs", "copies", "vector", "t", "cell", "cells", "places"])

    return run


def _compare(rows: pa.Table, plan: Plan):
    """Link counts and spanning links of one cell's vectors (sorted here by the table's projection)."""
    dim, t = rows["dim"][0].as_py(), rows["t"][0].as_py()
    signs, chunks = rows["signs"][0].as_py(), rows["chunk"].to_numpy()
    places = _matrix(rows["places"].combine_chunks(), plan.tables(signs))
    order = np.argsort(places[:, t], kind="stable")
    places, chunks = places[order], chunks[order]
    cells = rows["cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
    x = _matrix(rows["vector"].combine_chunks(), dim)[order]
    size = np.sqrt((x * x).sum(axis=1))
    marks = (x / size[:, None]) @ plan.directions(dim, signs)[0]
    node, copies = rows["node"].to_numpy()[order], rows["copies"].to_numpy()[order]
    mixed = chunks.min() != chunks.max()
    n, count, group = len(order), np.zeros(len(order), np.int64), np.arange(len(order))

    def head(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    at = places[:, t]
    for lo in range(0, n, 128):
        hi = min(n, lo + 128)
        end = int(np.searchsorted(at, at[hi - 1] + plan.window, "right"))
        for start in range(lo, end, 2048):
            stop = min(end, start + 2048)
            i, j = np.nonzero(
                (np.arange(lo, hi)[:, None] < np.arange(start, stop)[None, :])
                & (np.abs(at[lo:hi, None] - at[None, start:stop]) <= plan.window))
            i, j = i + lo, j + start
            if mixed:
                cross = chunks[i] != chunks[j]
                i, j = i[cross], j[cross]
            left, seen = np.arange(len(i)), np.zeros(len(i), np.int16)
            for m in range(0, plan.counting, 8):  # a pair leaves once it can no longer reach the count
                near = np.abs(marks[i[left], m:m + 8] - marks[j[left], m:m + 8]) <= plan.window
                seen[left] += near.sum(axis=1, dtype=np.int16)
                left = left[seen[left] + plan.counting - m - near.shape[1] >= plan.least]
            i, j = i[left], j[left]
            near = np.einsum("ij,ij->i", x[i], x[j]) / (size[i] * size[j]) >= plan.cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            before = ((cells[i, :t] == cells[j, :t]) & (np.abs(places[i, :t] - places[j, :t]) <= plan.window)).any(axis=1)
            a, b = i[~before], j[~before]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            first = np.unique(i, return_index=True)[1]
            for p, q in zip(np.split(i, first[1:]), np.split(j, first[1:])):
                p = head(p[0])
                for r in np.unique(group[q]):
                    r = head(r)
                    if r != p:
                        group[max(p, r)], p = min(p, r), min(p, r)
    linked = np.array([head(k) for k in range(n)])
    out = np.flatnonzero(linked != np.arange(n))
    some = np.flatnonzero(count)
    return (np.concatenate([node[out], node[some]]),
            np.concatenate([node[linked[out]], np.full(len(some), -1)]),
            np.concatenate([np.zeros(len(out), np.int64), count[some]]))


def _cells(plan: Plan):
    """Streams rows sorted by cell; yields ``(a, b, n)``: a link when ``b >= 0``, else ``n`` links of ``a``."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            key = [table[c].to_numpy() for c in ("bucket", "pair")]
            cuts = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1:
                    yield from emit(table.slice(lo, hi - lo))
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows > 1:
            yield from emit(held)

    def emit(rows):
        a, b, n = _compare(rows, plan)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    return run


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = COSINE, recall: float = RECALL, hot: int = HOT,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Rows of one non-null label link at ``cosine`` or more, by double arithmetic
    on the given numbers; never below.  A pair at the threshold is found with
    probability ``recall`` or more, a closer one with more.  ``n_links`` counts
    other rows; equal vectors count, and are compared once.  Null vectors, those
    of zeros only, and those that hold a null or a number that is not finite link
    with nothing, as do vectors of different lengths.  ``component_id`` is the
    smallest key reachable, and ``kept`` tells whether that is the row's own (rows
    with a null key are never kept, unless they are alone).  A cell with more than
    ``hot`` vectors is cut to chunks, and each pair of chunks is a task's work.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    plan, spark = Plan(cosine, recall), rows.sparkSession
    v = F.col("vector")
    sound = F.coalesce(
        F.col("family").isNotNull() & (F.size(v) > 0) & F.exists(v, lambda c: c != 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("family"),
                      F.col(vector).cast("array<double>").alias("vector")).withColumn("sound", sound)
    nodes = store(
        own.filter("sound").groupBy("family", "vector").agg(F.count("*").alias("copies"), F.min("key").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = store(
        nodes.groupBy("family", F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
        .withColumn("signs", F.greatest(F.lit(0), F.least(F.lit(48), F.ceil(F.log2(F.col("n") / CELL)))).cast("int")),
        "vector-families")
    shaped = nodes.withColumn("dim", F.size("vector")).join(sizes, ["family", "dim"]).select(
        "node", F.xxhash64("family").alias("family"), "dim", "signs", "copies", "vector")
    dealt = shaped.mapInArrow(
        _deal(plan), "node long, family long, dim int, signs int, copies long, vector array<double>, t int, cell long, "
        "cells array<long>, places array<double>").withColumn("bucket", F.xxhash64("family", "dim", "t", "cell"))
    crowded = store(
        shaped.select("node", "family", "dim", "signs", "copies", "vector").mapInArrow(_only_cells(plan), "family long, dim int, t int, cell long")
        .groupBy(F.xxhash64("family", "dim", "t", "cell").alias("bucket")).agg(F.count("*").alias("n"))
        .filter(F.col("n") > hot).select("bucket", F.ceil(F.col("n") / hot).cast("int").alias("chunks")), "vector-crowded")
    chunk = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.least(c, F.col("chunk")) * F.col("chunks") + F.greatest(c, F.col("chunk")) + 1)
    cells = dealt.join(crowded, "bucket", "left").withColumn("chunk", chunk).withColumn(
        "pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pair)))
    found = store(
        cells.select("bucket", "pair", "chunk", "node", "dim", "signs", "copies", "vector", "t", "cells", "places")
        .repartition(partitions(spark), "bucket", "pair").sortWithinPartitions("bucket", "pair")
        .mapInArrow(_cells(plan), "a long, b long, n long"), "vector-links")
    group = components(found.filter("b >= 0").select("a", "b").distinct(), "vectors")
    counts = found.filter("b < 0").groupBy("a").agg(F.sum("n").alias("links"))
    named = nodes.join(counts, nodes["node"] == counts["a"], "left").join(
        group.withColumnRenamed("node", "other"), F.col("node") == F.col("other"), "left").select(
        "family", "vector", "low", F.coalesce("component", "node").alias("g"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    least = named.groupBy("g").agg(F.min("low").alias("least"))
    labels = named.join(least, "g").select("family", "vector", "links", "least")
    linked = own.filter("sound").drop("sound").join(labels, ["family", "vector"]).select("key", "links", "least")
    alone = own.filter("NOT sound").select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("least"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), F.col("links").alias("n_links"), F.col("least").alias("component_id"),
        F.col("key").eqNullSafe(F.col("least")).alias("kept"))


def _only_cells(plan: Plan):
    deal = _deal(plan)

    def run(batches):
        for batch in deal(batches):
            yield batch.select(["family", "dim", "t", "cell"])

    return run
