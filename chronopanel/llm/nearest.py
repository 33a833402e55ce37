"""Exact top-k by inner product as a Voronoi join (operator 12).

One more component, sqrt(M^2 - |v|^2) with M the greatest length of the table (zero
for a query), makes the order by inner product the order by distance, so the
triangle inequality holds.  Data and queries go to the cell of their nearest
pivot, a row drawn by hash.  From the summaries of the cells, the k + 1 least
distances to each pivot, every query gets a bound on the distance of its k-th
neighbour: some k + 1 rows are at most (query to pivot) + (pivot to row) away, one
of which may be the query itself.  A group of queries needs a row of a cell only
if the row's distance to the pivot lies within the group's interval there; only
such rows are copied to the group, dealt to chunks, and solved there.

Groups hold whole neighbouring cells, or a share of a crowded one.  The sizes of
groups and chunks grow with the root of their side, up to a fixed size, so a task
holds a bounded block whatever the table and whatever one cell holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import store
from .vectors import best, block_rows, by_key, integers, matrix, strips

PIVOTS, SEED = 128, 12


class Cells:
    """Pivots and the greatest length of the table's vectors: all that a task needs to measure distances."""

    def __init__(self, pivots: np.ndarray, greatest: float):
        self.pivots, self.most = pivots.astype(np.float64), greatest
        self.lifts = np.sqrt(np.maximum(0, greatest - (self.pivots**2).sum(axis=1)))
        self.slack = np.sqrt(greatest * (pivots.shape[1] + 8) * 2.0**-48)  # above the rounding of any distance

    def distances(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """Rows by pivots; a query has no last component, a data row has its own."""
        x = x.astype(np.float64)
        width = max(x.shape[1], self.pivots.shape[1])
        x, pivots = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.pivots))
        length, cross = (x**2).sum(axis=1), x @ pivots.T
        if queries:
            square = length[:, None] + self.most - 2 * cross
        else:
            lift = np.sqrt(np.maximum(0, self.most - length))
            square = 2 * (self.most - cross - lift[:, None] * self.lifts)
        return np.sqrt(np.maximum(0, square))


def _assign(cells: Cells):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x, _ = matrix(part.column(2))
                far = cells.distances(x, False)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                    names=["node", "key", "v", "ask", "cell", "far"])

    return run


def _bound(cells: Cells, least: np.ndarray, width: int, k: int):
    """Per query its nearest pivot and, for each pivot, the interval in which needed rows lie; ``least`` is inf-filled."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, sizes = matrix(part.column(2))
                far = cells.distances(x, True)
                reach = (far[:, :, None] + least[None]).reshape(len(far), -1)
                bound = np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k else np.full(len(far), np.inf)
                bound = np.where(sizes == width, bound, np.inf)[:, None] + cells.slack
                ends = [pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), far.shape[1]).cast(pa.list_(pa.float64()))
                        for m in (far - bound, far + bound)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(far.argmin(axis=1).astype(np.int32)), *ends],
                    names=["node", "key", "v", "cell", "low", "high"])

    return run


def grouped(counts: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """Cell: (first group, number of groups).  Neighbouring cells share a group of at most ``most`` queries."""
    out, group, held, left = {}, 0, 0, sorted(counts)
    at = left[0] if left else None
    while left:
        at = min(left, key=lambda j: (((pivots[j] - pivots[at]) ** 2).sum(), j))
        left.remove(at)
        n = counts[at]
        if n > most:
            group, held = group + bool(held), 0
            out[at] = group, -(-n // most)
            group += out[at][1]
            continue
        if held and held + n > most:
            group, held = group + 1, 0
        out[at], held = (group, 1), held + n
    return out


def _solve(k: int):
    def run(asks: pa.Table, data: pa.Table) -> pa.Table:
        data = by_key(data)
        rows, columns, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asks.num_rows and data.num_rows:
            for lo, block in strips(asks, data):
                for r, c, s in best(block, k):
                    rows.append(r + lo)
                    columns.append(c)
                    scores.append(s)
        r, c = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
        return pa.table({"ask": asks["node"].take(r), "query": asks["key"].take(r), "found": data["key"].take(c),
                         "score": pa.array(np.concatenate(scores))})

    return run


def top_k(rows: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, <key>, score)``: for every row of ``asks`` the ``k`` rows of greatest inner product, itself left out.

    Components x count as floor(256 * x); scores are exact, equal scores by ascending
    key with null keys last.  Fewer rows than ``k`` give fewer ranks.  Null vectors
    and those that hold a null or a number that is not finite take no part, as
    query or as candidate; vectors of different lengths do not meet; rows that
    share a key or a vector are rows of their own.  An empty table gives an empty
    result.  The clause ``asks`` may use every column; null means no query.
    """
    spark = rows.sparkSession
    own = store(integers(rows, key, vector, ask=F.coalesce(asks, F.lit(False))), "nearest-rows")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = own.agg(F.count("*").alias("n"), F.count_if("ask").alias("asks"), F.max(length).alias("greatest"),
                    F.max(F.size("v")).alias("width")).first()
    result = f"query_id long, rank int, {key} long, score long"
    if not shape["asks"]:
        return spark.createDataFrame([], result)
    drawn = own.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(pivots).select("v").collect()
    centres = np.zeros((len(drawn), shape["width"]), np.int64)
    for i, r in enumerate(drawn):
        centres[i, :len(r["v"])] = r["v"]
    cells = Cells(centres, shape["greatest"])
    data = store(own.mapInArrow(
        _assign(cells), "node long, key long, v array<long>, ask boolean, cell int, far double"), "nearest-cells")

    summary = data.filter(F.size("v") == shape["width"]).select("cell", "far", F.row_number().over(
        Window.partitionBy("cell").orderBy("far")).alias("i")).filter(F.col("i") <= k + 1).collect()
    least = np.full((len(drawn), k + 1), np.inf)
    for r in summary:
        least[r["cell"], r["i"] - 1] = r["far"]
    queries = store(data.filter("ask").select("node", "key", "v").mapInArrow(
        _bound(cells, least, shape["width"], k), "node long, key long, v array<long>, cell int, low array<double>, high array<double>"),
        "nearest-queries")

    counts = {r["cell"]: r["count"] for r in queries.groupBy("cell").count().collect()}
    deal = grouped(counts, cells.pivots, block_rows(shape["asks"], 8))
    first, share = (F.element_at(F.array([F.lit(deal.get(j, (0, 1))[i]) for j in range(len(drawn))]), F.col("cell") + 1) for i in (0, 1))
    queries = queries.withColumn("group", (first + F.pmod(F.xxhash64("node"), share)).cast("int"))
    bounds = store(
        queries.select("group", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "ends"))
        .groupBy("group", "cell").agg(F.min("ends.low").alias("low"), F.max("ends.high").alias("high")), "nearest-bounds")

    chunks = -(-shape["n"] // block_rows(shape["n"], 32))
    needed = data.join(bounds, "cell").filter(F.col("far").between(F.col("low"), F.col("high"))).select(
        "group", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int").alias("chunk"), "node", "key", "v")
    sent = queries.select("group", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "node", "key", "v")
    solved = sent.groupBy("group", "chunk").cogroup(needed.groupBy("group", "chunk")).applyInArrow(
        _solve(k), "ask long, query long, found long, score long")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("found")))
    return solved.withColumn("rank", place).filter(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("found").alias(key), "score")
