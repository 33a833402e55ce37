"""Hard negatives by slots of scores (operator 13).

An anchor's positives have upper limits, and these, from the greatest down, split
the score axis into disjoint slots: above the next limit, up to the own one.  Every
row of another label falls in at most one slot of an anchor.  Tasks keep the best
of each slot, as a combiner does, and one merge over the tasks keeps the best of
all.  The window of a positive reaches from its slot downwards, so merging slots
from the lowest up, best ``k`` at a time, answers all overlapping windows; a
window's lower end then cuts its list.

Anchors meet the table in blocks: anchors of a block are copied to each chunk of
rows and rows to each block, so no task holds more than one block of either.
Positives come from the rows of the anchor's label alone, with as many blocks and
chunks as that label needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import store
from .vectors import NONE, best, block_rows, by_key, integers, matrix, strips

PAIR = "anchor long, anchor_key long, slot int, found long, other long, score long"


def _pairs(asks, data, found):
    """Arrow rows of (ask, slot, data row, score) lists."""
    a, slot, b, score = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    a, b = pa.array(a), pa.array(b)
    return pa.table({
        "anchor": asks["node"].take(a), "anchor_key": asks["key"].take(a), "slot": pa.array(slot.astype(np.int32)),
        "found": data["node"].take(b), "other": data["key"].take(b), "score": pa.array(score)})


def _positives(k: int):
    def run(asks: pa.Table, data: pa.Table) -> pa.Table:
        data, out = by_key(data), []
        if asks.num_rows and data.num_rows:
            for lo, scores in strips(asks, data):
                out += [(r + lo, np.zeros(len(r), np.int64), c, s) for r, c, s in best(scores, k)]
        return _pairs(asks, data, out)

    return run


def _slots(k: int):
    """Best rows of another label in each slot; ``edges`` are an anchor's limits, descending, then what no window reaches."""

    def run(asks: pa.Table, data: pa.Table) -> pa.Table:
        data, out = by_key(data), []
        if asks.num_rows and data.num_rows:
            label, other = asks["label"].to_numpy(), data["label"].to_numpy()
            edges, sizes = matrix(asks["edges"])
            for lo, scores in strips(asks, data):
                hi = lo + len(scores)
                scores[label[lo:hi, None] == other[None, :]] = NONE
                for slot in range(int(sizes[lo:hi].max()) - 1):
                    upper, lower = edges[lo:hi, slot, None], edges[lo:hi, slot + 1, None]
                    inside = (scores <= upper) & (scores > lower) & (slot + 1 < sizes[lo:hi])[:, None]
                    out += [(r + lo, np.full(len(r), slot), c, s) for r, c, s in best(np.where(inside, scores, NONE), k)]
        return _pairs(asks, data, out)

    return run


def _floor(hundredths: Column) -> Column:
    """Whole part of a hundredth, rounded down, in whole numbers."""
    return F.call_function("div", hundredths - F.pmod(hundredths, F.lit(100)), F.lit(100))


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every anchor and slot, numbered."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("other"), "found")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(
    rows: DataFrame, anchors: Column, label: Column, k: int = 5, positives: int = 5, window: tuple[int, int] = (80, 100),
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are its ``positives`` best other rows of its label.  For
    each, the ``k`` best rows of another label whose score is ``window`` percent of
    the positive's score, both ends included (none where that score is below zero
    and the window, thus, empty).  Scores are integer inner products of
    floor(256 * x), higher first, ties by ascending key with null keys last.  Rows with a null label, a null vector or
    one that holds a null or a number that is not finite take no part; vectors
    of different lengths do not meet; rows that share a key are rows of their own,
    and so are positives that share one.  An anchor without positives, or whose
    windows are empty, has no row; an empty table gives an empty result.
    ``anchors`` and ``label`` (a whole number) may use every column.
    """
    low, high = window
    if not 0 <= low <= high:
        raise ValueError("the window must be two percentages in ascending order")
    spark = rows.sparkSession
    own = store(integers(rows.filter(label.isNotNull()), key, vector, label=label.cast("long"),
                         ask=F.coalesce(anchors, F.lit(False))), "negatives-rows")
    total = own.agg(F.count("*").alias("n"), F.count_if("ask").alias("asks")).first()
    if not total["asks"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    block, chunk = block_rows(total["asks"], 8), block_rows(total["n"], 32)

    def dealt(side, parts, other, name, others):
        """Rows of a side with their own part by hash, copied to all parts of the other side."""
        return side.select(*[F.col(c).alias(c) for c in side.columns], F.pmod(F.xxhash64("node"), parts).cast("int").alias(name),
                           F.explode(F.sequence(F.lit(0), other - 1)).alias(others))

    sizes = store(own.groupBy("label").agg(
        F.ceil(F.count_if("ask") / block).cast("int").alias("blocks"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        .filter("blocks > 0"), "negatives-labels")
    sized = own.join(sizes, "label")
    columns, at = ["label", "block", "chunk", "node", "key", "v"], ("label", "block", "chunk")
    asks = dealt(sized.filter("ask"), F.col("blocks"), F.col("chunks"), "block", "chunk").select(columns)
    data = dealt(sized, F.col("chunks"), F.col("blocks"), "chunk", "block").select(columns)
    near = asks.groupBy(*at).cogroup(data.groupBy(*at)).applyInArrow(_positives(positives), PAIR)
    chosen = store(_first(near, positives).select(
        "anchor", "anchor_key", F.col("other").alias("positive_id"), "place", F.col("score").alias("positive_score"),
        _floor(F.col("score") * high).alias("upper"), (-_floor(-F.col("score") * low)).alias("lower")), "negatives-positives")

    limits = chosen.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))
    edged = limits.select(F.col("anchor").alias("node"), F.concat("limits", F.array(
        F.least(F.col("least"), F.element_at("limits", -1)) - 1)).alias("edges"))
    blocks, chunks = -(-total["asks"] // block), -(-total["n"] // chunk)
    asks = dealt(own.filter("ask").join(edged, "node"), F.lit(blocks), F.lit(chunks), "block", "chunk").select(
        "block", "chunk", "node", "key", "v", "label", "edges")
    data = dealt(own, F.lit(chunks), F.lit(blocks), "chunk", "block").select("block", "chunk", "node", "key", "v", "label")
    tops = _first(asks.groupBy("block", "chunk").cogroup(data.groupBy("block", "chunk")).applyInArrow(_slots(k), PAIR), k)
    return _answer(chosen, limits, tops, k)


def _answer(chosen: DataFrame, limits: DataFrame, tops: DataFrame, k: int) -> DataFrame:
    """Suffix merges: ``best[s]`` is the best of slot ``s`` and all below, built from the lowest slot up."""
    entry = "struct<slot:int,place:int,score:bigint,other:bigint>"
    held = tops.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "score", "other"))).alias("held"))

    def merge(done, slot):
        below = F.when(F.size(done) > 0, done[0]).otherwise(F.expr(f"CAST(array() AS array<{entry}>)"))
        return F.concat(F.array(F.slice(F.concat(F.filter("held", lambda e: e["slot"] == slot), below), 1, k)), done)

    best_of = F.aggregate(
        F.sequence(F.size("limits") - 1, F.lit(0), F.lit(-1)), F.expr(f"CAST(array() AS array<array<{entry}>>)"), merge)
    merged = held.join(limits, "anchor").select("anchor", "limits", best_of.alias("best"))
    mine_of = chosen.join(merged, "anchor").withColumn(
        "window", F.filter(F.element_at("best", F.array_position("limits", F.col("upper")).cast("int")),
                           lambda e: (e["score"] >= F.col("lower"))))
    return mine_of.select(
        F.col("anchor_key").alias("anchor_id"), "positive_id", "positive_score", F.posexplode("window").alias("i", "e")).select(
        "anchor_id", "positive_id", (F.col("i") + 1).alias("rank"), F.col("e.other").alias("negative_id"),
        "positive_score", F.col("e.score").alias("negative_score"))
