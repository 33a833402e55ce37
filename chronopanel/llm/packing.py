"""Best-fit packing with certified bin counts (operator 3).

Items are dealt at random over groups of bounded size.  Every group packs best
fit, largest first, and computes a lower bound on its bins from dual-feasible
functions.  While all bins together exceed the bound of all items, groups give
up the bins that have room; whole bins move to new, fewer groups, which pack
again and keep the better of the two packings, so the count never rises.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import store


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every item, best fit decreasing; bins by remaining room in one bit set."""
    bins = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            at = size + ((fits & -fits).bit_length() - 1)
            b = room[at].pop()
            if not room[at]:
                free &= ~(1 << at)
        else:
            at, b = capacity, made
            made += 1
        bins[i] = b
        left = at - size
        if left:
            room[left].append(b)
            free |= 1 << left
    return bins


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from three families of dual-feasible functions.

    ``histogram[s]`` items have size ``s``.  Threshold functions count large
    items as whole bins and drop small ones; rounding functions round
    ``(k + 1) s / capacity`` down; the last family does so around one half.
    """
    s = np.arange(capacity + 1, dtype=np.int64)
    n = histogram.astype(np.int64)
    best = -(-int((n * s).sum()) // capacity)
    count, total = np.cumsum(n), np.cumsum(n * s)
    cut = np.arange(0, capacity // 2 + 1)
    below = np.where(cut > 0, total[np.maximum(cut - 1, 0)], 0)
    value = (total[capacity - cut] - below) + capacity * (count[-1] - count[capacity - cut])
    best = max(best, int(-(-value // capacity).max()) if len(value) else 0)
    for k in range(1, 101):
        whole = (k + 1) * s % capacity == 0
        value = np.where(whole, s * k, (k + 1) * s // capacity * capacity)  # times capacity * k
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    for cut in {*range(1, min(65, capacity // 2 + 1)), *(capacity // d for d in range(3, 65) if capacity // d)}:
        top = capacity // cut
        value = np.where(2 * s > capacity, 2 * (top - (capacity - s) // cut), np.where(2 * s == capacity, top, 2 * (s // cut)))
        best = max(best, -(-int((n * value).sum()) // (2 * top)))
    return best


def _packer(capacity: int, turn: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        sizes = rows["size"].to_numpy()
        bins = best_fit(sizes, capacity)
        if turn:
            old, held = np.unique(rows["bin"].to_numpy(), return_inverse=True)
            if bins.max() + 1 >= len(old):
                bins = held
        order = np.lexsort((-sizes, bins))
        own, size = bins[order], sizes[order]
        ends = np.cumsum(size)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        members = np.diff(np.append(first, len(own)))
        fill = np.bincount(bins, sizes).astype(np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        name = (np.int64(turn) << 56) | (rows["cell"].to_numpy().astype(np.int64) << 32)
        out = rows.take(pa.array(order))
        return out.set_column(out.schema.get_field_index("bin"), "bin", pa.array(name[order] | own)).append_column(
            "offset", pa.array(ends - size - np.repeat((ends - size)[first], members))).append_column(
            "fill", pa.array(fill[own])).append_column("bound", pa.array(np.full(len(own), bound)))

    return pack


def pack(
    items: DataFrame, size: str = "length", capacity: int = 2048, group: int = 100_000, most_rounds: int = 8,
    by: str | None = None,
) -> tuple[DataFrame, dict]:
    """Place every item: its columns and ``sequence_id``, ``offset``; and the certificate.

    ``group`` bounds the items one task packs.  The certificate holds the bins
    used, the lower bound of all items, and per round the groups, those whose own
    bound certifies them, and the bins.  Sizes are 1 to ``capacity``, else an error
    is raised.  Equal items are told apart, so repeated rows are all packed.  An
    empty table gives an empty packing.  The names ``item``, ``size``, ``kind``, ``cell``,
    ``bin``, ``fill`` and ``bound`` may occur among the columns of ``items``: these
    travel in a struct.  With ``by``, items that differ in that column (a language, say:
    few values; null is one) never share a sequence, and the bound is the sum over its values.
    """
    capacity_error = F.raise_error(F.lit(f"sizes must be whole numbers from 1 to {capacity}"))
    rows = store(
        items.select(
            F.struct("*").alias("own"),
            F.when(F.col(size).between(1, capacity), F.col(size).cast("long")).otherwise(capacity_error).alias("size"),
            F.monotonically_increasing_id().alias("item"),
            (F.lit(None) if by is None else F.col(by)).cast("string").alias("kind"),
        ), "pack-items")
    sizes: dict[str | None, np.ndarray] = {}
    for r in rows.groupBy("kind", "size").count().collect():  # one row per kind and size
        sizes.setdefault(r[0], np.zeros(capacity + 1, np.int64))[r[1]] = r[2]
    certificate = {
        "bins": sum(int(c[capacity]) for c in sizes.values()), "bound": sum(lower_bound(c, capacity) for c in sizes.values()), "rounds": []}
    alone = rows.filter(F.col("size") == capacity).select(
        "own", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = rows.filter(F.col("size") < capacity).withColumn("bin", F.col("item"))
    left, done = {k: int(c[:capacity].sum()) for k, c in sizes.items()}, [alone]
    shape = T.StructType([
        *loose.schema.fields, T.StructField("cell", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("fill", T.LongType()), T.StructField("bound", T.LongType())])
    quiet, last = 0, None
    for turn in range(most_rounds):
        left = {k: n for k, n in left.items() if n}
        if not left:
            break
        # Every kind has cells of its own.
        cell, before = F.lit(None).cast("long"), 0
        for k, n in left.items():
            groups = -(-n // group)
            cell = F.when(F.col("kind").eqNullSafe(F.lit(k)), before + F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups))).otherwise(cell)
            before += groups
        dealt = loose.withColumn("cell", cell)
        packed = store(dealt.groupBy("cell").applyInArrow(_packer(capacity, turn), shape), f"packed-{turn}")
        seen = packed.groupBy("kind", "cell", "bin", "fill", "bound").agg(F.count("*").alias("n"))
        per = seen.groupBy("cell").agg(F.count("*").alias("bins"), F.first("bound").alias("bound"))
        total = per.agg(F.sum("bins"), F.sum((F.col("bins") == F.col("bound")).cast("int")), F.count("*")).first()
        full = {r[0]: r for r in seen.filter(F.col("fill") == capacity).groupBy("kind").agg(F.count("*"), F.sum("n")).collect()}
        bins = certificate["bins"] + total[0]
        certificate["rounds"].append({"groups": total[2], "certified": total[1], "bins": bins})
        quiet = quiet + 1 if last == bins else 0
        ended = bins == certificate["bound"] or total[2] == len(left) or quiet == 2 or turn == most_rounds - 1
        last = bins
        closed = packed if ended else packed.filter(F.col("fill") == capacity)
        done.append(closed.select("own", F.col("bin").alias("sequence_id"), "offset"))
        if ended:
            certificate["bins"] = bins
            break
        certificate["bins"] += sum(r[1] for r in full.values())
        loose = packed.filter(F.col("fill") < capacity).select(*loose.columns)
        left = {k: n - (full[k][2] if k in full else 0) for k, n in left.items()}
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("own.*", "sequence_id", "offset"), certificate


def pieces(encoded: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """Cut ``(key, n_tokens, ids)`` to pieces of at most ``capacity``; of a cut document only the first may be shorter."""
    k = F.ceil(F.col("n_tokens") / capacity).cast("int")
    first = F.col("n_tokens") - (F.col("k") - 1) * capacity
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(first + (F.col("piece") - 1) * capacity).cast("long")
    length = F.when(F.col("piece") == 0, first).otherwise(F.lit(capacity)).cast("long")
    return (
        encoded.withColumn("k", k).filter("k > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("start", start).withColumn("length", length)
        .withColumn("ids", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))"))
        .select(key, "piece", "start", "length", "ids")
    )
