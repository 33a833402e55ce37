"""Vectors as whole numbers and exact blocks of their inner products (operators 12 and 13)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, MOST_ROWS, STRIP = 256, 65_536, 256
NONE = np.iinfo(np.int64).min  # a pair that does not count


def integers(rows: DataFrame, key: str, vector: str, scale: int = SCALE, **also: Column) -> DataFrame:
    """``(node, key, v, …also)``: rows whose vector takes part, components x as floor(scale * x).

    ``node`` tells rows apart, also those that share a key; it is settled once the
    table is stored.  Null vectors and those that hold a null, NaN or infinity
    take no part.  A component of 2^62 or more after scaling raises.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda c: F.when(
        F.abs(c * scale) < 2.0**62, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to scale"))))
    return rows.filter(sound).select(
        F.monotonically_increasing_id().alias("node"), F.col(key).cast("long").alias("key"),
        whole.cast("array<long>").alias("v"), *[c.alias(name) for name, c in also.items()])


def block_rows(n: int, factor: int) -> int:
    """Rows in a block: grows with the root of the table, so that neither side of a block join is copied too often."""
    return int(min(MOST_ROWS, max(64, math.ceil(factor * math.sqrt(n)))))


def matrix(lists: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of one array, filled up with zeros, and their lengths."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``; those that may reach 2^56 raise."""
    a, b = (np.pad(m, ((0, 0), (0, max(a.shape[1], b.shape[1]) - m.shape[1]))) for m in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2.0**56:
        raise OverflowError("inner products of these vectors may not fit")
    if most < 2.0**53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each row's ``k`` greatest, one of each row at a time: (row, column, score); of equals the earlier column.

    ``scores`` is used up.
    """
    rows = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        column = scores.argmax(axis=1)
        top = scores[rows, column]
        some = top != NONE
        if not some.any():
            return
        yield rows[some], column[some], top[some]
        scores[rows, column] = NONE


def by_key(table: pa.Table) -> pa.Table:
    """Rows in ascending key order, null keys last."""
    return table.take(pc.sort_indices(table, sort_keys=[("key", "ascending")], null_placement="at_end"))


def strips(asks: pa.Table, data: pa.Table):
    """Blocks of scores of some asks with all data: (first ask, scores); own rows and other lengths do not count."""
    a, a_sizes = matrix(asks["v"])
    b, b_sizes = matrix(data["v"])
    own, node = asks["node"].to_numpy(), data["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    for lo in range(0, len(a), STRIP):
        hi = min(len(a), lo + STRIP)
        scores = products(a[lo:hi], b)
        scores[a_sizes[lo:hi, None] != b_sizes[None, :]] = NONE
        at = np.searchsorted(node, own[lo:hi], sorter=order)
        found = at < len(node)
        found[found] = node[order[at[found]]] == own[lo:hi][found]
        scores[np.flatnonzero(found), order[at[found]]] = NONE
        yield lo, scores
