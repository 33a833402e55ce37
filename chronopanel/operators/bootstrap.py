"""Block-bootstrap intervals from per-block sufficient statistics.

No row is ever replicated: each block shrinks to a handful of sums, and a statistic
is a formula over their weighted totals.  Resampling is a matrix product: tasks
multiply the weights of their blocks (resamples x blocks) with the blocks' sums, so
one row per resample, group and task leaves them.  Draws come from a hash of
(seed, resample, slot or block), so a retried task draws the same blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import md5
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import BootstrapContract
from ..schema import CLASSES, ENTITY, PERIOD
from .metrics import accuracy, balanced_accuracy, class_counts, error, macro_f1
from ..session import land
from .quantiles import _holds, _null_safe, _spans, attach, exact_median

BLOCKS = {"county": ENTITY, "month": PERIOD}


@dataclass(frozen=True)
class Statistic:
    """``sums``: aggregates over rows that add up over blocks, by name; ``finish``: the figure, from columns of these names."""

    sums: dict[str, Callable[[], Column]]
    finish: Callable[[], Column]


def _counted(name: str, at: int) -> tuple[str, Callable[[], Column]]:
    return name, lambda: class_counts()[at]


_ERRORS = {
    "_n_mag": lambda: F.count(error()), "_abs": lambda: F.coalesce(F.sum(F.abs(error())), F.lit(0.0)),
    "_err": lambda: F.coalesce(F.sum(error()), F.lit(0.0)), "_sq": lambda: F.coalesce(F.sum(error() * error()), F.lit(0.0)),
}
_COUNTS = dict(_counted(n, i) for i, n in enumerate(["_n_dir"] + [f"_{part}_{c}" for c in CLASSES for part in ("tp", "pred", "act")]))


def _of(*names: str) -> dict:
    return {n: _ERRORS[n] for n in names}


STATISTICS: dict[str, Statistic] = {
    "mae": Statistic(_of("_n_mag", "_abs"), lambda: F.try_divide(F.col("_abs"), F.col("_n_mag"))),
    "rmse": Statistic(_of("_n_mag", "_sq"), lambda: F.sqrt(F.try_divide(F.col("_sq"), F.col("_n_mag")))),
    "mean_error": Statistic(_of("_n_mag", "_err"), lambda: F.try_divide(F.col("_err"), F.col("_n_mag"))),
    "accuracy": Statistic(_COUNTS, accuracy), "macro_f1": Statistic(_COUNTS, macro_f1), "balanced_accuracy": Statistic(_COUNTS, balanced_accuracy),
}
# Not a formula over sums; see ``_median_values``.
MEDIAN = "medae"


def register_statistic(name: str, sums: dict[str, Callable[[], Column]], finish: Callable[[], Column]) -> None:
    """Let intervals and paired differences use another statistic, given by what adds up over rows and how that is read.

    A correlation, say, has the sums of x, y, their squares and their product.  Names
    of sums are shared: the same name must mean the same aggregate everywhere.
    """
    if name == MEDIAN or name in STATISTICS:
        raise ValueError(f"statistic {name!r} is registered already")
    STATISTICS[name] = Statistic(dict(sums), finish)


def _statistic(name: str) -> Statistic:
    if name not in STATISTICS:
        raise KeyError(f"unknown metric {name!r}; choose one of {', '.join(sorted([*STATISTICS, MEDIAN]))}")
    return STATISTICS[name]


def _sums(metrics) -> dict[str, Callable[[], Column]]:
    return {n: c for m in metrics if m != MEDIAN for n, c in _statistic(m).sums.items()}


def block_column(block: str) -> str:
    if block not in BLOCKS:
        raise KeyError(f"unknown block {block!r}; choose one of {', '.join(sorted(BLOCKS))}")
    return BLOCKS[block]


def block_stats(df: DataFrame, keys: list[str], block: str, metrics=tuple(STATISTICS)) -> DataFrame:
    """One row of additive sums, as doubles, per (keys, block)."""
    rows = df.groupBy(*keys, F.col(block_column(block)).cast("string").alias("block_key"))
    sums = [c().cast("double").alias(n) for n, c in _sums(metrics).items()]
    return rows.agg(*(sums or [F.count(F.lit(1)).alias("_rows")]))


def _hash32(*parts: Column) -> Column:
    """Unsigned 32-bit integer from the text of its arguments."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# Shifts and multipliers of a published 32-bit integer hash.
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is named."""
    return F.transform(F.array(x), use)[0]


def _mixed(x: Column) -> Column:
    """Hash of an unsigned 32-bit integer; products are taken in halves, so that they fit a long."""

    def folded(shift: int):
        return lambda y: y.bitwiseXOR(F.shiftright(y, shift))

    def times(factor: int):
        return lambda y: ((y * (factor >> 16)).bitwiseAND(0xFFFF) * 65536 + y * (factor & 0xFFFF)).bitwiseAND(0xFFFFFFFF)

    for shift, factor in MIX:
        x = _bound(x, folded(shift))
        x = _bound(x, times(factor)) if factor else x
    return x


def mixed(x: np.ndarray) -> np.ndarray:
    """The same on arrays."""
    x = x.astype(np.uint32)
    for shift, factor in MIX:
        x ^= x >> np.uint32(shift)
        if factor:
            x *= np.uint32(factor)
    return x


def _poisson_bounds() -> list[int]:
    """32-bit integers below the k-th bound, but not below one before, stand for k draws of a block."""
    bounds, cdf = [], 0.0
    while not bounds or bounds[-1] < 2**32 - 1:
        cdf += math.exp(-1.0) / math.factorial(len(bounds))
        bounds.append(min(int(cdf * 2**32), 2**32))
    return bounds


class Weights(NamedTuple):
    """How often a resample draws a block."""

    expand: Callable[[DataFrame], DataFrame]  # adds every (resample, weight) to rows with a block
    cells: Callable[[DataFrame, list[str], DataFrame | None], DataFrame]  # counts per (own keys, block, bin) to weighted ones, see ``_asked``
    totals: Callable[[DataFrame, list[str]], DataFrame]  # block sums to weighted sums per (keys, resample)


SPREAD = 200  # tasks that draw; without a number adaptive execution would join so few rows into one task, which then makes all draws
CHUNK = 1024  # blocks whose weights a product holds at a time
HELD = 64  # groups whose products a task holds at a time
DRAWS = 1 << 20  # slots of a resample drawn at a time


def _group_rows(own: list, acc: dict, sums: list[str]):
    """Arrow rows (own, resample, sums) of the products gathered for some groups."""
    names, products = list(acc), list(acc.values())
    n = len(products[0])
    place = pa.array(np.repeat(np.arange(len(names)), n))
    flat = np.concatenate(products)
    return pa.array([own[k] for k in names]).take(place), np.tile(np.arange(n, dtype=np.int32), len(names)), [flat[:, i] for i in range(len(sums))]


def _name(keys: list[str]) -> Column:
    """A group's name: its keys as JSON, which keeps null keys apart from texts."""
    return F.to_json(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")), {"ignoreNullFields": "false"}).alias("own")


def _named(products: DataFrame, stats: DataFrame, keys: list[str], *more: str) -> DataFrame:
    shape = T.StructType([stats.schema[k] for k in keys] + [T.StructField("_", T.IntegerType())])
    return products.withColumn("_own", F.from_json("own", shape)).select(*[F.col("_own")[k].alias(k) for k in keys], "resample", *more)


def _pack(stats: DataFrame, keys: list[str], sums: list[str], *more: Column) -> DataFrame:
    return stats.select(_name(keys), F.array(*[F.col(c) for c in sums]).alias("s"), *more)


def _unpack(products: DataFrame, stats: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return _named(products.groupBy("own", "resample").agg(*[F.sum(c).alias(c) for c in sums]), stats, keys, *sums)


def _numbered(stats: DataFrame, keys: list[str], order: tuple[str, ...] = ("block_key",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (blocks, unless told otherwise) numbered in order within each group, and the group's number of them.

    They are laid out by range and counted per range, so a group of any size is
    numbered by many tasks.
    """
    own = land(stats.select(*keys, *order, *carry).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    per = own.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*keys)
    per = per.withColumns({
        "_before": F.coalesce(F.sum("_m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "blocks": F.sum("_m").over(w),
    }).drop("_m")
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    joined = own.withColumn("_rank", rank).alias("a").join(per.alias("b"), _null_safe([*keys, "_part"], "a", "b"))
    return joined.select(*[F.col(f"a.{k}") for k in (*keys, *order, *carry)], (F.col("_before") + F.col("_rank")).alias("idx"), "blocks")


def drawn_lists(seed: int):
    """Arrow rows (blocks, resample, from) to the same draws as ``_hash32`` gives, one row per chunk of blocks hit.

    A chunk's draws are put in order and written as gaps, a byte each unless one is wider,
    so that a draw moves as little over a byte.
    """

    def run(batches):
        for batch in batches:
            for blocks, resample, lo in zip(*(c.to_pylist() for c in batch.columns)):
                head = f"{seed}:{resample}:".encode()
                raw = b"".join([md5(head + b"%d" % s, usedforsecurity=False).digest()[:4] for s in range(lo, min(lo + DRAWS, blocks))])
                idx = np.sort(np.frombuffer(raw, ">u4").astype(np.int64) % blocks)
                first = np.flatnonzero(np.concatenate([[True], idx[1:] // CHUNK != idx[:-1] // CHUNK]))
                gaps = np.diff(idx, prepend=0)
                gaps[first] = idx[first] % CHUNK
                runs = np.split(gaps, first[1:])
                wide = [bool(r.max() > 255) for r in runs]
                yield pa.RecordBatch.from_arrays([
                    pa.array([blocks] * len(runs), pa.int64()), pa.array([resample] * len(runs), pa.int32()), pa.array(idx[first] // CHUNK),
                    pa.array(wide), pa.array([r.astype("<u2" if w else "u1").tobytes() for r, w in zip(runs, wide)], pa.binary()),
                ], names=["blocks", "resample", "chunk", "wide", "gaps"])

    return run


def slot_weights(stats: DataFrame, keys: list[str], resamples: int, seed: int) -> Weights:
    """B draws with replacement from B blocks.

    Groups with the same number of blocks share one set of draws, which also pairs
    models with each other.
    """
    numbered = land(_numbered(stats, keys).filter("blocks >= 2"), "blocks")
    sizes = numbered.select(F.col("blocks").alias("blocks")).distinct()
    turns = sizes.select("blocks", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    slots = (
        turns.repartition(SPREAD, "resample")
        .select("blocks", "resample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("slot"))
        .select("blocks", "resample", F.pmod(_hash32(F.lit(seed), F.col("resample"), F.col("slot")), F.col("blocks")).alias("idx"))
    )
    drawn = slots.groupBy("blocks", "resample", "idx").agg(F.count(F.lit(1)).alias("weight"))
    # Estimates do not see that draws are exploded from one row per size, so only a hint keeps all of them from being broadcast.
    weights = numbered.join(drawn.hint("merge"), ["blocks", "idx"]).select(*keys, "block_key", "resample", "weight")

    def expand(df: DataFrame) -> DataFrame:
        return df.alias("a").join(weights.hint("merge").alias("b"), _null_safe([*keys, "block_key"], "a", "b")).select("a.*", "b.resample", "b.weight")

    def placed(df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """Rows with their block's number, and where that lies: the block's place in its chunk."""
        own = df.alias("a").join(numbered.alias("b"), _null_safe([*keys, "block_key"], "a", "b")).select("a.*", "b.idx", "b.blocks")
        return own, [F.col("blocks"), F.floor(F.col("idx") / CHUNK).alias("chunk"), (F.col("idx") % CHUNK).cast("int").alias("at")]

    def lists() -> DataFrame:
        ranges = turns.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(DRAWS).cast("long"))).alias("from"))
        return ranges.repartition(SPREAD, "resample", "from").mapInArrow(
            drawn_lists(seed), "blocks long, resample int, chunk long, wide boolean, gaps binary")

    def weights_of(draws: pa.Table) -> np.ndarray:
        weight = np.zeros((resamples, CHUNK))
        for r, wide, gaps in zip(*(draws[c].to_pylist() for c in ("resample", "wide", "gaps"))):
            weight[r] += np.bincount(np.cumsum(np.frombuffer(gaps, "<u2" if wide else "u1"), dtype=np.int64), minlength=CHUNK)
        return weight

    kept: list[DataFrame] = []

    def cells(df: DataFrame, own: list[str], asked: DataFrame | None) -> DataFrame:
        """As ``totals``, for counts in bins; a resample's row is multiplied out for the groups it asks for alone."""
        if not kept:
            kept.append(land(lists(), "draws"))  # read by every step
        rows, at = placed(df)
        left = rows.select(_name(own), "bin", F.col("_n").cast("double").alias("n"), *at)
        right, every = kept[0], asked is None
        if asked is not None:  # a row per resample, with names of declared groups
            right = right.join(F.broadcast(asked.select(_name(own), "resample").groupBy("resample").agg(F.collect_set("own").alias("asks"))), "resample")

        def multiply(counts: pa.Table, draws: pa.Table) -> pa.Table:
            weight, out = weights_of(draws), []
            names, place = np.unique(np.array(counts["own"].to_pylist(), dtype=object), return_inverse=True)
            at, bins, n = (counts[c].to_numpy() for c in ("at", "bin", "n"))
            asks: dict = {}
            if not every:
                for r, some in sorted(set(zip(draws["resample"].to_pylist(), map(tuple, draws["asks"].to_pylist())))):
                    for name in some:
                        asks.setdefault(name, []).append(r)
            for i, name in enumerate(names):
                turn = np.arange(resamples) if every else np.array(asks.get(name, []), np.int64)
                mine = place == i
                used, column = np.unique(at[mine], return_inverse=True)
                table = np.zeros((len(used), bins[mine].max() + 1))
                np.add.at(table, (column, bins[mine]), n[mine])
                found = weight[np.ix_(turn, used)] @ table
                r, b = np.nonzero(found)
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(turn)))]).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(b.astype(np.int32)), pa.array(found[r, b].astype(np.int64))], names=["bin", "m"])
                out.append(pa.table({"own": pa.array([name] * len(turn), pa.string()), "resample": pa.array(turn.astype(np.int32)), "hits": pa.ListArray.from_arrays(ends, hits)}))
            shape = pa.schema([("own", pa.string()), ("resample", pa.int32()), ("hits", pa.list_(pa.struct([("bin", pa.int32()), ("m", pa.int64())])))])
            return pa.concat_tables(out).cast(shape) if out else shape.empty_table()

        at = ("blocks", "chunk")
        products = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(multiply, "own string, resample int, hits array<struct<bin: int, m: long>>")
        sums = products.select("own", "resample", F.inline("hits")).groupBy("own", "resample", "bin").agg(F.sum("m").alias("_m"))
        return _named(sums, df, own, "bin", "_m")

    def totals(df: DataFrame, sums: list[str]) -> DataFrame:
        """Blocks of a chunk meet the draws of that chunk, as lists of gaps per resample, once for all groups with as many blocks."""
        own, at = placed(df)
        left = _pack(own, keys, sums, *at)
        right = lists()

        def multiply(blocks: pa.Table, draws: pa.Table) -> pa.Table:
            weight = weights_of(draws)
            names, place = np.unique(np.array(blocks["own"].to_pylist(), dtype=object), return_inverse=True)
            at, s_ = blocks["at"].to_numpy(), blocks["s"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            acc = {i: weight[:, at[place == i]] @ s_[place == i] for i in range(len(names))}
            if not acc:
                return pa.table({"own": pa.array([], pa.string()), "resample": pa.array([], pa.int32()), **{c: pa.array([], pa.float64()) for c in sums}})
            own, r, columns = _group_rows(list(names), acc, sums)
            return pa.table({"own": own, "resample": r, **dict(zip(sums, columns))})

        shape = "own string, resample int, " + ", ".join(f"{c} double" for c in sums)
        at = ("blocks", "chunk")
        return _unpack(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(multiply, shape), df, keys, sums)

    return Weights(expand, cells, totals)


def poisson_weights(keys: list[str], resamples: int, seed: int) -> Weights:
    """Independent Poisson(1) weights, computed where the block is: no join, no shuffle.

    A block's name is hashed once; its draws are mixes of that number with the resample's.
    """
    bounds = _poisson_bounds()
    block = _hash32(F.lit(seed), F.col("block_key"))
    turn = mixed(np.arange(resamples, dtype=np.int64) + seed & 0xFFFFFFFF)
    u = _mixed(_mixed((F.col("resample") + seed).cast("long").bitwiseAND(0xFFFFFFFF)).bitwiseXOR(block))
    # As many draws as bounds lie at or below the number.
    weight = _bound(u, lambda n: F.size(F.filter(F.lit(bounds), lambda bound: bound <= n)))

    def weigh(df: DataFrame) -> DataFrame:
        return df.withColumn("weight", weight.cast("long")).filter("weight > 0")

    every = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")

    def cells(df: DataFrame, own: list[str], asked: DataFrame | None) -> DataFrame:
        turns = df.select("*", every) if asked is None else df.alias("a").join(
            F.broadcast(asked).alias("b"), _null_safe(own, "a", "b")).select("a.*", "b.resample")
        return weigh(turns).groupBy(*own, "resample", "bin").agg(F.sum(F.col("_n") * F.col("weight")).alias("_m"))

    def totals(df: DataFrame, sums: list[str]) -> DataFrame:
        def multiply(batches):
            acc: dict[str, np.ndarray] = {}

            def out():
                own, r, columns = _group_rows({k: k for k in acc}, acc, sums)
                return pa.RecordBatch.from_arrays([own, pa.array(r), *[pa.array(c) for c in columns]], names=["own", "resample", *sums])

            for batch in batches:
                names, place = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
                s_ = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
                h = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint32)
                for lo in range(0, len(h), CHUNK):
                    part = slice(lo, lo + CHUNK)
                    draws = np.searchsorted(np.array(bounds, np.uint64), mixed(turn[:, None] ^ h[None, part]), "right").astype(np.float64)
                    for i in np.unique(place[part]):
                        mine = place[part] == i
                        acc[names[i]] = acc.get(names[i], 0.0) + draws[:, mine] @ s_[part][mine]
                        if len(acc) > HELD:
                            yield out()
                            acc.clear()
            if acc:
                yield out()

        shape = "own string, resample int, " + ", ".join(f"{c} double" for c in sums)
        return _unpack(_pack(df, keys, sums, block.alias("h")).mapInArrow(multiply, shape), df, keys, sums)

    return Weights(lambda df: weigh(df.select("*", every)), cells, totals)


def _weights(stats, keys, c: BootstrapContract) -> Weights:
    if c.scheme == "slots":
        return slot_weights(stats, keys, c.resamples, c.seed)
    if c.scheme == "poisson":
        return poisson_weights(keys, c.resamples, c.seed)
    raise ValueError(f"unknown scheme {c.scheme!r}; choose slots or poisson")


def _long(df: DataFrame, keys: list[str], metrics: list[str], value: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), _statistic(m).finish().cast("double").alias(value)) for m in metrics])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def _summary(points: DataFrame, draws: DataFrame, keys: list[str], c: BootstrapContract) -> DataFrame:
    on = [*keys, "metric"]
    # At most ``resamples`` values per group, so the plain percentile is bounded.
    limits = draws.filter(F.col("value").isNotNull()).groupBy(*on).agg(
        F.percentile("value", F.array(F.lit(c.alpha / 2), F.lit(1 - c.alpha / 2))).alias("q"),
        F.count("value").alias("resamples"),
    )
    a, b = points.alias("a"), limits.alias("b")
    return a.join(b, _null_safe(on, "a", "b"), "left").select(
        *[F.col(f"a.{k}") for k in on], F.col("a.point"), F.col("b.q")[0].alias("low"), F.col("b.q")[1].alias("high"),
        F.coalesce(F.col("b.resamples"), F.lit(0)).cast("long").alias("resamples"),
    )


def intervals(
    df: DataFrame, keys: list[str], metrics=("mae", "macro_f1"), blocks=("county", "month"),
    contract: BootstrapContract = BootstrapContract(),
) -> DataFrame:
    """Percentile intervals for every group x metric x block scheme in one plan.

    A group with fewer than two blocks gets its point estimate, NULL bounds and
    0 resamples; draws without a finite value are left out and not counted.
    """
    out = None
    for block in blocks:
        additive, sums = [m for m in metrics if m != MEDIAN], list(_sums(metrics))
        stats = land(block_stats(df, keys, block, metrics), "block_stats")  # read several times, written once
        weights = _weights(stats, keys, contract)
        parts = []
        if additive:
            totals = stats.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
            points = _long(totals, keys, additive, "point")
            values = _long(weights.totals(stats, sums), keys, additive, "value")
            parts.append(_summary(points, values, keys, contract))
        if MEDIAN in metrics:
            rows = land(_errors(df, keys, block), "error_rows")
            points = exact_median(rows, "v", keys, "point").withColumn("metric", F.lit(MEDIAN))
            values = _median_values(rows, weights, keys).withColumn("metric", F.lit(MEDIAN))
            parts.append(_summary(points, values, keys, contract))
        for p in parts:
            p = p.withColumn("block", F.lit(block)).filter(F.col("point").isNotNull())
            out = p if out is None else out.unionByName(p)
    return out


# ------------------------------------------------- median absolute error

STEPS = 3  # steps that find a rank: each splits what it lies in into as many bins as the cube root of all


def _errors(df: DataFrame, keys: list[str], block: str) -> DataFrame:
    v = F.abs(error()).alias("v")
    return df.select(*keys, F.col(block_column(block)).cast("string").alias("block_key"), v).filter("v IS NOT NULL")


def _median_values(rows: DataFrame, weights: Weights, keys: list[str]) -> DataFrame:
    """Exact weighted median per (keys, resample) of rows (keys, block_key, v).

    Values are put in order and numbered.  A resample's middle ranks are found in
    ``STEPS`` steps: blocks shrink to counts per bin of numbers, their weighted sums tell
    the bin that holds the rank, and the next step counts that bin alone in finer ones,
    the last in single numbers.  Bins hold equally many values however these are
    spread, and a step multiplies as many sums per resample as there are bins.
    """
    counts = rows.groupBy(*keys, "block_key", "v").agg(F.count(F.lit(1)).alias("_n"))
    order = _numbered(land(counts, "errors"), keys, ("v", "block_key"), ("_n",))
    base = (F.ceil(F.cbrt(F.col("blocks").cast("double"))) + 1).cast("long")
    order = land(order.select(*keys, "block_key", "v", "_n", "idx", base.alias("_base")), "ordered_errors")
    bases = order.groupBy(*keys).agg(F.first("_base").alias("_base"))
    one = [*keys, "resample"]
    own, state = [*keys, "_path"], None
    for left in range(STEPS - 1, -1, -1):
        step = F.col("_base") if left == 1 else F.col("_base") ** left
        path = F.floor(F.col("idx") / step).cast("long") if left else F.col("idx")
        binned = order.withColumn("_at", path).select(
            *keys, "block_key", "_n", (F.lit(0).cast("long") if state is None else F.floor(F.col("_at") / F.col("_base"))).alias("_path"),
            (F.col("_at") if state is None else F.col("_at") % F.col("_base")).cast("int").alias("bin"))
        if state is not None:
            held = state.select(*own).distinct()
            binned = binned.alias("a").join(F.broadcast(held).alias("b"), _null_safe(own, "a", "b"), "left_semi")
        sums = weights.cells(binned.groupBy(*own, "block_key", "bin").agg(F.sum("_n").alias("_n")), own, None if state is None else state.select(*own, "resample").distinct())
        if state is None:
            place = (F.col("_all") - 1) / 2
            sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_side"), k(place).cast("long").alias("_k")) for i, k in enumerate((F.floor, F.ceil))]))
            found = sums.withColumn("_all", F.sum("_m").over(Window.partitionBy(*one))).select("*", sides.alias("s")).select(
                *sums.columns, "s.*", F.lit(0).cast("long").alias("_off"))
        else:
            found = state.alias("a").join(sums.alias("b"), _null_safe([*own, "resample"], "a", "b")).select("a.*", "b.bin", "b._m")
        found = _spans(found, [*one, "_side"], "bin", "_m").filter(_holds("_k"))
        state = land(attach(found, bases, keys).select(
            *one, "_side", "_k", (F.col("_path") * F.col("_base") + F.col("bin")).alias("_path"), F.col("_from").alias("_off")), "ranks")
    values = order.select(*keys, F.col("idx").alias("_path"), "v")
    hits = values.alias("a").join(F.broadcast(state).alias("b"), _null_safe(own, "a", "b")).select("b.*", "a.v")
    low, high = (F.max(F.when(F.col("_side") == i, F.col("v"))) for i in (0, 1))
    return hits.groupBy(*one).agg(((low + high) / 2).alias("value"))


# -------------------------------------------------------- paired difference


def paired_difference(
    left: DataFrame, right: DataFrame, metric: str = "mae", block: str = "county", contract: BootstrapContract = BootstrapContract(),
) -> DataFrame:
    """Interval for metric(left) - metric(right) on the rows both models scored.

    The rows are paired by (entity, month) and both models' sums ride through
    the same draws side by side, which keeps the pairing.
    """
    sums = list(_sums([metric]))
    on = [ENTITY, PERIOD]
    need = [c for c in left.columns if c in right.columns and c not in on]  # a statistic may read any column that both have
    a, b = left.select(*on, *need).alias("a"), right.select(*on, *need).alias("b")
    pairs = a.join(b, (F.col(f"a.{ENTITY}") == F.col(f"b.{ENTITY}")) & (F.col(f"a.{PERIOD}") == F.col(f"b.{PERIOD}")))
    sides = pairs.select(
        *[F.col(f"a.{k}") for k in on],
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("side"), *[F.col(f"{t}.{x}").alias(x) for x in need])
            for s, t in (("left", "a"), ("right", "b"))
        ])).alias("m"),
    ).select(*on, "m.*")
    stats = land(block_stats(sides, ["side"], block, [metric]), "block_stats")
    weights = _weights(stats, ["side"], contract)
    if metric == MEDIAN:
        rows = land(_errors(sides, ["side"], block), "error_rows")
        points, values = exact_median(rows, "v", ["side"], "point"), _median_values(rows, weights, ["side"])
    else:
        totals = stats.groupBy("side").agg(*[F.sum(s).alias(s) for s in sums])
        points = _long(totals, ["side"], [metric], "point")
        values = _long(weights.totals(stats, sums), ["resample", "side"], [metric], "value")

    def diff(df, keys, value):
        pick = lambda s: F.max(F.when(F.col("side") == s, F.col(value)))
        return df.withColumn("metric", F.lit(metric)).groupBy(*keys, "metric").agg((pick("left") - pick("right")).alias(value))

    return _summary(diff(points, [], "point"), diff(values, ["resample"], "value"), [], contract).select(
        F.concat("metric", F.lit("_difference")).alias("metric"), F.lit(block).alias("block"), "point", "low", "high", "resamples"
    )
