"""Exact quantiles of unbounded groups, by counting leading bits.

``percentile`` keeps every distinct value of a group in one task, which a group
holding a third of a 100 TB table does not survive.  Here a value's first bits, its
value rounded to a few significant ones, are its histogram key: rounding keeps the
order, so the keys' counts tell which key holds a wanted rank.  One scan counts the
keys of all columns and quantiles; a further scan per digit counts, for the keys
that hold a rank alone, the next bits; the last counts the values themselves out.
Counts combine map-side, so rows never move: only (group, key) counts are shuffled,
and a window sees one row per key.  One algorithm for all sizes, no sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = (12,)  # significant bits after each counting scan; the scan after them counts whole values


def _null_safe(keys: list[str], a: str, b: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def attach(df: DataFrame, small: DataFrame, keys: list[str], few_groups: bool = True) -> DataFrame:
    """Join per-group values to the rows.

    ``few_groups``: the caller declares groups by model, split, tier, class or column,
    so the small side is bounded by the declaration and may be broadcast; otherwise
    adaptive execution chooses and splits hot keys.
    """
    extra = [F.col(f"b.{c}") for c in small.columns if c not in keys]
    side = F.broadcast(small) if few_groups else small
    return df.alias("a").join(side.alias("b"), _null_safe(keys, "a", "b")).select("a.*", *extra)


def leading(v: Column, bits: int) -> Column:
    """``v`` rounded to ``bits`` significant bits: never falls as ``v`` rises, and costs three operations.

    Where the products would overflow, and for infinities and NaN, it is ``v`` itself.
    """
    wide = v * (2.0 ** (53 - bits) + 1)
    return F.when(F.abs(v) < 2.0 ** (1022 - 53 + bits), wide - (wide - v)).otherwise(v)


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], keys: list[str] = (), few_groups: bool = True, digits: tuple[int, ...] = DIGITS,
) -> DataFrame:
    """Long (keys, column, prob, value) with linear interpolation, NULLs ignored.

    Columns become rows first, so the generated code stays small however many
    columns are asked for; every aggregation then combines map-side per (keys,
    column, leading bits).  ``len(digits) + 1`` scans, no driver action.  With 12 bits a
    key spans a 4096th of its value's size, and the values of such a key are what
    the last scan sorts per quantile: give another digit where groups are so large
    that this is too much.
    """
    if list(digits) != sorted(set(digits)) or not digits or not 1 <= digits[0] or digits[-1] > 52:
        raise ValueError("digits are numbers of significant bits, from 1 to 52, ascending")
    keys = list(keys)
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    long = df.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.*").filter("_v IS NOT NULL")
    group, v = [*keys, "_c"], F.col("_v")
    ranks = [*group, "_p", "_side"]
    asked = F.array(*[F.struct(F.lit(i).alias("_p"), F.lit(float(p)).alias("_at")) for i, p in enumerate(probs)])

    # Ranks each quantile lies between, with the key that holds each.
    counts = long.groupBy(*group, leading(v, digits[0]).alias("_key")).agg(F.count(F.lit(1)).alias("_m")).withColumn("_off", F.lit(0).cast("long"))
    spans = _spans(counts, group, "_key", "_m").withColumn("_n", F.sum("_m").over(Window.partitionBy(*group)))
    place = F.col("q._at") * (F.col("_n") - 1)
    sides = F.array(*[F.struct(F.lit(i).alias("_side"), k(place).cast("long").alias("_k"), (place - F.floor(place)).alias("_f"))
                      for i, k in enumerate((F.floor, F.ceil))])
    state = spans.withColumn("q", F.explode(asked)).withColumn("s", F.explode(sides)).select(
        *group, "q._p", "s.*", "_key", "_from", "_upto").filter(_holds("_k")).withColumnRenamed("_from", "_off").drop("_upto")
    for before, bits in zip(digits, [*digits[1:], None]):
        rows = long.withColumn("_key", leading(v, before))
        held = attach(rows, state, [*group, "_key"], few_groups)
        finer = v if bits is None else leading(v, bits)
        counted = held.groupBy(*ranks, finer.alias("_finer")).agg(
            F.count(F.lit(1)).alias("_m"), *[F.first(x).alias(x) for x in ("_off", "_k", "_f")])
        state = _spans(counted, ranks, "_finer", "_m").filter(_holds("_k")).select(
            *ranks, "_k", "_f", F.col("_finer").alias("_key"), F.col("_from").alias("_off"))
    low, high = (F.max(F.when(F.col("_side") == i, F.col("_key"))) for i in (0, 1))
    names = F.array(*[F.lit(c) for c in columns])
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return state.groupBy(*group, "_p").agg(F.when(high == low, low).otherwise(low + (high - low) * F.first("_f")).alias("value")).select(
        *keys, names[F.col("_c")].alias("column"), ps[F.col("_p")].alias("prob"), "value"
    )


def _spans(df: DataFrame, group: list[str], order: str, n: str) -> DataFrame:
    """Ranks each row's ``n`` values take: ``_from`` up to but without ``_upto``, after ``_off`` smaller ones."""
    upto = F.col("_off") + F.sum(n).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col(n))


def _holds(rank: str) -> Column:
    return (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_upto"))


def exact_median(df: DataFrame, column: str, keys: list[str] = (), name: str | None = None, few_groups: bool = True) -> DataFrame:
    """(keys, median) of one column."""
    return exact_quantiles(df, [column], [0.5], keys, few_groups).select(*keys, F.col("value").alias(name or column))
