"""Row accounting and joins with a declared cardinality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import land

REASON = "_reason"


@dataclass(frozen=True)
class Staged:
    """A staged table, the source rows tagged with why they were dropped, and, where cheaper than from the table, the months it covers (``lo``, ``hi``)."""

    source: str
    table: DataFrame
    tagged: DataFrame
    span: DataFrame | None = None


def tag(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Charge every row to the first rule it fails; NULL reason means kept.

    One pass and no counting action: the accounting is an aggregation over the
    tag, the staged table a filter on it.
    """
    reason = None
    for name, failed in rules:
        hit = F.coalesce(failed, F.lit(True))
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return df.withColumn(REASON, reason)


def kept(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(REASON).isNull()).drop(REASON)


def account(tagged: DataFrame, source: str) -> DataFrame:
    """(source, reason, rows); kept rows are counted under 'staged'."""
    return (
        tagged.groupBy(F.coalesce(F.col(REASON), F.lit("staged")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(source).alias("source"), "reason", "rows")
    )


def unique_guard(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """Fail the running job at the first repeated key.

    ``row_number`` over the join key uses the distribution and order a
    sort-merge join needs anyway, streams, and never buffers a hot key.
    """
    w = Window.partitionBy(*on).orderBy(*on)
    n = "_n"
    message = F.concat(F.lit(f"{side} key repeats: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    ok = F.when(F.col(n) > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return df.withColumn(n, F.row_number().over(w)).filter(ok).drop(n)


def count_guard(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """Fail the job if any key repeats, from counts taken in a subquery of its own.

    Leaves the join input untouched, so adaptive execution can still broadcast it
    or split a hot key of the other side.
    """
    repeats = duplicate_keys(df, on).agg(F.count(F.lit(1))).scalar()
    message = F.concat(F.lit(f"{side} key repeats: "), repeats.cast("string"), F.lit(" keys"))
    return df.filter(F.when(repeats > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def validated_join(left, right, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Join that raises instead of silently multiplying rows.

    Unique sides share the join's own shuffle with their guard; many-to-one may
    meet a hot key on the left, so there the right side is checked apart.
    """
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality {validate!r}")
    if validate == "one_to_one":
        return unique_guard(left, on, "left").join(unique_guard(right, on, "right"), on, how)
    return left.join(count_guard(right, on, "right"), on, how)


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """The report form of the guard: keys that occur more than once."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def join_accounting(spine: DataFrame, source: DataFrame, on: list[str], name: str) -> DataFrame:
    """How many spine rows matched, and how many source rows fall outside it.

    Both sides shrink to counts per key first, so a hot key costs one row.
    """
    a = spine.groupBy(*on).agg(F.count(F.lit(1)).alias("_a"))
    b = source.groupBy(*on).agg(F.count(F.lit(1)).alias("_b"))
    j = a.join(b, on, "full_outer")
    matched = F.sum(F.when(F.col("_b").isNotNull(), F.col("_a")))
    return j.agg(
        F.lit(name).alias("source"),
        F.coalesce(matched, F.lit(0)).alias("spine_rows_matched"),
        F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col("_a"))), F.lit(0)).alias("spine_rows_unmatched"),
        F.coalesce(F.sum(F.when(F.col("_a").isNull(), F.col("_b"))), F.lit(0)).alias("source_rows_outside_spine"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds each row's place, from one, in an order within its group; ``order`` must tell the rows of a group apart.

    Rows are laid out by range and counted per range, so a group of any size, the
    whole table too, is numbered by many tasks.
    """
    own = land(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = own.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_range"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return own.withColumn("_place", place).join(per, same).select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))
