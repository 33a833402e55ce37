"""Frozen chronological split with an embargo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..contracts import FeatureContract, SplitContract, SplitWindow
from ..schema import CLASSES, EMBARGO, ENTITY, INELIGIBLE, PERIOD, SPLITS
from .features import complete


def eligible(c: SplitContract, features: FeatureContract | None = None) -> Column:
    ok = F.col("is_included") & F.col("has_target") & (F.col(PERIOD) >= F.lit(c.lead_in))
    if c.require_complete:
        if features is None:
            raise ValueError("require_complete needs the feature contract")
        ok = ok & complete(features)
    return F.coalesce(ok, F.lit(False))


def _inside(w: SplitWindow) -> Column:
    hit = F.col(PERIOD) <= F.lit(w.end)
    return hit if w.start is None else hit & (F.col(PERIOD) >= F.lit(w.start))


def assign_split(df: DataFrame, c: SplitContract, features: FeatureContract | None = None) -> DataFrame:
    """First window wins; eligible rows in a gap are embargoed; the rest is ineligible."""
    ok = eligible(c, features)
    span = SplitWindow("span", c.windows[0].start, c.windows[-1].end)
    out = F.when(~ok, INELIGIBLE)
    for w in c.windows:
        out = out.when(_inside(w), w.name)
    return df.withColumn("split", out.when(_inside(span), EMBARGO).otherwise(INELIGIBLE))


def split_report(split: DataFrame) -> DataFrame:
    """Rows, months, entities, span and class mix of every split value.

    Distinct entities come from a first pass to (split, entity), which also
    keeps a split holding most rows from landing in one task.
    """
    shares = [F.count_if(F.col("target_label") == x).alias(f"n_{x}") for x in CLASSES]
    by_entity = split.groupBy("split", ENTITY).agg(
        F.count(F.lit(1)).alias("rows"), F.min(PERIOD).alias("lo"), F.max(PERIOD).alias("hi"),
        F.count("target_label").alias("labelled"), *shares,
    )
    months = split.groupBy("split", PERIOD).agg(F.lit(1)).groupBy("split").agg(F.count(F.lit(1)).alias("months"))
    totals = by_entity.groupBy("split").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("entities"),
        F.min("lo").alias("first_month"), F.max("hi").alias("last_month"),
        *[
            F.coalesce(F.try_divide(F.sum(f"n_{x}"), F.sum("labelled")), F.lit(0.0)).alias(f"share_{x}")
            for x in CLASSES
        ],
    )
    return totals.join(months, "split")


def write_split(split: DataFrame, path: str) -> DataFrame:
    """Write the split table; its counts are observed by the write itself and recorded beside it, for later runs.

    Returns the record, ``(split, expected)``, one row per frozen count.
    """
    spark, seen = split.sparkSession, Observation("split counts")
    names = (*SPLITS, EMBARGO)
    counts = [F.count_if(F.col("split") == n).alias(n) for n in names]
    split.observe(seen, *counts).write.mode("overwrite").parquet(path)
    found = seen.get
    rows = [(n, found[n]) for n in names] + [("eligible", sum(found[n] for n in names))]
    spark.createDataFrame(rows, "split string, expected long").coalesce(1).write.mode("overwrite").parquet(counts_path(path))
    return recorded_counts(spark, path)


def counts_path(path: str) -> str:
    return path.rstrip("/") + ".counts"


def recorded_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(counts_path(path))


def row_count_guard(split: DataFrame, c: SplitContract, recorded: DataFrame | None = None) -> DataFrame:
    """Expected against actual rows for every frozen count: those of the contract, or those ``recorded`` by an earlier write."""
    counts = split.groupBy("split").agg(F.count(F.lit(1)).alias("actual"))
    usable = split.agg(F.count_if(F.col("split").isin(*SPLITS, EMBARGO)).alias("actual")).select(
        F.lit("eligible").alias("split"), "actual"
    )
    expected = recorded
    if expected is None:
        expected = split.sparkSession.createDataFrame(list(c.expected_rows), "split string, expected long")
    return (
        F.broadcast(expected).join(counts.unionByName(usable), "split", "left")
        .select("split", "expected", F.coalesce("actual", F.lit(0)).alias("actual"))
        .withColumn("passed", F.col("expected") == F.col("actual"))
    )
