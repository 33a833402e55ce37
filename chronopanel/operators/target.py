"""The forecast target: smoothed price, yearly growth, its forward change, its class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..contracts import TargetContract
from ..functions import scalar as S
from ..functions.transforms import full_window, log_growth, shift
from ..schema import CLASSES, ENTITY, NAME, PERIOD


def entity_window(*within: str) -> WindowSpec:
    return Window.partitionBy(ENTITY, *within).orderBy(PERIOD)


def smooth(price: Column, c: TargetContract, w: WindowSpec) -> Column:
    return full_window(F.avg, price, c.window, 0, w)


def yearly_growth(smoothed: Column, c: TargetContract, w: WindowSpec) -> Column:
    return log_growth(smoothed, shift(smoothed, c.growth_lag, w))


def forward_change(growth: Column, c: TargetContract, w: WindowSpec) -> Column:
    """The label.  The only place in the package that looks ahead."""
    return F.lead(growth, c.horizon).over(w) - growth


def add_target(panel: DataFrame, c: TargetContract) -> DataFrame:
    """Attach the eight target columns.

    Every step is a window on (entity, month), so the whole chain runs on one
    exchange and one sort.  The median is over one entity's months, a group the
    calendar bounds.
    """
    w = entity_window()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    volume = F.percentile(F.col(c.volume_column), 0.5).over(whole)
    return (
        panel.withColumn("homes_sold_median", volume)
        .withColumn("price_smoothed", smooth(F.col(c.price_column), c, w))
        .withColumn("growth_yoy", yearly_growth(F.col("price_smoothed"), c, w))
        .withColumn("target_dg", forward_change(F.col("growth_yoy"), c, w))
        .withColumn("volume_tier", S.tier(F.col("homes_sold_median"), c.tiers))
        .withColumn("is_included", F.coalesce(F.col("homes_sold_median") >= c.floor, F.lit(False)))
        .withColumn("target_label", S.classify(F.col("target_dg"), c.tau))
        .withColumn("has_target", F.col("target_dg").isNotNull())
    )


def entity_volume(panel: DataFrame, c: TargetContract) -> DataFrame:
    """Median monthly volume, tier and inclusion per entity."""
    v = F.col("homes_sold_median")
    return panel.groupBy(ENTITY, NAME).agg(
        F.percentile(F.col(c.volume_column), 0.5).alias("homes_sold_median")
    ).select(
        ENTITY, NAME, v, S.tier(v, c.tiers).alias("volume_tier"),
        F.coalesce(v >= c.floor, F.lit(False)).alias("is_included"),
    )


def modelling_rows(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("is_included") & F.col("has_target"))


def target_report(panel: DataFrame) -> DataFrame:
    """Row accounting of the target step, one row."""
    model = F.col("is_included") & F.col("has_target")

    def share(label):
        hit = F.count_if(model & (F.col("target_label") == label))
        return F.coalesce(F.try_divide(hit.cast("double"), F.count_if(model)), F.lit(0.0)).alias(f"share_{label}")

    entities = panel.groupBy(ENTITY).agg(F.bool_or("is_included").alias("inc")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("inc")).alias("out")
    )
    return panel.agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.count_if(F.col("is_included")).alias("included_rows"),
        F.count_if(F.col("has_target")).alias("rows_with_target"),
        F.count_if(model).alias("modelling_rows"),
        F.min(F.when(F.col("has_target"), F.col(PERIOD))).alias("target_start"),
        F.max(F.when(F.col("has_target"), F.col(PERIOD))).alias("target_end"),
        *[share(x) for x in CLASSES],
    ).withColumn("entities", entities.select("n").scalar()).withColumn(
        "entities_excluded", entities.select("out").scalar()
    )


def excluded_entities(panel: DataFrame) -> DataFrame:
    """Entities under the volume floor, with the rows that leave with them."""
    return (
        panel.filter(~F.col("is_included"))
        .groupBy(ENTITY, NAME)
        .agg(F.count(F.lit(1)).alias("rows"), F.max("homes_sold_median").alias("homes_sold_median"))
    )


def base_effect_parts(panel: DataFrame, c: TargetContract) -> DataFrame:
    """dg = f - b: forward growth f, base effect b and the residual of the identity."""
    w = entity_window()
    p = F.col("price_smoothed")
    f = log_growth(F.lead(p, c.horizon).over(w), p)
    b = log_growth(shift(p, c.growth_lag - c.horizon, w), shift(p, c.growth_lag, w))
    return panel.select(
        ENTITY, PERIOD, "target_dg", f.alias("forward_growth"), b.alias("base_effect")
    ).withColumn("residual", F.col("target_dg") - (F.col("forward_growth") - F.col("base_effect")))
