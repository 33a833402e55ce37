"""Result tables over saved predictions; nothing here fits a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import BootstrapContract, TargetContract
from ..functions.scalar import tier_order
from ..schema import ENTITY, NAME, PERIOD, TEST, VALIDATION
from .bootstrap import intervals
from .metrics import (
    DIRECTION_BAR, MAGNITUDE_BAR, ZERO_BAR, by_period, confusion, error, evaluate, model_table, per_class, safe_corr, with_skill,
)
from .naive import BASE
from .rows import numbered

RIDGE, LOGISTIC = "ridge", "multinomial_logistic"

# Reading order of the concise table, naive bars first.
CONCISE_ORDER = ("persistence", ZERO_BAR, "mean_reversion", MAGNITUDE_BAR, DIRECTION_BAR, RIDGE, LOGISTIC)


def order_of(column: Column, names) -> Column:
    return reduce(lambda acc, kv: acc.when(column == kv[1], kv[0]), list(enumerate(names))[1:], F.when(column == names[0], 0))


def scored(predictions: DataFrame, split: str = TEST, model: str | None = None) -> DataFrame:
    """One split (a partition of the saved table), optionally one model."""
    out = predictions.filter(F.col("split") == split)
    return out if model is None else out.filter(F.col("model") == model)


def headline(predictions: DataFrame, split: str = TEST) -> DataFrame:
    return with_skill(model_table(predictions, split))


def concise(predictions: DataFrame, split: str = TEST) -> DataFrame:
    m = F.col("model")
    return headline(predictions, split).filter(m.isin(*CONCISE_ORDER)).select(
        order_of(m, CONCISE_ORDER).alias("position"), "model",
        F.when(m.isin(RIDGE, LOGISTIC), "learned").otherwise("naive").alias("kind"),
        "mae", "skill_vs_base_effect", "skill_vs_zero_change", "macro_f1", "macro_f1_vs_majority", "corr_forward",
    )


def by_tier(predictions: DataFrame, model: str, t: TargetContract, split: str = TEST) -> DataFrame:
    """Metrics within each volume tier, with the tier's position."""
    table = evaluate(scored(predictions, split, model), ["volume_tier"])
    return table.withColumn("tier_order", tier_order(F.col("volume_tier"), t.tiers))


def tier_table(predictions: DataFrame, magnitude: str, direction: str, t: TargetContract, split: str = TEST) -> DataFrame:
    """Two models side by side per tier, from one pass over both."""
    both = scored(predictions, split).filter(F.col("model").isin(magnitude, direction))
    e = evaluate(both, ["model", "volume_tier"])
    a = e.filter(F.col("model") == magnitude).select("volume_tier", "n", "mae", "mean_error")
    b = e.filter(F.col("model") == direction).select("volume_tier", "accuracy", "macro_f1")
    return a.join(b, "volume_tier").withColumn("tier_order", tier_order(F.col("volume_tier"), t.tiers))


def by_entity(predictions: DataFrame, model: str, split: str = TEST) -> DataFrame:
    """Error per entity with the short name, and its place from the worst, among all entities and in its tier.

    Entities are laid out by range and counted per range, so neither order sorts
    more than one range's entities in a task.
    """
    table = scored(predictions, split, model).groupBy(ENTITY, NAME, "volume_tier").agg(
        F.avg(F.abs(error())).alias("mae"), F.count(F.lit(1)).alias("n")
    ).withColumn("county", F.replace(F.col(NAME), F.lit(" County"), F.lit("")))
    worst = [F.round("mae", 9).desc_nulls_last(), F.col(ENTITY)]
    return numbered(numbered(table, [], worst, "place"), ["volume_tier"], worst, "place_in_tier")


def base_effect_correlation(predictions: DataFrame, model: str, split: str = TEST) -> DataFrame:
    """How much of the target the observable base effect alone explains."""
    y, b = F.col("target_dg"), -F.col(BASE)
    return scored(predictions, split, model).agg(
        safe_corr(y, b, y.isNotNull() & b.isNotNull()).alias("corr_dg_base"), F.count(F.lit(1)).alias("rows")
    )


def forward_rows(predictions: DataFrame, model: str, split: str = TEST) -> DataFrame:
    """Actual and predicted forward growth of one model."""
    b = F.col(BASE)
    return scored(predictions, split, model).select(
        ENTITY, PERIOD, (F.col("target_dg") + b).alias("actual_f"), (F.col("predicted_dg") + b).alias("predicted_f"), "volume_tier"
    ).filter("actual_f IS NOT NULL AND predicted_f IS NOT NULL")


def interval_table(predictions: DataFrame, wanted: dict[str, tuple[str, ...]], c: BootstrapContract, split: str = TEST) -> DataFrame:
    """Intervals of chosen (model, metric) pairs, all models in one plan."""
    metrics = tuple(dict.fromkeys(m for ms in wanted.values() for m in ms))
    rows = scored(predictions, split).filter(F.col("model").isin(*wanted))
    pick = reduce(lambda a, b: a | b, [
        (F.col("model") == k) & F.col("metric").isin(*v) for k, v in wanted.items()
    ])
    return intervals(rows, ["model"], metrics, contract=c).filter(pick)


def claim_facts(predictions: DataFrame, t: TargetContract, magnitude: str = RIDGE, direction: str = LOGISTIC, split: str = TEST) -> DataFrame:
    """The numbers behind each claim, one row."""
    table = headline(predictions, split)
    tiers = evaluate(scored(predictions, split, magnitude), ["volume_tier"])

    def of(model, metric, name):
        return F.max(F.when(F.col("model") == model, F.col(metric))).alias(name)

    low, high = t.tiers[1][0], t.tiers[-1][0]
    per_tier = tiers.agg(*[
        F.max(F.when(F.col("volume_tier") == x, F.col("mae"))).alias(n) for x, n in ((low, "mae_lowest_tier"), (high, "mae_highest_tier"))
    ])
    return table.agg(
        of(magnitude, "n", "rows"), of(magnitude, "mae", "mae"), of(MAGNITUDE_BAR, "mae", "bar_mae"),
        of(magnitude, "skill_vs_base_effect", "skill"), of(magnitude, "corr_forward", "corr_forward"),
        of(MAGNITUDE_BAR, "corr_forward", "bar_corr_forward"), of(magnitude, "mean_error", "mean_error"),
        of(direction, "macro_f1", "macro_f1"), of(DIRECTION_BAR, "macro_f1", "bar_macro_f1"),
    ).withColumn("_t", per_tier.select(F.struct(*per_tier.columns)).scalar()).select("*", "_t.*").drop("_t")


def full_tables(predictions: DataFrame, splits=(TEST, VALIDATION)) -> DataFrame:
    """Every metric per (split, model)."""
    return evaluate(predictions.filter(F.col("split").isin(*splits)), ["split", "model"], forward=True)


def breakdown(predictions: DataFrame, models: list[str], t: TargetContract, split: str = TEST, freq: str = "Q") -> DataFrame:
    """Tier and period breakdown of the chosen models in one long table."""
    rows = scored(predictions, split).filter(F.col("model").isin(*models))
    tiers = evaluate(rows, ["model", "volume_tier"]).select(
        "model", F.lit("tier").alias("kind"), F.col("volume_tier").alias("segment"),
        tier_order(F.col("volume_tier"), t.tiers).alias("position"), "n", "mae", "rmse", "mean_error", "accuracy", "macro_f1", "balanced_accuracy",
    )
    periods = by_period(rows, ["model"], freq).select(
        "model", F.lit("period").alias("kind"), F.col("period").alias("segment"), F.lit(None).cast("int").alias("position"),
        "n", "mae", "rmse", "mean_error", "accuracy", "macro_f1", "balanced_accuracy",
    )
    return tiers.unionByName(periods)


def confusion_tables(predictions: DataFrame, models: list[str], split: str = TEST) -> DataFrame:
    """Confusion counts next to the per-class metrics, per (model, class)."""
    rows = scored(predictions, split).filter(F.col("model").isin(*models))
    m = confusion(rows, ["model"])
    p = per_class(rows, ["model"]).withColumnRenamed("class", "actual")
    return m.join(p, ["model", "actual"])
