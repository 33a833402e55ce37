"""The feature matrix: capped fill, every declared transform, and its accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import FeatureContract
from ..functions.transforms import apply_transform
from ..schema import CONTEXT, ENTITY, KEY, PERIOD
from .target import entity_window


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def spine_guard(panel: DataFrame) -> DataFrame:
    """Fail the job where an entity's months are not consecutive.

    Row-wise (this month against the previous row's), so it rides on the window
    pass the transforms need anyway and catches both gaps and repeats.
    """
    w = entity_window()
    expected = F.add_months(F.lag(PERIOD).over(w), 1)
    message = F.concat(F.lit("spine is incomplete for "), F.col(ENTITY), F.lit(" at "), F.col(PERIOD).cast("string"))
    ok = F.when(F.col("_next") != F.col(PERIOD), F.raise_error(message).cast("boolean")).otherwise(True)
    return panel.withColumn("_next", expected).filter(ok).drop("_next")


def fill_gaps(panel: DataFrame, c: FeatureContract, within: tuple[str, ...] = ()) -> DataFrame:
    """Carry the declared sources forward, at most ``cap`` months, and flag filled rows."""
    w = entity_window(*within)
    out = panel
    for policy in c.fills:
        columns = list(dict.fromkeys(s.column for s in c.features if s.source == policy.source))
        if not columns:
            continue
        frame = w.rowsBetween(-policy.cap if policy.cap else Window.unboundedPreceding, 0)
        filled = {x: F.last(F.col(x).cast("double"), ignorenulls=True).over(frame) for x in columns}
        missing = _any([F.col(x).isNull() for x in columns])
        out = out.withColumn("_missing", missing).withColumns(filled)
        if policy.indicator:
            now = _all([F.col(x).isNotNull() for x in columns])
            out = out.withColumn(policy.indicator, (F.col("_missing") & now).cast("double"))
        out = out.drop("_missing")
    return out


def build_features(panel: DataFrame, c: FeatureContract, guard: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """All declared features plus untouched context, one row per panel row.

    One wide select: every column shares the (entity, month) window, so the
    plan is one exchange and one sort however many features are declared.
    ``within`` names columns that part an entity's rows further; they are returned too.
    """
    absent = sorted({s.column for s in c.features} - set(panel.columns))
    if absent:
        raise KeyError(f"features read columns the panel does not have: {', '.join(absent)}")
    w = entity_window(*within)
    context = [x for x in CONTEXT if x in panel.columns]
    renamed = {x: f"_ctx_{x}" for x in context}
    # Context is copied before the fill, so a filled column never leaks into it.
    source = spine_guard(panel) if guard else panel
    filled = fill_gaps(source.withColumns({v: F.col(k) for k, v in renamed.items()}), c, within)
    return filled.select(
        *KEY,
        *within,
        *[F.col(v).alias(k) for k, v in renamed.items()],
        *[apply_transform(F.col(s.column), s.transform, s.param, s.lag, w).alias(s.name) for s in c.specs()],
    )


def complete(c: FeatureContract) -> Column:
    return _all([F.col(n).isNotNull() for n in c.names()])


def feature_report(features: DataFrame, c: FeatureContract) -> DataFrame:
    """Complete rows, modelling rows, first complete month, filled cells: one pass."""
    model = F.col("is_included") & F.col("has_target")
    good = complete(c)
    imputed = [
        F.coalesce(F.sum(f.indicator), F.lit(0.0)).cast("long").alias(f"{f.indicator}_cells")
        for f in c.fills if f.indicator
    ]
    return features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(c.names())).cast("long").alias("feature_count"),
        F.lit(max(s.reach for s in c.specs())).cast("long").alias("max_reach_months"),
        F.count_if(good).alias("complete_rows"),
        F.count_if(model).alias("modelling_rows"),
        F.count_if(good & model).alias("complete_modelling_rows"),
        F.min(F.when(good & model, F.col(PERIOD))).alias("first_complete_month"),
        *imputed,
    )


def family_counts(spark, c: FeatureContract) -> DataFrame:
    return c.to_frame(spark).groupBy("family").agg(F.count(F.lit(1)).alias("features"))


def availability(features: DataFrame, c: FeatureContract) -> DataFrame:
    """Declared reach next to the earliest month each feature was actually seen.

    One aggregation gives two numbers per feature; turning that single row into
    one row per feature and joining the contract is bounded by the declaration.
    """
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(PERIOD).alias("_start")]
    for i, n in enumerate(c.names()):
        aggs += [F.min(F.when(F.col(n).isNotNull(), F.col(PERIOD))).alias(f"f{i}"), F.count(n).alias(f"c{i}")]
    wide = features.agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"f{i}").alias("first"), F.col(f"c{i}").alias("seen"))
        for i, n in enumerate(c.names())
    ])
    observed = wide.select("_n", "_start", F.explode(cells).alias("x")).select("_n", "_start", "x.*")
    contract = c.to_frame(features.sparkSession)
    return observed.join(F.broadcast(contract), "feature").select(
        "feature", "family", "source", "definition", "release_lag_months", "reads_back_months",
        F.add_months("_start", F.col("reads_back_months")).alias("earliest_month_expected"),
        F.col("first").alias("earliest_month_observed"),
        (1 - F.try_divide(F.col("seen"), F.col("_n"))).alias("null_rate"),
    )
