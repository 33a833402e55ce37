"""Forecast metrics as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import period_label
from ..schema import CLASSES, ENTITY, PERIOD, TEST
from .naive import BASE, PROBS
from .quantiles import _null_safe, exact_median

EPSILON = 1e-15
PRIMARY_MAGNITUDE, PRIMARY_DIRECTIONAL = "mae", "macro_f1"
MAGNITUDE_BAR, ZERO_BAR, DIRECTION_BAR = "base_effect", "zero_change", "majority_class"


# ---------------------------------------------------------- row expressions


def error() -> Column:
    return F.col("predicted_dg") - F.col("target_dg")


def both_labels() -> Column:
    return F.col("target_label").isNotNull() & F.col("predicted_label").isNotNull()


def magnitude_aggs() -> list[Column]:
    e = error()
    return [
        F.count(e).alias("_n_mag"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean_error"),
    ]


def class_counts() -> list[Column]:
    """Additive parts of every directional metric: hits, predicted and actual per class."""
    a, p = F.col("target_label"), F.col("predicted_label")
    ok = both_labels()
    out = [F.count_if(ok).alias("_n_dir")]
    for c in CLASSES:
        out += [
            F.count_if(ok & (a == c) & (p == c)).alias(f"_tp_{c}"),
            F.count_if(ok & (p == c)).alias(f"_pred_{c}"),
            F.count_if(ok & (a == c)).alias(f"_act_{c}"),
        ]
    return out


def _ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision(c):
    return _ratio0(F.col(f"_tp_{c}"), F.col(f"_pred_{c}"))


def recall(c):
    return _ratio0(F.col(f"_tp_{c}"), F.col(f"_act_{c}"))


def f1(c):
    p, r = precision(c), recall(c)
    return _ratio0(2 * p * r, p + r)


def accuracy() -> Column:
    return F.try_divide(sum((F.col(f"_tp_{c}") for c in CLASSES), F.lit(0)), F.col("_n_dir"))


def macro_f1() -> Column:
    """All three classes count, an absent one as 0."""
    return F.when(F.col("_n_dir") > 0, sum((f1(c) for c in CLASSES), F.lit(0.0)) / 3)


def balanced_accuracy() -> Column:
    """Mean recall over the classes that occur."""
    present = sum((F.when(F.col(f"_act_{c}") > 0, 1).otherwise(0) for c in CLASSES), F.lit(0))
    return F.try_divide(sum((recall(c) for c in CLASSES), F.lit(0.0)), present)


def probability_aggs() -> list[Column]:
    total = sum((F.col(p) for p in PROBS), F.lit(0.0))
    norm = [F.try_divide(F.col(p), total) for p in PROBS]
    hit = [F.when(F.col("target_label") == c, 1.0).otherwise(0.0) for c in CLASSES]
    usable = F.col("target_label").isNotNull() & total.isNotNull()
    own = sum((n * h for n, h in zip(norm, hit)), F.lit(0.0))
    loss = -F.ln(F.least(F.greatest(own, F.lit(EPSILON)), F.lit(1.0)))
    quad = sum(((n - h) * (n - h) for n, h in zip(norm, hit)), F.lit(0.0))
    return [F.avg(F.when(usable, loss)).alias("log_loss"), F.avg(F.when(usable, quad)).alias("brier")]


# Below this relative spread a series counts as constant: what remains is the
# rounding of adding a number and taking it away again.
FLAT = 1e-9


def safe_corr(x: Column, y: Column, usable: Column) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    a, b = F.when(usable, x), F.when(usable, y)
    sa, sb = F.stddev_samp(a), F.stddev_samp(b)

    def moves(s, v):
        return s > FLAT * F.greatest(F.lit(1.0), F.abs(F.avg(v)))

    return F.when(moves(sa, a) & moves(sb, b), F.try_divide(F.covar_samp(a, b), sa * sb))


def forward_aggs(base: str = BASE) -> list[Column]:
    """Skill on forward growth f = dg + b, the part that had not happened yet."""
    b, y, p = F.col(base), F.col("target_dg"), F.col("predicted_dg")
    ok = b.isNotNull() & y.isNotNull() & p.isNotNull()
    return [
        F.count_if(ok).alias("n_forward"),
        F.avg(F.when(ok, F.abs((p + b) - (y + b)))).alias("mae_forward"),
        F.stddev_samp(F.when(ok, y + b)).alias("sd_forward"),
        safe_corr(p, y, ok).alias("corr_dg"),
        safe_corr(p + b, y + b, ok).alias("corr_forward"),
    ]


# ------------------------------------------------------------------ tables

METRICS = ["n", "mae", "rmse", "mean_error", "medae", "accuracy", "macro_f1", "balanced_accuracy", "log_loss", "brier"]
FORWARD = ["n_forward", "mae_forward", "sd_forward", "corr_dg", "corr_forward"]


def evaluate(df: DataFrame, keys: list[str], forward: bool = False, bounded: bool = False) -> DataFrame:
    """Every metric a set of predictions supports, per group; NULL groups are kept.

    One aggregation of additive parts.  The median absolute error is the only
    part that is not additive: it goes through the counting exact quantile so
    that no task holds a group's errors.  ``bounded`` says every group is at most
    one entity's months, where the plain aggregate is safe.
    """
    parts = magnitude_aggs() + class_counts() + probability_aggs() + (forward_aggs() if forward else [])
    if bounded:
        parts.append(F.percentile(F.abs(error()), 0.5).alias("medae"))
    scored = [
        F.greatest("_n_mag", "_n_dir").alias("n"), F.col("mae"), F.col("rmse"), F.col("mean_error"), F.col("medae"),
        accuracy().alias("accuracy"), macro_f1().alias("macro_f1"), balanced_accuracy().alias("balanced_accuracy"),
        F.col("log_loss"), F.col("brier"), *([F.col(c) for c in FORWARD] if forward else []),
    ]
    agg = df.groupBy(*keys).agg(*parts)
    if bounded:
        return agg.select(*keys, *scored)
    # Groups by entity grow with the data, so their side of the join is left to adaptive execution.
    medae = exact_median(df.select(*keys, F.abs(error()).alias("_abs")), "_abs", keys, "medae", few_groups=ENTITY not in keys)
    if not keys:
        return agg.withColumn("medae", medae.select("medae").scalar()).select(*scored)
    a, m = agg.alias("a"), medae.alias("m")
    joined = a.join(m, _null_safe(keys, "a", "m"), "left").select("a.*", "m.medae")
    return joined.select(*keys, *scored)


def by_period(df: DataFrame, keys: list[str], freq: str = "Y") -> DataFrame:
    return evaluate(df.withColumn("period", period_label(F.col(PERIOD), freq)), [*keys, "period"])


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per actual class with a column per predicted class; all nine cells."""
    cells = df.filter(both_labels()).groupBy(*keys, "target_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when((F.col("target_label") == a) & (F.col("predicted_label") == p), F.col("n"))), F.lit(0)).alias(f"{a}_{p}")
        for a in CLASSES for p in CLASSES
    ])
    out = F.array(*[
        F.struct(F.lit(a).alias("actual"), *[F.col(f"{a}_{p}").alias(p) for p in CLASSES]) for a in CLASSES
    ])
    return rows.select(*keys, F.explode(out).alias("r")).select(*keys, "r.*")


def per_class(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1, support and predicted count of each class."""
    agg = df.groupBy(*keys).agg(*class_counts())
    out = F.array(*[
        F.struct(
            F.lit(c).alias("class"), precision(c).alias("precision"), recall(c).alias("recall"), f1(c).alias("f1"),
            F.col(f"_act_{c}").alias("support"), F.col(f"_pred_{c}").alias("predicted"),
        )
        for c in CLASSES
    ])
    return agg.select(*keys, F.explode(out).alias("r")).select(*keys, "r.*")


def skill_score(mae: Column, bar: Column) -> Column:
    """Share of the bar's error removed; NULL against a zero or missing bar."""
    return 1.0 - F.try_divide(mae, bar)


def model_table(predictions: DataFrame, split: str = TEST) -> DataFrame:
    """Pooled metrics per model on one split."""
    return evaluate(predictions.filter(F.col("split") == split), ["model"], forward=True)


def with_skill(table: DataFrame) -> DataFrame:
    """Add each model's skill against the naive bars.

    The unpartitioned window runs over the metric table: one row per model.
    """
    everything = Window.partitionBy()

    def bar(model, metric):
        return F.max(F.when(F.col("model") == model, F.col(metric))).over(everything)

    return (
        table.withColumn("skill_vs_base_effect", skill_score(F.col("mae"), bar(MAGNITUDE_BAR, "mae")))
        .withColumn("skill_vs_zero_change", skill_score(F.col("mae"), bar(ZERO_BAR, "mae")))
        .withColumn("macro_f1_vs_majority", F.col("macro_f1") - bar(DIRECTION_BAR, "macro_f1"))
    )


def skill_table(predictions: DataFrame, split: str = TEST) -> DataFrame:
    return with_skill(model_table(predictions, split)).select(
        "model", "mae", "skill_vs_base_effect", "skill_vs_zero_change", "macro_f1", "macro_f1_vs_majority", "corr_forward"
    )
