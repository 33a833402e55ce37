"""Naive forecasters: fitting is one aggregation, predicting one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import classify
from ..schema import CLASSES, ENTITY, NAME, PERIOD, TRAIN

CHANGE = "growth_yoy__diff3"
LEVEL = "growth_yoy__lag0"
NORM = "growth_yoy__rollmean12"
BASE = "price_smoothed__log_diff3_o9"

CONTEXT = [ENTITY, NAME, PERIOD, "volume_tier", "split", BASE]
TRUTH = ["target_dg", "target_label"]
PROBS = [f"prob_{c}" for c in CLASSES]
READS = [*CONTEXT, *TRUTH, CHANGE, LEVEL, NORM]  # all that fitting and predicting look at

NAIVE = ("zero_change", "base_effect", "persistence", "mean_reversion", "majority_class")


def gap() -> Column:
    return F.col(LEVEL) - F.col(NORM)


def fit_naive(train: DataFrame) -> DataFrame:
    """Every naive parameter in one pass over the training rows; one row out."""
    y, g = F.col("target_dg"), gap()
    both = g.isNotNull() & y.isNotNull()
    num = F.sum(F.when(both, g * y))
    den = F.sum(F.when(both, g * g))
    n = F.count("target_label")
    counts = [F.count_if(F.col("target_label") == c) for c in CLASSES]
    # Most frequent label; ties go to the first in class order.
    top = F.greatest(*counts)
    majority = F.when(n == 0, None)
    for c, k in zip(CLASSES, counts):
        majority = majority.when(k == top, c)
    return train.agg(
        F.coalesce(-F.try_divide(num, den), F.lit(0.0)).alias("k"),
        F.coalesce(F.avg(y + F.col(BASE)), F.lit(0.0)).alias("drift"),
        F.coalesce(F.avg(y), F.lit(0.0)).alias("climatology"),
        majority.alias("majority_label"),
        F.try_divide(top, n).alias("majority_share"),
        *[F.coalesce(F.try_divide(k, n), F.lit(0.0)).alias(f"share_{c}") for c, k in zip(CLASSES, counts)],
    )


@dataclass(frozen=True)
class Params:
    """Fitted parameters as fields of one scalar subquery, so nothing is collected."""

    frame: DataFrame

    def __getitem__(self, name: str) -> Column:
        return self.frame.select(F.struct(*self.frame.columns)).scalar()[name]


def magnitude(model: str, p: Params) -> Column:
    """Predicted change of a naive magnitude model."""
    if model == "zero_change":
        return F.lit(0.0)
    if model == "persistence":
        return F.coalesce(F.col(CHANGE), F.lit(0.0))
    if model == "mean_reversion":
        return -p["k"] * F.coalesce(gap(), F.lit(0.0))
    if model == "base_effect":
        return p["drift"] - F.coalesce(F.col(BASE), F.lit(0.0))
    raise KeyError(f"unknown naive model {model!r}")


def predict_naive(split: DataFrame, tau: float, params: DataFrame | None = None, models=NAIVE) -> DataFrame:
    """Long predictions of the naive models on the train, validation and test rows.

    Each row carries its predictions as an array to explode: the feature table is
    scanned once for all models, where a union would scan it once per model.
    """
    p = Params(fit_naive(split.filter(F.col("split") == TRAIN)) if params is None else params)
    null = F.lit(None).cast("double")
    cells = []
    for m in models:
        if m == "majority_class":
            label, dg = p["majority_label"], null
            probs = [p[f"share_{c}"] for c in CLASSES]
        else:
            dg = magnitude(m, p)
            label, probs = classify(dg, tau), [null] * 3
        cells.append(F.struct(
            F.lit(m).alias("model"), dg.cast("double").alias("predicted_dg"), label.alias("predicted_label"),
            *[x.alias(n) for x, n in zip(probs, PROBS)],
        ))
    scored = split.filter(F.col("split").isin("train", "validation", "test"))
    return scored.select(*CONTEXT, *TRUTH, F.explode(F.array(*cells)).alias("_p")).select(
        "_p.model", *CONTEXT, *TRUTH, "_p.predicted_dg", "_p.predicted_label", *[f"_p.{x}" for x in PROBS]
    )
