"""Leakage and point-in-time audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import FeatureContract, SplitContract
from ..functions.scalar import cutoff, published_at
from ..schema import ENTITY, KEY, PERIOD, SPLITS
from .features import availability, build_features


def spine_gaps(panel: DataFrame) -> DataFrame:
    """Entities whose months are not one gap-free run.

    Counts per (entity, month) come first: repeats collapse map-side and cannot
    hide a gap, as they would in a plain row count.
    """
    cells = panel.groupBy(ENTITY, PERIOD).agg(F.count(F.lit(1)).alias("copies"))
    span = cells.groupBy(ENTITY).agg(
        F.min(PERIOD).alias("first_month"), F.max(PERIOD).alias("last_month"),
        F.count(F.lit(1)).alias("months"), F.sum("copies").alias("rows"),
    )
    expected = (
        (F.year("last_month") - F.year("first_month")) * 12 + F.month("last_month") - F.month("first_month") + 1
    ).cast("long")
    return span.withColumn("expected", expected).filter(
        (F.col("months") != F.col("expected")) | (F.col("rows") != F.col("expected"))
    )


def assert_complete_spine(panel: DataFrame) -> None:
    bad = [r[0] for r in spine_gaps(panel).orderBy(ENTITY).select(ENTITY).limit(5).collect()]
    if bad:
        raise ValueError(f"spine is incomplete for: {', '.join(map(str, bad))}")


def publication_audit(months: DataFrame, c: FeatureContract) -> DataFrame:
    """Tightest margin, in days, between an input's publication and the cutoff.

    The distinct months carry the contract as an array to explode, so each
    feature meets each month without a cross join; both are bounded (calendar
    months, declared features).
    """
    specs = F.array(*[
        F.struct(
            F.lit(s.name).alias("feature"), F.lit(s.source).alias("source"),
            F.lit(s.lag).alias("lag"), F.lit(c.timing(s.source).delay_days).alias("delay"),
        )
        for s in c.specs()
    ])
    pairs = months.select(PERIOD).distinct().select(PERIOD, F.explode(specs).alias("s")).select(PERIOD, "s.*")
    newest = F.add_months(F.col(PERIOD), -F.col("lag"))
    margin = F.datediff(
        cutoff(F.col(PERIOD), c.cutoff_months, c.cutoff_day), published_at(newest, F.col("delay"))
    )
    return (
        pairs.withColumn("margin", margin)
        .groupBy("feature", "source", F.col("lag").alias("effective_lag_months"))
        .agg(F.min("margin").alias("min_margin_days"), F.bool_or(F.col("margin") < 0).alias("leaks"))
    )


def cutoff_mismatches(panel: DataFrame, c: FeatureContract) -> DataFrame:
    """Rows whose stored cutoff differs from the contract's function of the month."""
    return panel.filter(
        ~F.col("prediction_as_of").eqNullSafe(cutoff(F.col(PERIOD), c.cutoff_months, c.cutoff_day))
    ).select(*KEY, "prediction_as_of")


def _replayed(panel: DataFrame, c: FeatureContract, cuts: list[str] | None) -> DataFrame:
    """Per (entity, cut): its feature cells built from all months, and from those up to the cut alone.

    Cuts are data.  A month goes into the history of every cut it can reach by the
    declared lags and fills, and into one history without a cut; all are built in one
    pass within (entity, cut), so a panel bucketed by entity is not moved.  What a
    feature reads beyond its declared reach differs too, and is reported.
    """
    month = F.col(PERIOD)
    back = max(s.reach for s in c.specs()) + max((f.cap for f in c.fills), default=0)
    if any(not f.cap for f in c.fills):  # carried without end: a cut needs all months before it
        until = panel.agg(F.max(PERIOD)).scalar()
    else:
        until = F.add_months(month, back)
    ahead = F.sequence(month, until, F.expr("INTERVAL 1 MONTH"))
    wanted = None if cuts is None else F.array(*[F.lit(x).cast("date") for x in cuts])
    if wanted is not None:
        ahead = F.array_intersect(ahead, wanted)
    copies = panel.withColumn("_cut", F.explode(F.concat(F.array(F.lit(None).cast("date")), ahead)))
    whole = F.col("_cut").isNull()
    built = build_features(copies, c, guard=False, within=("_cut",)).filter(
        (month == F.col("_cut")) | (whole if wanted is None else whole & F.array_contains(wanted, month)))
    cells = F.array(*[F.col(n).cast("double") for n in c.names()])
    return built.groupBy(*KEY).agg(
        F.first(F.when(whole, cells), ignorenulls=True).alias("full"),
        F.first(F.when(~whole, cells), ignorenulls=True).alias("past"))


def replay_diff(panel: DataFrame, c: FeatureContract, cut: str) -> DataFrame:
    """Feature cells at ``cut`` that change when everything after it is removed, named per entity."""
    names = F.array(*[F.lit(n) for n in c.names()])
    differing = F.zip_with(names, F.zip_with("full", "past", lambda a, b: ~a.eqNullSafe(b)), lambda n, d: F.when(d, n))
    return _replayed(panel, c, [cut]).select(
        ENTITY,
        F.filter(differing, lambda n: n.isNotNull()).alias("differing_features"),
        F.size(F.filter("full", lambda v: v.isNotNull())).cast("long").alias("cells_present"),
    )


def replay_report(panel: DataFrame, c: FeatureContract, cuts: list[str] | None = None) -> DataFrame:
    """One row per cut, by default per month of the panel: cells compared and cells that differ (must be 0).

    A cut no entity has a row for gives no row.
    """
    differs = F.filter(F.zip_with("full", "past", lambda a, b: ~a.eqNullSafe(b)), lambda d: d)
    return _replayed(panel, c, cuts).groupBy(F.col(PERIOD).alias("cut")).agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum(F.size(F.filter("full", lambda v: v.isNotNull())).cast("long")).alias("cells_present"),
        F.sum(F.size(differs).cast("long")).alias("cells_differing"),
    )


def early_features(features: DataFrame, c: FeatureContract) -> DataFrame:
    """Features observed before their declared reach allows (must be empty)."""
    return availability(features, c).filter(
        F.col("earliest_month_observed") < F.col("earliest_month_expected")
    ).select("feature", "earliest_month_expected", "earliest_month_observed")


def boundary_audit(split: DataFrame, horizon: int) -> DataFrame:
    """Per split boundary: when the earlier labels resolve, and when the later begins."""
    spans = split.filter(F.col("split").isin(*SPLITS)).agg(
        *[f(F.when(F.col("split") == s, F.col(PERIOD))).alias(f"{f.__name__}_{s}") for s in SPLITS for f in (F.min, F.max)]
    )
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("earlier"), F.lit(b).alias("later"),
            F.add_months(F.col(f"max_{a}"), horizon).alias("resolves"), F.col(f"min_{b}").alias("begins"),
        )
        for a, b in zip(SPLITS, SPLITS[1:])
    ])
    return spans.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "crosses", F.coalesce(F.col("resolves") > F.col("begins"), F.lit(False))
    )
