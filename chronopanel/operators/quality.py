"""Data-quality checks: every count from a few aggregations, one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ColumnSpec, Contracts, TargetContract, bounded
from ..schema import CLASSES, ENTITY, KEY, PERIOD

ERROR, WARN = "ERROR", "WARN"
MIN_CLASS_SHARE = 0.05


def outside(c: ColumnSpec, which: str) -> Column:
    low, high = getattr(c, which)
    x = F.col(c.name)
    return F.coalesce((x < low) | (x > high), F.lit(False))


def _present(columns, registry, which=None):
    return [
        c for c in bounded(registry)
        if c.name in columns and (which is None or getattr(c, which) is not None)
    ]


def key_facts(panel: DataFrame, t: TargetContract) -> DataFrame:
    """Repeats, entities, months, missing months, and target values too near either end: what counts per row cannot tell.

    The panel shrinks to (entity, month) cells before anything distinct is
    counted, and further to one row per calendar month.
    """
    cells = panel.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("has_target").alias("targets"), F.count("growth_yoy").alias("grown"))
    entities = cells.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("c")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("c").alias("rows"), F.sum(F.col("c") - F.col("m")).alias("repeats")
    )
    monthly = cells.groupBy(PERIOD).agg(F.sum("targets").alias("targets"), F.sum("grown").alias("grown"))
    months = monthly.agg(
        F.count(F.lit(1)).alias("months"), F.min(PERIOD).alias("lo"), F.max(PERIOD).alias("hi"),
        F.collect_list(F.struct(PERIOD, "targets", "grown")).alias("all")  # one entry per calendar month
    )

    def total(field, wanted):
        return F.aggregate(F.filter("all", wanted), F.lit(0).cast("long"), lambda n, m: n + m[field])

    m = months.select(F.struct(
        "months", "lo", "hi",
        total("targets", lambda x: F.add_months(x[PERIOD], t.horizon) > F.col("hi")).alias("late"),
        total("grown", lambda x: x[PERIOD] < F.add_months(F.col("lo"), t.lead_in)).alias("early"),
    )).scalar()
    lo, hi = m["lo"], m["hi"]
    span = ((F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) + 1).cast("long")
    return entities.select(
        "entities", "rows", "repeats", m["months"].alias("months"), span.alias("span"), m["late"].alias("late"), m["early"].alias("early"))


def additive_counts(columns: list[str], contracts: Contracts) -> list[Column]:
    """The checks' counts that add up row by row; a scan can aggregate them, and a write can observe them."""
    reg, t = contracts.registry, contracts.target
    hard, plausible, every = (_present(columns, reg, w) for w in ("hard", "plausible", None))
    model = F.col("is_included") & F.col("has_target")

    def total(conditions):
        return sum((F.count_if(c) for c in conditions), F.lit(0).cast("long"))

    return [
        F.count_if(~F.coalesce(F.col(ENTITY).rlike(contracts.staging.id_pattern), F.lit(False))).alias("bad_id"),
        F.count_if(F.dayofmonth(PERIOD) != 1).alias("bad_month"),
        F.count_if(F.col("prediction_as_of") <= F.col(PERIOD)).alias("bad_cutoff"),
        F.count(t.price_column).alias("priced"),
        total([outside(c, "hard") for c in hard]).alias("hard"),
        total([outside(c, "plausible") for c in plausible]).alias("plausible"),
        total([F.col(c.name).isNull() for c in every]).alias("nulls"),
        *[F.count_if(~F.col(f)).alias(f"gap_{f}") for f, _ in contracts.flags],
        F.count_if(~F.col("is_included")).alias("excluded_rows"),
        F.count_if(model).alias("model_rows"),
        *[F.count_if(model & (F.col("target_label") == c)).alias(f"n_{c}") for c in CLASSES],
    ]


def check_panel(panel: DataFrame, contracts: Contracts, observed: dict[str, int] | None = None) -> DataFrame:
    """(position, check, severity, passed, count): the 17 results, in report order.

    ``observed`` are the ``additive_counts`` of the write that made the panel; with
    them only the keys and two target columns are read again.
    """
    reg, rows = contracts.registry, F.col("rows")
    if observed is None:
        counts = panel.agg(*additive_counts(panel.columns, contracts))
    else:
        counts = panel.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(c) for c, n in observed.items()])
    keys = key_facts(panel, contracts.target)
    declared, actual = {c.name for c in reg}, set(panel.columns)
    undocumented = len(actual ^ declared)

    facts = counts.withColumn("_k", keys.select(F.struct(*keys.columns)).scalar()).select(*counts.columns, "_k.*")
    smallest = F.least(*[F.coalesce(F.try_divide(F.col(f"n_{c}"), F.col("model_rows")), F.lit(0.0)) for c in CLASSES])
    incomplete = F.abs(F.col("entities") * F.col("span") - rows)
    zero = lambda c: (F.col(c) == 0, F.col(c))
    table = [
        ("unique_county_month_key", ERROR, *zero("repeats")),
        ("county_fips_format", ERROR, *zero("bad_id")),
        ("reference_month_is_month_start", ERROR, *zero("bad_month")),
        ("complete_county_month_spine", ERROR, incomplete == 0, incomplete),
        ("contiguous_month_coverage", ERROR, F.col("span") == F.col("months"), F.col("span") - F.col("months")),
        ("prediction_cutoff_after_reference_month", ERROR, *zero("bad_cutoff")),
        ("documented_columns_match_panel", ERROR, F.lit(undocumented == 0), F.lit(undocumented)),
        ("target_price_series_present", ERROR, F.col("priced") > 0, F.col("priced")),
        ("values_within_hard_bounds", ERROR, *zero("hard")),
        ("extreme_but_possible_values", WARN, *zero("plausible")),
        ("column_missingness_measured", WARN, *zero("nulls")),
        *[(f"coverage_{f}", WARN, *zero(f"gap_{f}")) for f, _ in contracts.flags],
        ("target_horizon_within_coverage", ERROR, *zero("late")),
        ("target_leadin_months_unlabelled", ERROR, *zero("early")),
        ("target_inclusion_rule", WARN, *zero("excluded_rows")),
        ("target_class_prevalence", WARN, smallest >= MIN_CLASS_SHARE, F.col("model_rows")),
    ]
    checks = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("check"), F.lit(sev).alias("severity"),
            F.coalesce(ok, F.lit(False)).alias("passed"), cnt.cast("long").alias("count"),
        )
        for i, (n, sev, ok, cnt) in enumerate(table)
    ])
    return facts.select(F.explode(checks).alias("c")).select("c.*")


def failed_errors(checks: DataFrame) -> list[str]:
    """Names of failed ERROR checks (at most one row per declared check)."""
    return [r["check"] for r in checks.filter((F.col("severity") == ERROR) & ~F.col("passed")).collect()]


def schema_drift(panel: DataFrame, registry: tuple[ColumnSpec, ...]) -> DataFrame:
    """Columns documented but absent, or present but undocumented."""
    declared, actual = {c.name for c in registry}, set(panel.columns)
    rows = [(c, "undocumented") for c in sorted(actual - declared)] + [(c, "absent") for c in sorted(declared - actual)]
    return panel.sparkSession.createDataFrame(rows, "column string, problem string")


def _unpivot(wide: DataFrame, specs, fields: dict[str, str]) -> DataFrame:
    """One aggregated row with ``<prefix><i>`` columns -> one row per column."""
    shared = [c for c in wide.columns if not any(c.startswith(p) for p in fields.values())]
    cells = F.array(*[
        F.struct(F.lit(s.name).alias("column"), *[F.col(f"{p}{i}").alias(n) for n, p in fields.items()])
        for i, s in enumerate(specs)
    ])
    return wide.select(*shared, F.explode(cells).alias("c")).select(*shared, "c.*")


def bound_violations(panel: DataFrame, registry, which: str) -> DataFrame:
    """Per column: values outside the named bounds."""
    specs = _present(panel.columns, registry, which)
    wide = panel.agg(
        *[F.count_if(outside(c, which)).alias(f"v{i}") for i, c in enumerate(specs)],
        *[F.count(c.name).alias(f"n{i}") for i, c in enumerate(specs)],
    )
    return _unpivot(wide, specs, {"violations": "v", "observed": "n"})


def missingness(panel: DataFrame, registry) -> DataFrame:
    """Null count and rate per bounded column."""
    specs = _present(panel.columns, registry)
    wide = panel.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c.name).alias(f"n{i}") for i, c in enumerate(specs)])
    long = _unpivot(wide, specs, {"observed": "n"})
    nulls = F.col("rows") - F.col("observed")
    return long.select("column", nulls.alias("nulls"), F.try_divide(nulls, F.col("rows")).alias("null_rate"))


def worst_missing(panel: DataFrame, registry, top: int = 3) -> DataFrame:
    return missingness(panel, registry).orderBy(F.desc("null_rate"), "column").limit(top)
