"""Staging jobs: one raw source in, one normalised table plus row accounting out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import LABOUR_MEASURES, MEASURES, StagingContract
from ..functions import scalar as S
from ..operators.rows import REASON, Staged, account, count_guard, kept, tag, validated_join
from ..schema import ENTITY, NAME, PERIOD


def stage_entities(raw: DataFrame, c: StagingContract) -> Staged:
    """Entity codes -> (id, name, name key), and the state's abbreviation where the codes carry one.

    With it, names are looked up within their state, as they repeat between states.
    """
    rules = [] if c.state is None else [("other state", F.col("statefp") != c.state)]
    tagged = tag(raw, rules) if rules else raw.withColumn(REASON, F.lit(None).cast("string"))
    table = kept(tagged).select(
        S.compose_id(F.col("statefp"), F.col("countyfp"), c.state_width, c.county_width).alias(ENTITY),
        F.trim("countyname").alias(NAME),
        S.name_key(F.col("countyname")).alias("county_name_key"),
        *([F.trim("state").alias("state_code")] if "state" in raw.columns else []),
    )
    return Staged("entities", table, tagged)


def stage_housing(raw: DataFrame, entities: DataFrame, c: StagingContract) -> Staged:
    """Bulk rows -> one row per entity-month.

    The four-predicate filter runs before the name lookup, so only rows that
    qualify are shuffled.  Rows rejected by it are needed for the accounting
    only and are cut away by the plan when the table alone is asked for.
    """
    wanted = (
        (F.col("region_type") == c.region_type)
        & (F.col("period_duration").try_cast("int") == c.duration)
        & (F.col("property_type") == c.property_type)
    )
    if c.state_abbrev is not None:
        wanted = wanted & (F.col("state_code") == c.state_abbrev)
    off_grain = ("not an entity-month aggregate row", ~wanted)

    by = ["county_name_key", *(["state_code"] if "state_code" in entities.columns else [])]
    lookup = entities.select(ENTITY, NAME, *by)
    keyed = raw.withColumn("county_name_key", S.name_key(F.col("region")))
    unmatched = ("name not in the reference list", F.col(ENTITY).isNull())

    table = kept(tag(
        validated_join(keyed.filter(wanted), lookup, by, validate="many_to_one"), [unmatched]
    )).select(
        ENTITY, NAME, S.month_start(F.col("period_begin")).alias(PERIOD), *MEASURES,
        F.col("last_updated").try_cast("timestamp").alias("redfin_last_updated"),
    )
    tagged = tag(validated_join(keyed, lookup, by, validate="many_to_one"), [off_grain, unmatched])
    # The months covered, from one row per region: so names are normalised and looked up once each, not once per month.
    month = S.month_start(F.col("period_begin"))
    regions = raw.filter(wanted).groupBy("region", *by[1:]).agg(F.min(month).alias("lo"), F.max(month).alias("hi"))
    known = kept(tag(validated_join(
        regions.withColumn("county_name_key", S.name_key(F.col("region"))), lookup, by, validate="many_to_one"), [unmatched]))
    return Staged("housing", table, tagged, known.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def unmatched_names(staged: Staged) -> DataFrame:
    """Names that the reference list does not know, with their rows."""
    return (
        staged.tagged.filter(F.col(REASON) == "name not in the reference list")
        .groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    )


def stage_rate(raw: DataFrame) -> Staged:
    """Weekly national series -> one row per month."""
    typed = raw.select(
        S.to_date(F.col("observation_date")).alias("observation_date"),
        S.to_number(F.col("mortgage30us")).alias("rate"),
    )
    tagged = tag(typed, [("missing or non-numeric rate", F.col("rate").isNull())])
    table = rollup_months(kept(tagged))
    return Staged("mortgage_rate", table, tagged)


def rollup_months(weekly: DataFrame) -> DataFrame:
    """Mean, latest value, number of observations and last date per month."""
    day = F.col("observation_date")
    return weekly.groupBy(S.month_start(day).alias(PERIOD)).agg(
        F.avg("rate").alias("mortgage_rate_30y"),
        F.max_by("rate", day).alias("mortgage_rate_30y_last"),
        F.count(F.lit(1)).alias("mortgage_rate_weeks_observed"),
        F.max(day).alias("mortgage_rate_last_release"),
    )


def labour_series(series: DataFrame, c: StagingContract) -> DataFrame:
    """Series metadata -> (series_id, entity id, measure) for the wanted series."""
    prefix = c.area_prefix + (c.state or "")
    names = F.create_map(*[F.lit(x) for kv in LABOUR_MEASURES.items() for x in kv])
    return series.filter(
        (F.col("area_type_code") == c.area_type)
        & F.col("area_code").startswith(prefix)
        & F.col("measure_code").isin(*LABOUR_MEASURES)
    ).select(
        "series_id",
        F.substring("area_code", len(c.area_prefix) + 1, c.id_width).alias(ENTITY),
        names[F.col("measure_code")].alias("measure"),
    )


def widen_labour(long: DataFrame) -> DataFrame:
    """Long (entity, month, measure, value) -> one column per measure.

    The measures are declared, so the pivot is one conditional aggregate each:
    a single shuffle, combined map-side.  A measure given twice for an entity and
    month is an error, not a choice.
    """
    names = sorted(LABOUR_MEASURES.values())
    own = {m: F.when(F.col("measure") == m, F.col("value")) for m in names}
    wide = long.groupBy(ENTITY, PERIOD).agg(
        *[F.min(v).alias(m) for m, v in own.items()], *[F.count(v).alias(f"_n_{m}") for m, v in own.items()])
    twice = F.concat_ws(" ", F.lit("measure given twice for"), ENTITY, F.col(PERIOD).cast("string"))
    once = F.when(F.greatest(*[F.col(f"_n_{m}") for m in names]) > 1, F.raise_error(twice).cast("boolean")).otherwise(True)
    return wide.filter(once).select(ENTITY, PERIOD, *names)


def stage_labour(observations: DataFrame, series: DataFrame, entities: DataFrame, c: StagingContract) -> Staged:
    """Long labour observations -> wide table per entity-month."""
    wanted = labour_series(series, c)
    non_month = ("annual average or non-monthly period", ~S.is_month_code(F.col("period")))
    foreign = ("not a wanted series", F.col(ENTITY).isNull())
    unusable = ("unparseable date or suppressed value", F.col(PERIOD).isNull() | F.col("value").isNull())

    def decoded(df):
        return df.withColumn(PERIOD, S.coded_month(F.col("year"), F.col("period"))).withColumn(
            "value", S.to_number(F.col("value"))
        )

    joined = decoded(observations.filter(S.is_month_code(F.col("period")))).join(count_guard(wanted, ["series_id"], "series"), "series_id")
    long = joined.filter(F.col(PERIOD).isNotNull() & F.col("value").isNotNull())
    table = widen_labour(long).join(entities.select(ENTITY), ENTITY, "left_semi")
    tagged = tag(decoded(observations).join(wanted, "series_id", "left"), [non_month, foreign, unusable])
    return Staged("unemployment", table, tagged)


def staging_report(staged: list[Staged]) -> DataFrame:
    """Accounting of every source in one frame."""
    out = None
    for s in staged:
        part = account(s.tagged, s.source)
        out = part if out is None else out.unionByName(part)
    return out


def unknown_entities(long_or_wide: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose entity is not in the reference list."""
    return long_or_wide.join(entities.select(ENTITY), ENTITY, "left_anti")
