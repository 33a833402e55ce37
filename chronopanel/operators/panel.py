"""The complete entity x month panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import Contracts
from ..functions.scalar import cutoff, month_start
from ..schema import ENTITY, KEY, NAME, PERIOD
from .rows import count_guard, join_accounting, validated_join


def month_range(start: Column, end: Column) -> Column:
    """Array of month starts, both ends included."""
    return F.sequence(month_start(start), month_start(end), F.expr("interval 1 month"))


def build_spine(entities: DataFrame, driver: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """Every entity at every month the driving source covers, as ``span`` says where the source has staged that apart.

    The window is one scalar subquery and the months are exploded next
    to each entity: no cross join, no broadcast, rows stay where they are.
    """
    bounds = driver.agg(F.min(PERIOD).alias("lo"), F.max(PERIOD).alias("hi")) if span is None else span
    window = bounds.select(F.struct("lo", "hi")).scalar()
    return entities.select(ENTITY, NAME, F.explode(month_range(window["lo"], window["hi"])).alias(PERIOD))


def build_panel(entities, housing, rate, labour, contracts: Contracts, by_entity: bool = False, span: DataFrame | None = None) -> DataFrame:
    """Left-join the staged sources onto the spine under a cardinality contract.

    ``by_entity`` moves every source by entity alone.  Guards and the windows of the
    target accept that as it is, joins on entity and month where the session allows it
    (``land`` does with ``co_located``): the joined rows, the widest of all, are then not
    moved again.  An entity has a row per month, so none is too large for a task, and
    months are exploded after the entities moved.
    """
    moved = (lambda df: df.repartition(ENTITY)) if by_entity else (lambda df: df)
    spine = build_spine(moved(entities), housing, span)
    panel = validated_join(spine, moved(housing.drop(NAME)), KEY, validate="one_to_one")
    # The guard leaves one row per calendar month, and the months a DATE can hold bound those.
    panel = panel.join(F.broadcast(count_guard(rate, [PERIOD], "rate")), PERIOD, "left")
    panel = validated_join(panel, moved(labour), KEY, validate="one_to_one")
    fc = contracts.features
    out = panel.withColumn("prediction_as_of", cutoff(F.col(PERIOD), fc.cutoff_months, fc.cutoff_day))
    for flag, column in contracts.flags:
        out = out.withColumn(flag, F.col(column).isNotNull())
    first = [ENTITY, NAME, PERIOD]
    return out.select(*first, *[c for c in out.columns if c not in first])


def join_report(entities, housing, rate, labour) -> DataFrame:
    """Matched and unmatched rows for each of the three joins."""
    spine = build_spine(entities, housing)
    return (
        join_accounting(spine, housing, KEY, "housing")
        .unionByName(join_accounting(spine, rate, [PERIOD], "mortgage_rate"))
        .unionByName(join_accounting(spine, labour, KEY, "unemployment"))
    )


def spine_report(spine: DataFrame) -> DataFrame:
    """Rows, entities, months and span of the spine, from counts per key."""
    by_month = spine.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("rows"))
    entities = spine.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count(F.lit(1)).alias("entities")
    )
    return by_month.agg(
        F.sum("rows").alias("spine_rows"),
        F.count(F.lit(1)).alias("months"),
        F.min(PERIOD).alias("coverage_start"),
        F.max(PERIOD).alias("coverage_end"),
    ).withColumn("entities", entities.scalar())
