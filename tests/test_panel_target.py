import math
import os
from dataclasses import replace

import pytest
from helpers import column, month, near, price_panel, small_sources
from pyspark.sql import functions as F

from chronopanel.contracts import MEASURES, PRODUCTION, TARGET
from chronopanel.operators import panel as P
from chronopanel.operators import rows as R
from chronopanel.operators import target as T
from chronopanel.plans import catalog
from chronopanel.schema import ENTITY, KEY, NAME, PERIOD
from chronopanel.session import is_landed, joins_by_part_of_keys, release
from chronopanel.sources import staging

STEP = [100_000.0] * 12 + [110_000.0] * 6 + [121_000.0] * 6


@pytest.fixture(scope="module")
def small(spark):
    return small_sources(spark)


def test_small_panel(small):
    panel = P.build_panel(*small, PRODUCTION).cache()
    assert panel.count() == 8
    assert panel.filter("NOT has_redfin").count() == 1
    assert panel.filter("has_unemployment").count() == 8
    assert str(panel.filter("reference_month = '2024-01-01'").first().prediction_as_of) == "2024-02-15"


def test_join_report(small):
    got = {r.source: (r.spine_rows_matched, r.spine_rows_unmatched, r.source_rows_outside_spine) for r in P.join_report(*small).collect()}
    assert got == {"housing": (7, 1, 0), "mortgage_rate": (8, 0, 0), "unemployment": (8, 0, 0)}


def test_repeated_key_stops_the_job(small):
    entities, housing, rate, labour = small
    twice = housing.unionByName(housing.limit(1))
    with pytest.raises(Exception, match="key repeats"):
        P.build_panel(entities, twice, rate, labour, PRODUCTION).count()
    assert R.duplicate_keys(twice, KEY).first().copies == 2
    with pytest.raises(ValueError):
        R.validated_join(housing, labour, KEY, validate="many_to_many")


def test_spine_has_no_cross_join(small):
    plan = P.build_spine(small[0], small[1])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_accounting_charges_a_row_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (None, 1)], "a int, b int")
    tagged = R.tag(df, [("a is not 1", F.col("a") != 1), ("b is not 1", F.col("b") != 1)])
    assert {r.reason: r.rows for r in R.account(tagged, "s").collect()} == {"staged": 1, "a is not 1": 2, "b is not 1": 1}
    assert R.kept(tagged).count() == 1


def test_step_prices(spark):
    out = T.add_target(price_panel(spark, STEP), TARGET).cache()
    smoothed = column(out, "price_smoothed", "reference_month")
    growth = column(out, "growth_yoy", "reference_month")
    target = column(out, "target_dg", "reference_month")
    assert smoothed[:2] == [None, None] and near(smoothed[2], 100_000) and near(smoothed[12], 103_333.3333333, 1e-3)
    assert near(smoothed[14], 110_000) and near(smoothed[20], 121_000)
    assert growth[:14] == [None] * 14 and near(growth[14], 100 * math.log(1.1))
    assert near(target[14], 0.0) and near(target[17], 100 * math.log(1.1)) and target[-3:] == [None] * 3
    labels = column(out, "target_label", "reference_month")
    assert labels[17] == "heating" and labels[14] == "stable" and labels[0] is None
    assert column(out, "has_target", "reference_month")[:14] == [False] * 14


def test_gap_blocks_the_window(spark):
    prices = list(STEP)
    prices[5] = None
    s = column(T.add_target(price_panel(spark, prices), TARGET), "price_smoothed", "reference_month")
    assert s[5:8] == [None] * 3 and near(s[8], 100_000)


def test_no_bleed_across_entities(spark):
    two = price_panel(spark, STEP).unionByName(price_panel(spark, [9e5] * 24, "06003"))
    alone = T.add_target(price_panel(spark, STEP), TARGET)
    both = T.add_target(two, TARGET).filter("county_fips = '06001'")
    assert column(both, "target_dg", "reference_month") == column(alone, "target_dg", "reference_month")


def test_inclusion_without_volume_is_false(spark):
    p = price_panel(spark, STEP, sold=None).withColumn("homes_sold", F.col("homes_sold").cast("double"))
    out = T.add_target(p, TARGET)
    assert column(out, "is_included", "reference_month") == [False] * 24
    assert T.modelling_rows(out).count() == 0


def test_target_report_and_identity(spark):
    two = price_panel(spark, STEP).unionByName(price_panel(spark, STEP, "06003", sold=3.0))
    out = T.add_target(two, TARGET).cache()
    r = T.target_report(out).first()
    assert (r.panel_rows, r.entities, r.entities_excluded, r.included_rows) == (48, 2, 1, 24)
    assert r.rows_with_target == 14 and r.modelling_rows == 7
    assert near(r.share_cooling + r.share_stable + r.share_heating, 1.0)
    worst = T.base_effect_parts(out, TARGET).agg(F.max(F.abs("residual"))).first()[0]
    assert worst < 1e-9


def test_target_chain_shuffles_once(spark):
    plan = T.add_target(price_panel(spark, STEP), TARGET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_contract_refuses_other_methods():
    from dataclasses import replace

    with pytest.raises(ValueError):
        replace(TARGET, statistic="median")
    with pytest.raises(ValueError):
        replace(TARGET, growth="simple")


def test_sources_that_moved_by_entity_are_joined_where_they_lie(small, spark):
    plain = P.build_panel(*small, PRODUCTION)
    with joins_by_part_of_keys(spark):
        moved = P.build_panel(*small, PRODUCTION, by_entity=True)
        before = T.add_target(moved, TARGET)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, moved.collect())) == sorted(map(str, plain.collect()))
    joined = before[:before.index("SortMergeJoin")]
    assert "SortMergeJoin" in before and "Exchange hashpartitioning" not in joined  # nothing moves after the first join
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == "true"


def test_narrow_queries_neither_build_nor_write_the_whole_panel(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("test tables not present")
    release(spark)
    for name in ("coverage_by_entity", "eda_shift_scan", "results_tier_table", "results_intervals"):
        catalog.QUERIES[name](spark, folder).collect()
    assert not is_landed(spark, f"panel@{folder}") and not is_landed(spark, f"features@{folder}")
    assert "median_list_price" not in catalog.core(spark, folder).columns


def test_months_covered_are_those_of_the_staged_table(spark):
    """Regions off the list, other grains and unknown names bear no months; the plan looks a region up once."""
    row = lambda region, begin, days="30": (begin, days, "county", region, "AA", "All Residential", "2024-01-01", *[1.0] * len(MEASURES))
    raw = spark.createDataFrame(
        [row("Ash County, AA", "2020-02-01"), row("Ash County, AA", "2020-05-01"), row("Oak County, AA", "2020-04-01"),
         row("Elm County, AA", "2019-01-01"), row("Ash County, AA", "2021-01-01", "90"), row(None, "2022-01-01")],
        "period_begin string, period_duration string, region_type string, region string, state_code string, property_type string, last_updated string, "
        + ", ".join(f"{m} double" for m in MEASURES))
    entities = spark.createDataFrame([("01001", "Ash County", "ash"), ("01002", "Oak County", "oak")], f"{ENTITY} string, {NAME} string, county_name_key string")
    staged = staging.stage_housing(raw, entities, replace(PRODUCTION.staging, state_abbrev="AA"))
    assert staged.span.first() == staged.table.agg(F.min(PERIOD), F.max(PERIOD)).first()
    assert list(map(str, staged.span.first())) == ["2020-02-01", "2020-05-01"]
    spine = P.build_spine(entities, staged.table, staged.span)
    assert sorted(map(str, spine.collect())) == sorted(map(str, P.build_spine(entities, staged.table).collect()))
