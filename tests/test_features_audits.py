import datetime as dt
from dataclasses import replace

import pytest
from helpers import column, long_panel, month, near
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronopanel.contracts import (
    DERIVED, EXCLUDED, FEATURES, FILLS, HOUSING, LABOUR, TARGET, TIMINGS, FillPolicy, FeatureContract,
)
from chronopanel.functions import transforms as X
from chronopanel.operators import audits as A
from chronopanel.operators import features as B
from chronopanel.operators import target as T


@pytest.fixture(scope="module")
def panel(spark):
    return T.add_target(long_panel(spark), TARGET).cache()


@pytest.fixture(scope="module")
def matrix(panel):
    return B.build_features(panel, FEATURES).cache()


def series(df, name, entity="06001"):
    return column(df.filter(F.col("county_fips") == entity), name, "reference_month")


def test_shape(panel, matrix):
    assert matrix.count() == panel.count() == 144
    assert set(FEATURES.names()) <= set(matrix.columns)


def test_hand_computed_transforms(panel, matrix):
    x = series(panel, "homes_sold")
    u = series(B.fill_gaps(panel, FEATURES), "unemployment_rate")
    lag0, diff3 = series(matrix, "unemployment_rate__lag0"), series(matrix, "unemployment_rate__diff3")
    assert all(near(lag0[i], u[i - 2]) for i in range(2, 48)) and lag0[:2] == [None, None]
    assert all(near(diff3[i], u[i - 2] - u[i - 5]) for i in range(5, 48))
    mean, trend = series(matrix, "homes_sold__rollmean12"), series(matrix, "homes_sold__reltrend12")
    assert mean[10] is None and near(mean[11], sum(x[:12]) / 12) and near(trend[30], x[30] / mean[30] - 1)
    g = series(panel, "growth_yoy")
    sd = series(matrix, "growth_yoy__rollstd6")
    w = g[25:31]
    assert near(sd[30], (sum((v - sum(w) / 6) ** 2 for v in w) / 5) ** 0.5)


def test_scale_free_features_agree_across_entities(matrix):
    a, b = series(matrix, "homes_sold__reltrend12"), series(matrix, "homes_sold__reltrend12", "06003")
    assert all(near(x, y, 1e-9) for x, y in zip(a, b))


def test_zero_counts_have_no_growth(panel):
    zero = panel.withColumn("pending_sales", F.when(F.col("reference_month") == "2019-01-01", 0.0).otherwise(F.col("pending_sales")))
    got = series(B.build_features(zero, FEATURES), "pending_sales__log_diff3")
    assert got[12] is None and got[15] is None and got[13] is not None


def test_fill_is_flagged_and_capped(spark, panel):
    filled = B.fill_gaps(panel, FEATURES)
    at = [r for r in filled.filter("unemployment_imputed = 1").collect()]
    assert {r.reference_month for r in at} == {dt.date(2020, 6, 1)} and len(at) == 3
    assert near(series(filled, "unemployment_rate")[29], series(panel, "unemployment_rate")[28])
    hole = panel.withColumn("unemployment_rate", F.when(F.col("reference_month").between("2019-01-01", "2019-06-01"), None).otherwise(F.col("unemployment_rate")))
    capped = series(B.fill_gaps(hole, FEATURES), "unemployment_rate")
    assert capped[14] is not None and capped[15:18] == [None] * 3
    free = replace(FEATURES, fills=(FillPolicy(LABOUR, 0, "unemployment_imputed"),))
    assert None not in series(B.fill_gaps(hole, free), "unemployment_rate")
    with pytest.raises(ValueError):
        FillPolicy(LABOUR, 3, None, "mean")


def test_indicator_carries_the_release_lag(matrix):
    flag = series(matrix, "unemployment_imputed")
    assert flag[31] == 1.0 and flag[29] == 0.0


def test_forward_shift_is_refused():
    w = Window.partitionBy("a").orderBy("b")
    with pytest.raises(ValueError, match="backward"):
        X.shift(F.col("x"), -1, w)
    with pytest.raises(KeyError):
        X.apply_transform(F.col("x"), "ewm", 3, 0, w)


def test_specs_are_validated():
    def declare(*row):
        return FeatureContract(TIMINGS, FILLS, EXCLUDED, (row,))

    with pytest.raises(ValueError, match="excluded"):
        declare("price_drops", HOUSING, "f", 0, {"lag": (0,)})
    with pytest.raises(ValueError, match="source"):
        declare("x", "nowhere", "f", 0, {"lag": (0,)})
    with pytest.raises(ValueError, match="transform"):
        declare("x", HOUSING, "f", 0, {"ewm": (3,)})
    with pytest.raises(ValueError, match="negative"):
        declare("x", HOUSING, "f", 0, {"lag": (-1,)})
    with pytest.raises(ValueError, match="duplicate"):
        declare("x", HOUSING, "f", 0, {"lag": (1, 1)})
    spec = declare("price_smoothed", DERIVED, "f", 9, {"log_diff": (3,)}).features[0]
    assert (spec.name, spec.lag, spec.reach) == ("price_smoothed__log_diff3_o9", 9, 12)


def test_new_transform_can_be_registered(panel):
    X.register_transform("double_lag", lambda x, p, lag, w: 2 * X.shift(x, lag + p, w), lambda p: p)
    c = FeatureContract(TIMINGS, (), EXCLUDED, [("homes_sold", HOUSING, "f", 0, {"double_lag": (1,)})])
    x, got = series(panel, "homes_sold"), series(B.build_features(panel, c), "homes_sold__double_lag1")
    assert got[0] is None and near(got[5], 2 * x[4])


def test_broken_spine_stops_the_job(panel):
    gap = panel.filter("NOT (county_fips = '06003' AND reference_month = '2019-05-01')")
    twice = panel.unionByName(panel.filter("county_fips = '06005' AND reference_month = '2019-05-01'"))
    for bad in (gap, twice):
        with pytest.raises(Exception, match="spine is incomplete"):
            B.build_features(bad, FEATURES).count()
        with pytest.raises(ValueError, match="incomplete"):
            A.assert_complete_spine(bad)
    # A repeat that makes up for a gap fools a row count, not this check.
    both = gap.unionByName(panel.filter("county_fips = '06003' AND reference_month = '2019-06-01'"))
    assert [r.county_fips for r in A.spine_gaps(both).collect()] == ["06003"]
    A.assert_complete_spine(panel)


def test_missing_panel_column(panel):
    with pytest.raises(KeyError, match="inventory"):
        B.build_features(panel.drop("inventory"), FEATURES)


@pytest.mark.parametrize("cut", ["2019-11-01", "2020-09-01", "2021-05-01"])
def test_truncation_replay(panel, cut):
    r = A.replay_report(panel, FEATURES, [cut]).first()
    assert r.cells_differing == 0 and r.cells_present > 0


def test_replay_catches_a_leak(panel):
    X.register_transform("peek", lambda x, p, lag, w: F.lead(x, p).over(w), lambda p: 0)
    c = FeatureContract(TIMINGS, (), EXCLUDED, [("homes_sold", HOUSING, "f", 0, {"peek": (1,), "lag": (1,)})])
    bad = A.replay_diff(panel, c, "2020-03-01").collect()
    assert all(r.differing_features == ["homes_sold__peek1"] for r in bad) and len(bad) == 3


def test_replay_over_all_months(panel):
    every = {r.cut.isoformat(): (r.entities, r.cells_present, r.cells_differing) for r in A.replay_report(panel, FEATURES).collect()}
    months = {r[0].isoformat() for r in panel.select("reference_month").distinct().collect()}
    assert set(every) == months and all(d == 0 for _, _, d in every.values())
    some = A.replay_report(panel, FEATURES, ["2020-09-01", "2021-05-01", "1900-01-01"]).collect()
    assert {r.cut.isoformat(): (r.entities, r.cells_present, r.cells_differing) for r in some} == {
        k: every[k] for k in ("2020-09-01", "2021-05-01")}


def test_replay_reports_reading_beyond_the_declared_reach(panel):
    X.register_transform("deep", lambda x, p, lag, w: F.lag(x, p).over(w), lambda p: 0)
    c = FeatureContract(TIMINGS, (), EXCLUDED, [("homes_sold", HOUSING, "f", 0, {"deep": (9,), "lag": (1,)})])
    assert all(r.differing_features == ["homes_sold__deep9"] for r in A.replay_diff(panel, c, "2020-09-01").collect())
    assert A.replay_report(panel, c, ["2020-09-01"]).first().cells_differing > 0


def test_publication_audit(panel):
    got = A.publication_audit(panel, FEATURES).collect()
    assert len(got) == 61 and not any(r.leaks for r in got) and min(r.min_margin_days for r in got) >= 0
    short = A.publication_audit(panel, FEATURES.with_release_lag(LABOUR, 1)).filter("leaks").collect()
    assert {r.source for r in short} == {LABOUR} and len(short) == 4


def test_reach_is_honest(matrix):
    assert A.early_features(matrix, FEATURES).count() == 0
    av = {r.feature: r for r in B.availability(matrix, FEATURES).collect()}
    assert av["homes_sold__rollmean12"].earliest_month_observed == month(11, (2018, 1))
    assert av["growth_yoy__lag0"].earliest_month_observed == month(14, (2018, 1))


def test_feature_report(matrix):
    r = B.feature_report(matrix, FEATURES).first()
    assert (r.rows, r.feature_count, r.max_reach_months, r.unemployment_imputed_cells) == (144, 61, 14, 3)
    assert 0 < r.complete_modelling_rows <= r.modelling_rows <= r.rows


def test_cutoff_matches_column(panel):
    assert A.cutoff_mismatches(panel, FEATURES).count() == 0


def test_matrix_is_one_shuffle(panel):
    panel.count()
    plan = B.build_features(panel, FEATURES)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("Exchange") <= 1 and plan.count("Sort [") <= 1
