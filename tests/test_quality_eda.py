import datetime as dt
import re
from dataclasses import replace

import numpy as np
import pytest
from helpers import column, long_panel, month, near, small_sources
from pyspark.sql import Observation
from pyspark.sql import functions as F

from chronopanel.contracts import PRODUCTION, REGISTRY, TARGET
from chronopanel.operators import eda as E
from chronopanel.operators import panel as P
from chronopanel.operators import profile as O
from chronopanel.operators import quality as C
from chronopanel.operators import target as T
from chronopanel.session import land


@pytest.fixture(scope="module")
def small_panel(spark):
    return T.add_target(P.build_panel(*small_sources(spark), PRODUCTION), TARGET).cache()


def checks(panel):
    return {r.check: r for r in C.check_panel(panel, PRODUCTION).collect()}


def test_clean_panel_has_no_errors(small_panel):
    got = checks(small_panel)
    assert len(got) == 17
    assert [k for k, r in got.items() if r.severity == "ERROR" and not r.passed] == []
    assert got["coverage_has_redfin"]["count"] == 1 and not got["coverage_has_redfin"].passed


@pytest.mark.parametrize("change,check", [
    (lambda p: p.unionByName(p.limit(1)), "unique_county_month_key"),
    (lambda p: p.withColumn("county_fips", F.lit("6037")), "county_fips_format"),
    (lambda p: p.withColumn("county_fips", F.lit(None).cast("string")), "county_fips_format"),
    (lambda p: p.withColumn("reference_month", F.date_add("reference_month", 4)), "reference_month_is_month_start"),
    (lambda p: p.filter("NOT (county_fips = '06001' AND reference_month = '2024-02-01')"), "complete_county_month_spine"),
    (lambda p: p.filter("reference_month <> '2024-02-01'"), "contiguous_month_coverage"),
    (lambda p: p.withColumn("prediction_as_of", F.col("reference_month")), "prediction_cutoff_after_reference_month"),
    (lambda p: p.drop("price_drops"), "documented_columns_match_panel"),
    (lambda p: p.withColumn("extra", F.lit(1)), "documented_columns_match_panel"),
    (lambda p: p.withColumn("median_sale_price", F.lit(None).cast("double")), "target_price_series_present"),
    (lambda p: p.withColumn("median_sale_price", F.lit(-5.0)), "values_within_hard_bounds"),
    (lambda p: p.withColumn("has_target", F.lit(True)), "target_horizon_within_coverage"),
    (lambda p: p.withColumn("growth_yoy", F.lit(1.0)), "target_leadin_months_unlabelled"),
])
def test_negative_controls(small_panel, change, check):
    bad = change(small_panel)
    assert not checks(bad)[check].passed
    assert check in C.failed_errors(C.check_panel(bad, PRODUCTION))


def test_observed_counts_equal_scanned_ones(spark, small_panel):
    bad = small_panel.unionByName(small_panel.limit(1)).withColumn("median_sale_price", F.lit(-5.0)).withColumn("county_fips", F.lit("6037"))
    for panel in (small_panel, bad, small_panel.limit(0)):
        seen = Observation("counts")
        landed = land(panel, "observed", bucket_by="county_fips", observe=(seen, C.additive_counts(panel.columns, PRODUCTION)))
        got = C.check_panel(landed, PRODUCTION, seen.get)
        assert sorted(got.collect()) == sorted(C.check_panel(panel, PRODUCTION).collect())
        scans = re.findall(r"ReadSchema: struct<(.*?)>", got._jdf.queryExecution().executedPlan().toString())
        assert scans and all("county_fips" in s and "median_sale_price" not in s for s in scans), scans  # keys and target columns


def test_row_at_a_position(spark):
    rows = [(g, f"{'a' * 40}{i % 7}{i}") for g in ("x", None, "y") for i in range(50)] + [("x", None), ("x", "b" * 5), ("x", "b" * 5)]
    df = spark.createDataFrame(rows, "g string, t string").withColumn("at", F.when(F.col("g") == "y", 3).otherwise(0))
    in_order = lambda g: sorted((t for k, t in rows if k == g), key=lambda t: (t is not None, t or ""))
    got = E.select_at(df, ["g"], "t", "at").collect()
    assert {r.g: r.t for r in got} == {"x": None, None: in_order(None)[0], "y": in_order("y")[3]} and len(got) == 3


def test_drift_and_bounds(small_panel):
    drift = {(r.column, r.problem) for r in C.schema_drift(small_panel.drop("price_drops").withColumn("x", F.lit(1)), REGISTRY).collect()}
    assert drift == {("price_drops", "absent"), ("x", "undocumented")}
    odd = small_panel.withColumn("unemployment_rate", F.lit(45.0))
    assert {r.column: r.violations for r in C.bound_violations(odd, REGISTRY, "plausible").collect()}["unemployment_rate"] == 8
    miss = {r.column: r for r in C.missingness(small_panel, REGISTRY).collect()}
    assert miss["homes_sold"].nulls == 1 and near(miss["homes_sold"].null_rate, 1 / 8)
    worst = C.worst_missing(small_panel, REGISTRY).collect()
    assert [(r.column, r.nulls) for r in worst] == [("growth_yoy", 8), ("target_dg", 8), ("price_smoothed", 5)]


def test_coverage_and_profile(small_panel):
    low = E.lowest_coverage(small_panel).first()
    assert low.county_fips == "06003" and near(low.coverage, 0.75)
    p = {r.column: r for r in O.observe(small_panel).collect()}
    assert p["county_fips"].distinct == 2 and near(p["has_redfin"].share_true, 7 / 8)
    assert near(p["median_sale_price"].median, 501_000) and p["reference_month"].last_date == dt.date(2024, 4, 1)
    d = O.dictionary(small_panel, REGISTRY).collect()
    assert len(d) == 36 and all(r.meaning for r in d)


@pytest.fixture(scope="module")
def eda_panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for e, (vol, noise) in enumerate(((3000.0, 0.004), (150.0, 0.02), (14.0, 0.1), (3.0, 0.25))):
        for i in range(60):
            price = 500_000 * np.exp(0.004 * i + rng.normal(scale=noise))
            rows.append((f"0600{e}", f"E{e} County", month(i, (2019, 1)), float(price), vol, 3.0 + i * 0.08, 5.0))
    df = spark.createDataFrame(rows, "county_fips string, county_name string, reference_month date, median_sale_price double, homes_sold double, mortgage_rate_30y double, unemployment_rate double")
    return T.add_target(df, TARGET).cache()


def test_thin_markets_are_noisier(eda_panel):
    model = T.modelling_rows(eda_panel).cache()
    rows = E.dispersion(model).orderBy(F.desc("volume")).collect()
    assert len(rows) == 3 and rows[0].dg_sd < rows[1].dg_sd < rows[2].dg_sd
    assert [r.county_fips for r in E.excluded_dispersion(eda_panel).collect()] == ["06003"]
    assert {r.county_fips: r.excluded for r in E.labelled_dispersion(eda_panel, TARGET).collect()}["06003"] is True


def test_shares_sum_to_one(eda_panel):
    model = T.modelling_rows(eda_panel).cache()
    for df in (E.prevalence_by_year(model), E.prevalence_by_tier(model, TARGET), E.prevalence_by_entity(model), E.rate_regimes(model, PRODUCTION)):
        assert all(near(r.cooling + r.stable + r.heating, 1.0) for r in df.collect())
    assert sorted(r.target_label for r in E.prevalence(model).collect()) == ["cooling", "heating", "stable"]
    assert near(E.prevalence(model).agg(F.sum("share")).first()[0], 1.0)


def test_distribution_and_histogram(eda_panel):
    model = T.modelling_rows(eda_panel).cache()
    x = np.array(column(model, "target_dg", "target_dg"))
    d = E.describe_target(model).first()
    assert near(d.median, np.median(x)) and near(d.q0_05, np.quantile(x, 0.05)) and near(d.iqr, np.quantile(x, 0.75) - np.quantile(x, 0.25))
    assert near(d["std"], x.std(ddof=1)) and near(d.abs_median, np.median(np.abs(x)))
    h = E.histogram(model).orderBy("bin").collect()
    want, _ = np.histogram(x, bins=np.arange(-30, 31))
    assert [r.rows for r in h] == want.tolist()
    t = E.omitted_tails(model).first()
    assert t.below == (x < -30).sum() and t.above == (x > 30).sum()


def test_seasonality_and_series(eda_panel):
    model = T.modelling_rows(eda_panel).cache()
    s = E.seasonality(model).orderBy("month").collect()
    assert [r.abbr for r in s] == list(E.MONTHS) and all(near(r.z, r["mean"] / r.stderr) for r in s)
    r = E.regime_series(model).orderBy("reference_month").collect()
    means = [x["mean"] for x in r]
    assert r[10].rolling_12m_mean is None and near(r[11].rolling_12m_mean, np.mean(means[:12])) and near(r[20].rolling_12m_sd, np.std(means[9:21], ddof=1))


def test_regime_shifts(spark):
    rows = [("e", month(i), 5.0 if i >= 30 else 0.0) for i in range(60)]
    model = spark.createDataFrame(rows, "county_fips string, reference_month date, target_dg double")
    got = E.regime_shifts(model).orderBy("rank").collect()
    assert got[0].month == month(30) and near(got[0].shift, 5.0)
    days = sorted(r.month for r in got)
    assert all((b - a).days >= 360 for a, b in zip(days, days[1:]))
    scan = E.shift_scan(model)
    assert scan.count() == 60 - 24 and scan.agg(F.max("month")).first()[0] == month(47)
    assert E.regime_shifts(model.limit(20)).count() == 0


def test_outliers_and_representatives(spark, eda_panel):
    assert E.outliers(eda_panel.withColumn("growth_yoy", F.lit(0.0)).withColumn("target_dg", F.lit(0.0)), REGISTRY).count() == 0
    odd = eda_panel.withColumn("unemployment_rate", F.when(F.col("county_fips") == "06001", 50.0).otherwise(5.0))
    r = {x.column: x for x in E.outliers(odd, REGISTRY).collect()}["unemployment_rate"]
    assert (r.extreme_values, r.share, r.counties) == (60, 0.25, "E1 County")
    rows = [("thin", f"e{i}", f"E{i}", v) for i, v in enumerate((5.0, 7.0, 7.0, 7.0, 9.0, 11.0))]
    m = spark.createDataFrame(rows, "volume_tier string, county_fips string, county_name string, homes_sold_median double")
    assert E.representatives(m).first().county_fips == "e3"
