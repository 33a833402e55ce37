import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from helpers import month, near
from pyspark.sql import functions as F

from chronopanel.contracts import FEATURES, PRODUCTION, SPLIT
from chronopanel.operators import learned as L
from chronopanel.operators import naive as N
from chronopanel.operators import split as S
from chronopanel.operators.audits import boundary_audit
from chronopanel.schema import CLASSES


@pytest.fixture(scope="module")
def rows(spark):
    months = [month(i, (2013, 1)) for i in range(160)]
    data = [(e, m, inc, True, "stable") for e, inc in (("06001", True), ("06003", False)) for m in months]
    df = spark.createDataFrame(data, "county_fips string, reference_month date, is_included boolean, has_target boolean, target_label string")
    return S.assign_split(df, SPLIT).cache()


def test_split_windows(rows):
    got = {r.reference_month: r.split for r in rows.filter("county_fips = '06001'").collect()}
    d = dt.date
    assert got[d(2014, 2, 1)] == "ineligible" and got[d(2014, 3, 1)] == "train" and got[d(2023, 11, 1)] == "train"
    assert got[d(2023, 12, 1)] == got[d(2024, 2, 1)] == "embargo" and got[d(2024, 3, 1)] == "validation"
    assert got[d(2024, 12, 1)] == "embargo" and got[d(2025, 3, 1)] == "test" and got[d(2026, 2, 1)] == "test"
    assert got[d(2026, 3, 1)] == "ineligible"
    assert {r.split for r in rows.filter("county_fips = '06003'").collect()} == {"ineligible"}


def test_split_report_and_boundaries(rows):
    r = {x.split: x for x in S.split_report(rows).collect()}
    assert (r["validation"].rows, r["test"].rows, r["embargo"].rows) == (9, 12, 6)
    assert r["train"].months == 117 and r["train"].entities == 1 and near(r["train"].share_stable, 1.0)
    assert not any(x.crosses for x in boundary_audit(rows, 3).collect())
    assert all(x.crosses for x in boundary_audit(rows, 5).collect())


def test_row_count_guard(rows):
    c = replace(SPLIT, expected_rows=(("test", 12), ("validation", 8), ("eligible", 144)))
    assert {x.split: x.passed for x in S.row_count_guard(rows, c).collect()} == {"test": True, "validation": False, "eligible": True}


def test_counts_are_recorded_by_the_write(spark, rows, tmp_path):
    path = str(tmp_path / "split")
    record = {x.split: x.expected for x in S.write_split(rows, path).collect()}
    found = {x.split: x.n for x in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert record == {n: found.get(n, 0) for n in ("train", "validation", "test", "embargo")} | {
        "eligible": sum(n for k, n in found.items() if k != "ineligible")}
    guard = lambda df: {x.split: x.passed for x in S.row_count_guard(df, None, S.recorded_counts(spark, path)).collect()}
    assert all(guard(spark.read.parquet(path)).values())
    less = guard(rows.filter("split <> 'test'"))
    assert not less["test"] and not less["eligible"] and less["train"]



def test_complete_features_can_be_required(spark):
    names = FEATURES.names()
    base = "true as is_included, true as has_target, date'2015-01-01' as reference_month"
    df = spark.sql(f"select {base}").select("*", *[F.lit(1.0).alias(n) for n in names])
    hole = df.withColumn(names[3], F.lit(None).cast("double"))
    c = replace(SPLIT, require_complete=True)
    got = S.assign_split(df.unionByName(hole), c, FEATURES).select("split").collect()
    assert sorted(r[0] for r in got) == ["ineligible", "train"]
    with pytest.raises(ValueError):
        S.assign_split(df, c)


FRAME = "target_dg double, target_label string, growth_yoy__diff3 double, growth_yoy__lag0 double, growth_yoy__rollmean12 double, price_smoothed__log_diff3_o9 double"


def fit(spark, rows):
    return N.fit_naive(spark.createDataFrame(rows, FRAME)).first()


def test_naive_fits(spark):
    r = fit(spark, [(1.0, "stable", None, 2.0, 0.0, 2.0), (3.0, "heating", None, 2.0, 0.0, 0.0)])
    assert near(r.drift, 3.0) and near(r.climatology, 2.0)
    r = fit(spark, [(-0.5 * g, "stable", None, g + 1.0, 1.0, None) for g in (-4.0, 1.0, 6.0)])
    assert near(r.k, 0.5) and near(r.drift, 0.0)
    r = fit(spark, [(0.0, c, None, None, None, None) for c in ["cooling"] * 6 + ["stable"] * 3 + ["heating"]])
    assert r.majority_label == "cooling" and near(r.majority_share, 0.6) and near(r.share_heating, 0.1) and near(r.k, 0.0)


def test_naive_predictions(spark):
    params = spark.sql("select 0.5D k, 3D drift, 0D climatology, 'stable' majority_label, .6D majority_share, .3D share_cooling, .6D share_stable, .1D share_heating")
    rows_ = [("06001", "A County", month(0), "thin", "test", b, 0.0, "stable", c, l, n)
             for b, c, l, n in ((2.0, 3.0, 4.0, 1.0), (None, -4.0, None, 1.0), (0.0, None, 1.0, 1.0))]
    schema = ("county_fips string, county_name string, reference_month date, volume_tier string, split string, price_smoothed__log_diff3_o9 double, "
              "target_dg double, target_label string, growth_yoy__diff3 double, growth_yoy__lag0 double, growth_yoy__rollmean12 double")
    out = N.predict_naive(spark.createDataFrame(rows_, schema), 2.0, params)
    by = {}
    for r in out.collect():
        by.setdefault(r.model, []).append(r)
    assert {r.predicted_dg for r in by["zero_change"]} == {0.0}
    assert sorted(r.predicted_dg for r in by["persistence"]) == [-4.0, 0.0, 3.0]
    assert sorted(r.predicted_dg for r in by["base_effect"]) == [1.0, 3.0, 3.0]
    assert sorted(r.predicted_dg for r in by["mean_reversion"]) == [-1.5, 0.0, 0.0]
    assert {r.predicted_label for r in by["majority_class"]} == {"stable"} and by["majority_class"][0].predicted_dg is None
    assert near(by["majority_class"][0].prob_heating, 0.1)


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(3)
    n, d = 400, 5
    x = rng.normal(size=(n, d)) * np.array([1, 10, 0.1, 3, 0]) + 2.0
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n)
    holes = rng.random((n, d)) < 0.1
    holes[:, 4] = False
    lab = np.array(CLASSES)[np.digitize(y - np.median(y), [-1.0, 1.0])]
    data = [tuple([None if holes[i, j] else float(x[i, j]) for j in range(d)] + [float(y[i]), str(lab[i])]) for i in range(n)]
    names = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names) + ", target_dg double, target_label string").repartition(4).cache()
    return df, names, np.where(holes, np.nan, x), y, lab


def standardised(x):
    med = np.nanmedian(x, axis=0)
    z = np.where(np.isnan(x), med, x)
    sd = z.std(axis=0)
    return (z - z.mean(axis=0)) / np.where(sd == 0, 1, sd), med


@pytest.mark.parametrize("alpha", [0.1, 100.0])
def test_ridge_closed_form(spark, xy, alpha):
    df, names, x, y, _ = xy
    z, med = standardised(x)
    want = np.linalg.solve(z.T @ z + alpha * np.eye(5), z.T @ (y - y.mean()))
    m = L.moments(df, names)
    model = L.solve_ridge(m, alpha)
    assert np.allclose(m.scaling.medians, med) and np.allclose(model.weights, want, atol=1e-8) and model.weights[4] == 0.0
    got = df.select("target_dg", model.prediction().alias("p")).toPandas().sort_values("target_dg")
    assert np.allclose(got["p"], (z @ want + y.mean())[np.argsort(y)], atol=1e-8)
    kept = L.solve_ridge(m, alpha, [0, 2])
    sub = z[:, [0, 2]]
    assert np.allclose(kept.weights, np.linalg.solve(sub.T @ sub + alpha * np.eye(2), sub.T @ (y - y.mean())), atol=1e-8)
    top = model.coefficients(spark).orderBy("rank").first()
    assert abs(top.coefficient) == pytest.approx(np.abs(want).max())


def probabilities(z, model):
    s = z @ model.weights.T + model.intercepts
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_logistic_optimum(xy):
    df, names, x, _, lab = xy
    z, _ = standardised(x)
    m = L.moments(df, names)
    v = L.assemble(df, m.scaling, ["target_label"])
    c = 0.5
    model = L.fit_logistic(v, m.scaling, c)
    w = model.weights
    p = probabilities(z, model)
    hot = np.array([[l == k for k in CLASSES] for l in lab], dtype=float)
    gradient = (p - hot).T @ z * c + w  # of C * loss + |w|^2 / 2
    assert np.abs(gradient).max() < 1e-6
    loose = L.fit_logistic(v, m.scaling, 1e4)  # almost no penalty, where slow methods stop short
    assert np.abs((probabilities(z, loose) - hot).T @ z + loose.weights / 1e4).max() < 1e-4
    with pytest.raises(RuntimeError, match="no optimum"):
        L.fit_logistic(v, m.scaling, c, most_steps=1)
    out = model.predict(v).toPandas()
    assert np.allclose(out[[f"prob_{k}" for k in CLASSES]].sum(axis=1), 1.0)
    assert set(out["predicted_label"]) <= set(CLASSES)


def test_absent_class_has_probability_zero(xy):
    df, names, *_ = xy
    two = df.filter("target_label <> 'heating'")
    m = L.moments(two, names)
    v = L.assemble(two, m.scaling, ["target_label"])
    out = L.fit_logistic(v, m.scaling, 1.0).predict(v)
    assert out.agg(F.max("prob_heating")).first()[0] == 0.0


def test_scans_choose_on_validation(xy):
    df, names, *_ = xy
    m = L.moments(df, names)
    full = df.withColumns({"predicted_label": F.lit(None).cast("string")})
    best, scores = L.scan_ridge(m, full, 1.0)
    table = {r.alpha: r.mae for r in scores.collect()}
    assert len(table) == 6 and table[best.alpha] == min(table.values())
    v = L.assemble(df, m.scaling, ["target_dg", "target_label"]).cache()
    best, scores = L.scan_logistic(v, v, m.scaling, 1.0, (0.01, 1.0))
    f1 = {r.C: r.macro_f1 for r in scores.collect()}
    assert f1[best.c] == max(f1.values())


def test_warm_starts_reach_the_same_optimum_in_fewer_steps(spark, xy):
    rng = np.random.default_rng(4)
    n, d = 400, 6
    x = rng.normal(size=(n, d)) @ (np.eye(d) + 0.3)
    y = (x @ rng.normal(size=(d, 3)) + rng.gumbel(size=(n, 3))).argmax(axis=1)
    s = L.Scaling(tuple(f"f{i}" for i in range(d)), np.zeros(d), np.zeros(d), np.ones(d))
    rows = spark.createDataFrame([(float(a), [float(v) for v in b]) for a, b in zip(y, x)], "label double, features array<double>").repartition(4)
    full = L.fit_logistic(rows, s, 1.0)
    keep = [0, 2, 3, 5]
    cold, warm = L.fit_logistic(rows, s, 1.0, keep), L.fit_logistic(rows, s, 1.0, keep, start=full.without(keep))
    assert np.allclose(cold.weights, warm.weights, atol=1e-7) and np.allclose(cold.intercepts, warm.intercepts, atol=1e-7)
    assert warm.steps < cold.steps and L.fit_logistic(rows, s, 1.0, start=full.without(list(range(d)))).steps <= 2
    # The same model on another scale of the features predicts the same, and starts the fit there at the optimum of a weaker shift.
    other = L.Scaling(s.features, s.medians, np.full(d, 0.5), np.full(d, 2.0))
    beta = full.rescaled(other)
    z = (x - 0.5) / 2
    assert np.allclose(z @ beta[:, :-1].T + beta[:, -1], x @ full.weights.T + full.intercepts)


def test_one_scan_scores_every_candidate(spark):
    from chronopanel.operators.metrics import evaluate
    from chronopanel.operators.naive import PROBS

    rng = np.random.default_rng(5)
    rows = [(float(v), c, [float(a) for a in rng.normal(size=2)]) for v, c in zip(rng.normal(size=60) * 3, rng.choice(["cooling", "stable", "heating"], 60))]
    df = spark.createDataFrame(rows, "target_dg double, target_label string, features array<double>")
    df = df.selectExpr("target_dg", "target_label", "1.0D AS price_smoothed__log_diff3_o9", "features")
    s = L.Scaling(("a", "b"), np.zeros(2), np.zeros(2), np.ones(2))
    ridge = L.RidgeModel(s, (0, 1), np.array([1.5, -2.0]), 0.25, 1.0)
    part = L.LogisticModel(s, (1,), np.array([[1.0], [0.0], [-2.0]]), np.array([0.1, -np.inf, 0.3]), 1.0, 1)
    got = {r.candidate: r for r in L.score_fits(df, 2.0, {"r": (ridge, None), "l": (None, part), "both": (ridge, part)}).collect()}
    own = part.predict(df.withColumn("label", F.lit(0.0)))
    alone = evaluate(own, []).first()
    for name in ("l", "both"):
        assert got[name].macro_f1 == pytest.approx(alone.macro_f1) and got[name].log_loss == pytest.approx(alone.log_loss)
    errors = [abs(1.5 * x[0] - 2 * x[1] + 0.25 - y) for y, _, x in rows]
    assert got["r"].mae == pytest.approx(np.mean(errors)) == got["both"].mae and got["l"].mae is None
    assert set(PROBS) == {"prob_cooling", "prob_stable", "prob_heating"}


def test_logistic_scores_are_plain_sums(spark):
    import numpy as np

    from chronopanel.operators import learned

    scaling = learned.Scaling(("a", "b"), np.zeros(2), np.zeros(2), np.ones(2))
    model = learned.LogisticModel(scaling, (1,), np.array([[1.0], [0.0], [-1.0]]), np.zeros(3), 1.0, 1)
    out = model.predict(spark.createDataFrame([(1.0, [7.0, 0.5]), (0.0, [7.0, -2.0])], "label double, features array<double>"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    for x, r in zip((0.5, -2.0), out.collect()):
        want = np.exp(np.array([x, 0.0, -x]))
        assert np.allclose([r[f"prob_{c}"] for c in learned.CLASSES], want / want.sum(), atol=1e-12)


def test_fits_read_landed_rows_and_cache_none(spark, xy, monkeypatch):
    """A cached partition of the widest rows is built in the heap; fits land their rows once, of which the standardised ones come to the last bit."""
    df, names, *_ = xy
    monkeypatch.setattr(type(df), "persist", lambda *a, **k: pytest.fail("rows were cached"))
    monkeypatch.setattr(type(df), "cache", lambda *a, **k: pytest.fail("rows were cached"))
    m = L.moments(df, names)
    own, direct = m.assembled(["target_dg", "target_label"]), L.assemble(df, m.scaling, ["target_dg", "target_label"])
    assert "FileScan parquet" in own._jdf.queryExecution().executedPlan().toString()
    as_rows = lambda d: sorted((r.target_dg, r.target_label, r.label, tuple(r.features)) for r in d.collect())
    assert as_rows(own) == as_rows(direct) and own.count() == df.count()
    fit = L.fit_logistic(own, m.scaling, 0.5)
    assert np.allclose(fit.weights, L.fit_logistic(direct, m.scaling, 0.5).weights, atol=1e-9)
    with pytest.raises(Exception, match="not a number"):
        L.moments(df.withColumn("f1", F.when(F.col("f1").isNull(), float("nan")).otherwise(F.col("f1"))), names)


def test_family_ablation_caches_no_rows(spark, monkeypatch):
    from chronopanel.plans.catalog import QUERIES

    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "persist", lambda *a, **k: pytest.fail("rows were cached"))
    assert QUERIES["family_ablation"](spark, "/root/testdata/sf0.001").count() > 0
