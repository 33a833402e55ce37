import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from helpers import near, preds
from pyspark.sql import functions as F

from chronopanel.contracts import TARGET, BootstrapContract
from chronopanel.operators import bootstrap as B
from chronopanel.operators import metrics as M
from chronopanel.operators import quantiles as Q
from chronopanel.operators import results as R


def simple(spark, pairs, labels=None, probs=None):
    rows = []
    for i, (y, p) in enumerate(pairs):
        a, b = labels[i] if labels else (None, None)
        rows.append(("m", "06001", i, "thin", 0.0, y, a, p, b, probs[i] if probs else None))
    return preds(spark, rows)


def test_magnitude(spark):
    r = M.evaluate(simple(spark, [(0.0, 1.0), (0.0, -2.0), (0.0, 3.0), (1.0, 1.0), (None, 5.0), (2.0, None)]), []).first()
    assert (r.n, r.mae) == (4, 1.5) and near(r.rmse, math.sqrt(3.5)) and near(r.mean_error, 0.5) and near(r.medae, 1.5)
    assert r.accuracy is None and r.log_loss is None


def test_direction_majority_guess(spark):
    truth = ["stable"] * 8 + ["cooling", "heating"]
    r = M.evaluate(simple(spark, [(None, None)] * 10, [(t, "stable") for t in truth]), ["model"]).first()
    assert r.n == 10 and near(r.accuracy, 0.8) and near(r.balanced_accuracy, 1 / 3) and near(r.macro_f1, (2 * 0.8 / 1.8) / 3)
    c = {x.actual: (x.cooling, x.stable, x.heating) for x in M.confusion(simple(spark, [(None, None)] * 10, [(t, "stable") for t in truth]), ["model"]).collect()}
    assert c == {"cooling": (0, 1, 0), "stable": (0, 8, 0), "heating": (0, 1, 0)}
    p = {x["class"]: x for x in M.per_class(simple(spark, [(None, None)] * 10, [(t, "stable") for t in truth]), ["model"]).collect()}
    assert p["cooling"].precision == 0.0 and p["cooling"].f1 == 0.0 and (p["stable"].support, p["stable"].predicted) == (8, 10)


def test_probabilities(spark):
    df = simple(spark, [(None, None)] * 2, [("cooling", "cooling"), ("heating", "heating")], [(0.7, 0.2, 0.1), (0.2, 0.3, 0.5)])
    r = M.evaluate(df, []).first()
    assert near(r.log_loss, -(math.log(0.7) + math.log(0.5)) / 2) and near(r.brier, (0.14 + 0.38) / 2)
    scaled = df.withColumns({p: F.col(p) * 3 for p in ("prob_cooling", "prob_stable", "prob_heating")})
    assert near(M.evaluate(scaled, []).first().brier, (0.14 + 0.38) / 2)
    wrong = simple(spark, [(None, None)], [("cooling", "heating")], [(0.0, 0.0, 1.0)])
    r = M.evaluate(wrong, []).first()
    assert near(r.brier, 2.0) and near(r.log_loss, -math.log(1e-15))


def test_forward_skill_ignores_rounding_noise(spark):
    rows = []
    for i in range(12):
        b = 0.1 * i + 0.037
        f = math.sin(i)
        rows.append(("good", "06001", i, "thin", b, f - b, "stable", 0.9 * f - b, "stable", None))
        rows.append(("base_effect", "06001", i, "thin", b, f - b, "stable", 0.3 - b, "stable", None))
        rows.append(("zero_change", "06001", i, "thin", b, f - b, "stable", 0.0, "stable", None))
    r = {x.model: x for x in M.evaluate(preds(spark, rows), ["model"], forward=True).collect()}
    assert near(r["good"].corr_forward, 1.0, 1e-9) and r["base_effect"].corr_forward is None and r["zero_change"].corr_dg is None
    assert near(r["good"].mae_forward, r["good"].mae) and r["good"].n_forward == 12


def test_null_groups_and_periods(spark):
    df = simple(spark, [(0.0, 1.0), (0.0, 2.0)]).withColumn("volume_tier", F.when(F.col("predicted_dg") > 1, "thin"))
    assert {r.volume_tier: r.mae for r in M.evaluate(df, ["volume_tier"]).collect()} == {None: 1.0, "thin": 2.0}
    assert [r.period for r in M.by_period(df, ["model"], "Q").collect()] == ["2020Q1"]


@pytest.fixture(scope="module")
def fixture(spark):
    """Two entities, four months, seven models; arithmetic is exact."""
    errors = {"ridge": (0.5, 3.0), "base_effect": (1.0, 3.0), "zero_change": (2.5, 5.0), "persistence": (8.0, 9.0), "mean_reversion": (2.0, 4.0)}
    rows = []
    for k, (e, tier) in enumerate((("06001", "large"), ("06003", "thin"))):
        for i in range(4):
            dg, b = 4.0 * (i - 1), float(i)
            lab = "cooling" if dg < -2 else "heating" if dg > 2 else "stable"
            for m, err in errors.items():
                rows.append((m, e, i, tier, b, dg, lab, dg + err[k] * (1 if i % 2 else -1), lab, None))
            rows.append(("majority_class", e, i, tier, b, dg, lab, None, "stable", (0.3, 0.4, 0.3)))
            rows.append(("multinomial_logistic", e, i, tier, b, dg, lab, None, lab, (0.1, 0.1, 0.8)))
    return preds(spark, rows).cache()


def test_headline_and_concise(fixture):
    h = {r.model: r for r in R.headline(fixture).collect()}
    assert near(h["ridge"].mae, 1.75) and near(h["base_effect"].mae, 2.0) and near(h["zero_change"].mae, 3.75)
    assert near(h["ridge"].skill_vs_base_effect, 1 - 1.75 / 2) and near(h["ridge"].skill_vs_zero_change, 1 - 1.75 / 3.75)
    assert h["majority_class"].mae is None and h["majority_class"].n == 8 and near(h["majority_class"].macro_f1_vs_majority, 0.0)
    c = R.concise(fixture).orderBy("position").collect()
    assert [r.model for r in c] == list(R.CONCISE_ORDER) and [r.kind for r in c] == ["naive"] * 5 + ["learned"] * 2


def test_tables(fixture):
    t = {r.volume_tier: r for r in R.by_tier(fixture, "ridge", TARGET).collect()}
    assert near(t["thin"].mae, 3.0) and near(t["large"].mae, 0.5) and t["thin"].tier_order < t["large"].tier_order
    e = R.by_entity(fixture, "ridge").orderBy(F.desc("mae")).collect()
    assert [(r.county, r.mae, r.n) for r in e] == [("06003", 3.0, 4), ("06001", 0.5, 4)]
    s = R.tier_table(fixture, "ridge", "multinomial_logistic", TARGET).collect()
    assert {(r.volume_tier, r.accuracy) for r in s} == {("thin", 1.0), ("large", 1.0)}
    assert near(R.base_effect_correlation(fixture, "ridge").first().corr_dg_base, -1.0)
    assert R.forward_rows(fixture, "ridge").count() == 8 and R.forward_rows(fixture, "majority_class").count() == 0
    f = R.claim_facts(fixture, TARGET).first()
    assert near(f.mae, 1.75) and near(f.mae_lowest_tier, 3.0) and near(f.mae_highest_tier, 0.5) and f.rows == 8


SMALL = BootstrapContract(resamples=300)


def noisy(spark, entities=12, months=5):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(entities):
        for i in range(months):
            y = float(rng.normal(scale=4))
            for m, s in (("a", 1.0), ("b", 3.0)):
                p = y + float(rng.normal(scale=s)) + (0.5 * e if m == "a" else 0)
                lab = lambda v: "cooling" if v <= -2 else "heating" if v >= 2 else "stable"
                rows.append((m, f"06{e:03d}", i, "thin", 0.0, y, lab(y), p, lab(p), None))
    return preds(spark, rows)


def reference_interval(pdf, block, metric, c):
    """Brute force: replicate the rows of the drawn blocks."""
    import hashlib

    keys = sorted(pdf[block].astype(str).unique())
    parts = {k: g for k, g in pdf.groupby(pdf[block].astype(str))}
    vals = []
    for r in range(c.resamples):
        idx = [int(hashlib.md5(f"{c.seed}:{r}:{s}".encode()).hexdigest()[:8], 16) % len(keys) for s in range(len(keys))]
        err = np.concatenate([np.abs(parts[keys[i]]["predicted_dg"] - parts[keys[i]]["target_dg"]) for i in idx])
        vals.append(err.mean() if metric == "mae" else np.median(err))
    return np.quantile(vals, [c.alpha / 2, 1 - c.alpha / 2])


@pytest.mark.parametrize("block,column", [("county", "county_fips"), ("month", "reference_month")])
def test_intervals_equal_row_replication(spark, block, column):
    df = noisy(spark).cache()
    got = {(r.model, r.metric): r for r in B.intervals(df, ["model"], ("mae", "medae", "macro_f1"), (block,), SMALL).collect()}
    pdf = df.toPandas()
    for m in ("a", "b"):
        for metric in ("mae", "medae"):
            low, high = reference_interval(pdf[pdf.model == m], column, metric, SMALL)
            r = got[(m, metric)]
            assert near(r.low, low, 1e-9) and near(r.high, high, 1e-9) and r.low <= r.point <= r.high and r.resamples == 300
        assert got[(m, "macro_f1")].resamples == 300


def test_one_block_has_no_interval(spark):
    df = noisy(spark, entities=1)
    r = B.intervals(df, ["model"], ("mae",), ("county",), SMALL).filter("model = 'a'").first()
    assert r.point is not None and r.low is None and r.high is None and r.resamples == 0
    with pytest.raises(KeyError):
        B.intervals(df, ["model"], blocks=("tract",))


def test_mixes_agree(spark):
    x = np.array([0, 1, 2, 77, 2**31, 2**32 - 1, 123456789], np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "x long").select(B._mixed(F.col("x"))).collect()]
    assert got == B.mixed(x).tolist() and len(set(got)) == len(x)


def test_poisson_equals_row_replication(spark):
    import hashlib

    df = noisy(spark, entities=9).cache()
    c = replace(SMALL, scheme="poisson")
    got = {(r.model, r.metric): r for r in B.intervals(df, ["model"], ("mae", "medae", "macro_f1"), ("county",), c).collect()}
    pdf = df.toPandas()
    bounds = B._poisson_bounds()
    for m, g in pdf.groupby("model"):
        parts = {k: (v.predicted_dg - v.target_dg).abs().to_numpy() for k, v in g.groupby("county_fips")}
        h = {k: int(hashlib.md5(f"{c.seed}:{k}".encode()).hexdigest()[:8], 16) for k in parts}
        means, medians = [], []
        for r in range(c.resamples):
            turn = int(B.mixed(np.array([(r + c.seed) % 2**32]))[0])
            w = {k: int(np.searchsorted(bounds, int(B.mixed(np.array([turn ^ h[k]]))[0]), "right")) for k in parts}
            drawn = np.concatenate([np.repeat(parts[k], w[k]) for k in parts])
            if len(drawn):
                means.append(drawn.mean()), medians.append(np.median(drawn))
        for metric, values in (("mae", means), ("medae", medians)):
            low, high = np.quantile(values, [c.alpha / 2, 1 - c.alpha / 2])
            assert near(got[m, metric].low, low, 1e-9) and near(got[m, metric].high, high, 1e-9) and got[m, metric].resamples == len(values)


def test_registered_statistic(spark):
    """Root of the mean squared target and a correlation: intervals and paired differences equal replicated rows."""
    import hashlib

    x, y = F.col("predicted_dg"), F.col("target_dg")
    both = x.isNotNull() & y.isNotNull()
    of = lambda v: (lambda: F.coalesce(F.sum(F.when(both, v)), F.lit(0.0)))
    sums = {"_pairs": lambda: F.count_if(both), "_x": of(x), "_y": of(y), "_xx": of(x * x), "_yy": of(y * y), "_xy": of(x * y)}
    n, a, b = F.col("_pairs"), F.col("_x"), F.col("_y")

    def correlation():
        spread = F.sqrt((n * F.col("_xx") - a * a) * (n * F.col("_yy") - b * b))
        return F.try_divide(n * F.col("_xy") - a * b, spread)

    B.register_statistic("corr", sums, correlation)
    try:
        with pytest.raises(ValueError, match="corr"):
            B.register_statistic("corr", sums, correlation)
        df = noisy(spark).cache()
        got = {r.model: r for r in B.intervals(df, ["model"], ("corr", "mae"), ("county",), SMALL).filter("metric = 'corr'").collect()}
        pair = B.paired_difference(df.filter("model = 'a'"), df.filter("model = 'b'"), "corr", "county", SMALL).first()
        pdf = df.toPandas()
        keys = sorted(pdf.county_fips.unique())
        parts = {(m, k): g for (m, k), g in pdf.groupby(["model", "county_fips"])}
        values = {"a": [], "b": []}
        for r in range(SMALL.resamples):
            idx = [int(hashlib.md5(f"{SMALL.seed}:{r}:{s}".encode()).hexdigest()[:8], 16) % len(keys) for s in range(len(keys))]
            for m in values:
                rows = [parts[m, keys[i]] for i in idx]
                values[m].append(np.corrcoef(np.concatenate([g.predicted_dg for g in rows]), np.concatenate([g.target_dg for g in rows]))[0, 1])
        ends = [SMALL.alpha / 2, 1 - SMALL.alpha / 2]
        for m in values:
            assert np.allclose([got[m].low, got[m].high], np.quantile(values[m], ends), atol=1e-9)
        assert np.allclose([pair.low, pair.high], np.quantile(np.subtract(values["a"], values["b"]), ends), atol=1e-9)
    finally:
        del B.STATISTICS["corr"]
    with pytest.raises(KeyError, match="corr"):
        B.intervals(df, ["model"], ("corr",), ("county",), SMALL)


def test_poisson_weights_agree_roughly(spark):
    df = noisy(spark, entities=40).cache()
    a, b = (B.intervals(df, ["model"], ("mae",), ("county",), replace(SMALL, scheme=d)).orderBy("model").collect() for d in ("slots", "poisson"))
    for x, y in zip(a, b):
        assert near(x.point, y.point) and abs(x.low - y.low) < 0.3 * x.point and abs(x.high - y.high) < 0.3 * x.point
    with pytest.raises(ValueError, match="scheme"):
        B.intervals(df, ["model"], ("mae",), ("county",), replace(SMALL, scheme="auto"))


def test_paired_difference(spark):
    df = noisy(spark).cache()
    a, b = df.filter("model = 'a'"), df.filter("model = 'b'")
    r = B.paired_difference(a, b, "mae", "county", SMALL).first()
    pdf = df.toPandas()
    mae = {m: (g.predicted_dg - g.target_dg).abs().mean() for m, g in pdf.groupby("model")}
    assert near(r.point, mae["a"] - mae["b"], 1e-9) and r.low < r.point < r.high and r.metric == "mae_difference"
    same = B.paired_difference(a, a, "mae", "county", SMALL).first()
    assert near(same.low, 0.0) and near(same.high, 0.0)
    with pytest.raises(KeyError, match="tract_error"):
        B.paired_difference(a, b, "tract_error", "county", SMALL)


@pytest.mark.parametrize("block,column", [("county", "county_fips"), ("month", "reference_month")])
def test_paired_medians_equal_row_replication(spark, block, column):
    import hashlib

    df = noisy(spark).cache()
    r = B.paired_difference(df.filter("model = 'a'"), df.filter("model = 'b'"), "medae", block, SMALL).first()
    pdf = df.toPandas().assign(v=lambda d: (d.predicted_dg - d.target_dg).abs())
    keys = sorted(pdf[column].astype(str).unique())
    parts = {(m, k): g.v.to_numpy() for (m, k), g in pdf.groupby(["model", pdf[column].astype(str)])}
    vals = []
    for n in range(SMALL.resamples):
        idx = [int(hashlib.md5(f"{SMALL.seed}:{n}:{s}".encode()).hexdigest()[:8], 16) % len(keys) for s in range(len(keys))]
        a, b = (np.median(np.concatenate([parts[m, keys[i]] for i in idx])) for m in ("a", "b"))
        vals.append(a - b)
    low, high = np.quantile(vals, [SMALL.alpha / 2, 1 - SMALL.alpha / 2])
    assert near(r.low, low, 1e-9) and near(r.high, high, 1e-9) and r.resamples == SMALL.resamples


def skewed(spark, n=30_000):
    """One key holds a third of the rows, one value repeats very often, some are NULL."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"),
        F.when(F.col("id") % 5 == 0, 7.0).when(F.col("id") % 11 == 0, None).otherwise(F.hash("id") / 1e6).alias("x"),
        (F.col("id") % 17).cast("double").alias("y"),
    )


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("how", [{"digits": (3,)}, {}, {"digits": (2, 6, 20), "few_groups": False}])
def test_counted_quantiles_are_exact(spark, keys, how):
    df, probs = skewed(spark), [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    got = {tuple(r)[:-1]: r.value for r in Q.exact_quantiles(df, ["x", "y"], probs, keys, **how).collect()}
    pdf = df.toPandas()
    want = {}
    for k, g in pdf.groupby(keys) if keys else [((), pdf)]:
        for c in ("x", "y"):
            for p in probs:
                want[(*k, c, p)] = np.nanquantile(g[c], p)
    assert got.keys() == want.keys() and all(near(got[k], want[k], 1e-9) for k in want)


def test_leading_bits_keep_the_order(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1.0, 1.0 + 2**-52, 1.9999, 2.0, -3.7, 1e300, 1.7e308, -1.7e308, float("inf"), float("-inf")]
    values += [s * 10.0**e * (1 + i / 997) for s in (1, -1) for e in (-300, -5, 0, 3, 200, 307) for i in range(9)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for bits in (1, 4, 12, 40, 52):
        rows = sorted((r.v, r.k) for r in df.select("v", Q.leading(F.col("v"), bits).alias("k")).collect())
        assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
        assert all(v == k or abs(k - v) <= max(abs(v) * 2.0 ** -bits, 5e-324) for v, k in rows)
    got = {r.prob: r.value for r in Q.exact_quantiles(df, ["v"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: float("-inf"), 0.5: sorted(values)[len(values) // 2], 1.0: float("inf")} or len(values) % 2 == 0
    assert got[0.0] == float("-inf") and got[1.0] == float("inf")
    with pytest.raises(ValueError, match="digits"):
        Q.exact_quantiles(df, ["v"], [0.5], digits=(20, 4))


def test_quantiles_scan_twice(spark, tmp_path):
    path = f"{tmp_path}/t"
    skewed(spark, 3000).write.parquet(path)
    q = Q.exact_quantiles(spark.read.parquet(path), ["x", "y"], [0.1, 0.5], ["k"])
    q.collect()
    assert q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet") == 2
    assert Q.exact_quantiles(spark.read.parquet(path).filter("k = 'none'"), ["x"], [0.5]).count() == 0


def test_quantile_plan_moves_no_rows(spark):
    """Without broadcasts to lean on, every exchange of rows is below a partial count."""
    plan = Q.exact_quantiles(skewed(spark), ["x"], [0.5], ["k"])._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    after = [plan.split("\n")[plan.split("\n").index(line) + 1] for line in lines]
    assert lines and all("Aggregate" in x or "Exchange" in x for x in after) and "SortMergeJoin" not in plan


def test_counted_medae_matches_plain(spark):
    df = noisy(spark, 20)
    plain = {r.model: r for r in M.evaluate(df, ["model"], bounded=True).collect()}
    big = {r.model: r for r in M.evaluate(df, ["model"]).collect()}
    assert all(near(plain[m].medae, big[m].medae) and near(plain[m].mae, big[m].mae) for m in plain)


def test_draws_are_made_by_a_number_of_tasks_that_adaptive_execution_keeps(spark):
    from chronopanel.operators import bootstrap

    stats = spark.createDataFrame([("m", str(k), 1.0) for k in range(5)], "model string, block_key string, _n_mag double")
    plan = bootstrap.slot_weights(stats, ["model"], 50, 1).expand(stats)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


@pytest.mark.parametrize("draws", [700, 5])
def test_lists_of_draws_hold_the_draws_of_the_hash(spark, monkeypatch, draws):
    """Blocks over three chunks, several ranges of slots, and (5 at a time) gaps of more than a byte: each draw as ``_hash32`` gives it."""
    monkeypatch.setattr(B, "DRAWS", draws)
    blocks, seed, got, size = 2500, 7, {}, 0
    rows = [pa.RecordBatch.from_pydict({"blocks": [blocks] * len(range(0, blocks, draws)), "resample": [3] * len(range(0, blocks, draws)), "from": list(range(0, blocks, draws))})]
    for batch in B.drawn_lists(seed)(rows):
        for r in batch.to_pylist():
            size += len(r["gaps"])
            for at in np.cumsum(np.frombuffer(r["gaps"], "<u2" if r["wide"] else "u1"), dtype=np.int64):
                got[r["chunk"] * B.CHUNK + at] = got.get(r["chunk"] * B.CHUNK + at, 0) + 1
    slots = spark.range(blocks).select(F.pmod(B._hash32(F.lit(seed), F.lit(3), F.col("id")), F.lit(blocks)).alias("idx"))
    assert got == {r[0]: r[1] for r in slots.groupBy("idx").count().collect()}
    assert sum(got.values()) == blocks and (draws == 5 or size <= 1.1 * blocks)


def broadcast_rows(spark, run):
    """Most rows that a broadcast held while ``run`` ran."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    done = store.executionsList()
    for at in range(before, done.size()):
        number = done.apply(at).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())) if node.name() == "BroadcastExchange" else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_resampled_medians_broadcast_no_draws(spark):
    """300 blocks are drawn 90,000 times over 300 resamples; a broadcast may hold 3,000 rows of the input or a few per resample, but not the draws."""
    df = spark.range(3000).select(
        F.concat(F.lit("e"), F.col("id") % 300).alias("county_fips"), F.lit("x").alias("county_name"),
        F.expr("add_months(DATE'2020-01-01', cast(id div 300 as int))").alias("reference_month"), F.lit("large").alias("volume_tier"),
        (F.hash("id") % 1000 / 100).alias("target_dg"), (F.hash("id", F.lit(1)) % 1000 / 100).alias("predicted_dg")).cache()
    how, out = replace(SMALL, resamples=300), []
    most = broadcast_rows(spark, lambda: out.append(B.paired_difference(df, df.withColumn("predicted_dg", F.lit(0.0)), "medae", "county", how).first()))
    assert out[0].resamples == 300 and 0 < most <= 4000


@pytest.mark.parametrize("scheme", ["slots", "poisson"])
def test_resampled_medians_with_ties_outliers_and_small_groups(spark, scheme):
    """Medians by weights equal those by replicated rows: most values tie, a group has one block, one value, or a null key."""
    rows = [(g, f"b{b:02d}", float(v)) for g, b, v in
            [("ties", i % 7, [0, 0, 0, 1, 1, 50, 1e9][i % 7 - i % 3]) for i in range(60)] + [("one", 0, 3), ("two", 0, 1), ("two", 1, 2)]
            + [(None, i % 5, (i * 37) % 101) for i in range(90)]]
    df = spark.createDataFrame(rows, "g string, block_key string, v double")
    how = replace(SMALL, scheme=scheme, resamples=50)
    weights = B._weights(df.groupBy("g", "block_key").agg(F.count("*").alias("_rows")), ["g"], how)
    drawn = {}
    for r in weights.expand(df.select("g", "block_key").distinct()).collect():
        drawn.setdefault((r.g, r.resample), {})[r.block_key] = r.weight
    want = {}
    for (g, turn), blocks in drawn.items():
        values = [v for a, b, v in rows if a == g for _ in range(blocks.get(b, 0))]
        want[g, turn] = float(np.median(values))
    got = {(r.g, r.resample): r.value for r in B._median_values(df, weights, ["g"]).collect()}
    assert got == want and len(got) >= 100
