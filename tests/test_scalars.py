import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronopanel.contracts import PRODUCTION, STAR, TARGET
from chronopanel.functions import scalar as S


def one(spark, schema, *values, **cols):
    df = spark.createDataFrame([values], schema)
    return df.select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("name", [
    "Los Angeles County, CA", "Los Angeles County", "LOS ANGELES", "  Los  Angeles  ", "Los Angeles City and Borough",
])
def test_name_key(spark, name):
    assert one(spark, "n string", name, k=S.name_key(F.col("n"))).k == "los angeles"


def test_name_key_keeps_inner_words(spark):
    assert one(spark, "n string", "District of Columbia", k=S.name_key(F.col("n"))).k == "district of columbia"


def test_compose_id_pads_and_never_cuts(spark):
    r = one(spark, "s string, c string, d string", " 6", "37", "12345", a=S.compose_id(F.col("s"), F.col("c")), b=S.compose_id(F.col("s"), F.col("d")))
    assert (r.a, r.b) == ("06037", "0612345")


def test_months(spark):
    r = one(
        spark, "a string, b string, d date", "2024-02-17", "not a date", dt.date(2023, 12, 1),
        m=S.month_start(F.col("a")), bad=S.month_start(F.col("b")), cut=S.cutoff(F.col("d")),
        pub=S.published_at(F.col("d"), 7), q=S.period_label(F.col("d"), "QE"), y=S.period_label(F.col("d"), "YE"),
    )
    assert r.m == dt.date(2024, 2, 1) and r.bad is None
    assert r.cut == dt.date(2024, 1, 15) and r.pub == dt.date(2024, 1, 7)
    assert (r.q, r.y) == ("2023Q4", "2023")


def test_period_codes(spark):
    df = spark.createDataFrame([("2024", p) for p in ("M01", "M12", "M13", "A01", "M00")], "y string, p string")
    got = df.filter(S.is_month_code(F.col("p"))).select(S.coded_month(F.col("y"), F.col("p"))).collect()
    assert sorted(r[0] for r in got) == [dt.date(2024, 1, 1), dt.date(2024, 12, 1)]


def test_number_coercion(spark):
    df = spark.createDataFrame([("1.5",), (".",), ("",), (None,), ("-3",)], "x string")
    assert [r[0] for r in df.select(S.to_number(F.col("x"))).collect()] == [1.5, None, None, None, -3.0]


def test_classify_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-2.5, -2.0, -1.999, 0.0, 1.999, 2.0, 2.5, None)], "x double")
    got = [r[0] for r in df.select(S.classify(F.col("x"), 2.0)).collect()]
    assert got == ["cooling", "cooling", "stable", "stable", "stable", "heating", "heating", None]


def test_tiers_leave_no_gap(spark):
    cases = {1.0: "excluded", 10.0: "thin", 24.5: "thin", 25.5: "thin", 100.0: "small", 101.0: "mid", 500.5: "mid", 6000.0: "large"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "v double")
    got = {r.v: r.t for r in df.select("v", S.tier(F.col("v"), TARGET.tiers).alias("t")).collect()}
    assert got == {**cases, None: None}


def test_bands_are_left_closed(spark):
    df = spark.createDataFrame([(3.99,), (4.0,), (7.0,), (None,)], "x double")
    got = [r[0] for r in df.select(S.band(F.col("x"), PRODUCTION.rate_edges, PRODUCTION.rate_labels)).collect()]
    assert got == ["<4%", "4-5%", ">7%", None]


def test_snake_case():
    assert S.snake_case([" Series ID ", "AVG_SALE_TO_LIST", "median ppsf (usd)"]) == ["series_id", "avg_sale_to_list", "median_ppsf_usd"]


def test_published_contract_is_frozen():
    t = PRODUCTION.target
    assert (t.window, t.growth_lag, t.horizon, t.tau, t.floor) == (3, 12, 3, 2.0, 10.0)
    assert t.lead_in == 14
    assert [low for _, low in t.tiers] == [0, 10, 26, 101, 501]
    f = PRODUCTION.features
    assert len(f.names()) == 61 and len(set(f.names())) == 61
    assert {k: len(v) for k, v in f.families().items()} == {
        "momentum": 13, "base_effect": 1, "price": 9, "volume": 9, "supply": 6, "tightness": 13, "macro": 9, "quality": 1,
    }
    assert max(s.reach for s in f.specs()) == 14
    assert PRODUCTION.split.embargo == 3 and [w.end for w in PRODUCTION.split.windows][-1] == dt.date(2026, 2, 1)
    assert len(PRODUCTION.registry) == 36
    assert STAR.features is PRODUCTION.features


def test_context_is_never_a_feature():
    assert not {"volume_tier", "homes_sold_median", "target_dg", "target_label"} & {s.column for s in PRODUCTION.features.specs()}
