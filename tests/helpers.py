"""Small hand-checkable frames."""

import datetime as dt
import math

from pyspark.sql import functions as F

from chronopanel.contracts import MEASURES


def month(i, start=(2020, 1)):
    y, m = start
    k = y * 12 + (m - 1) + i
    return dt.date(k // 12, k % 12 + 1, 1)


def near(a, b, tol=1e-6):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tol)


def column(df, name, *order):
    return [r[0] for r in df.orderBy(*order).select(name).collect()]


def price_panel(spark, prices, fips="06001", start=(2020, 1), sold=100.0):
    rows = [(fips, f"N{fips} County", month(i, start), p, sold) for i, p in enumerate(prices)]
    return spark.createDataFrame(
        rows, "county_fips string, county_name string, reference_month date, median_sale_price double, homes_sold double"
    )


def long_panel(spark, months=48, start=(2018, 1), gap=(2020, 6)):
    """Three entities of very different size with sine-shaped measures; labour misses one month."""
    rows = []
    for e, scale in (("06001", 1.0), ("06003", 25.0), ("06005", 0.05)):
        for i in range(months):
            m = month(i, start)
            wave = 1 + 0.2 * math.sin(i / 5.0) + 0.01 * i
            values = {c: 100.0 * wave for c in MEASURES}
            values.update(
                median_sale_price=300_000 * wave * (1 + scale / 100), homes_sold=1000 * scale * wave,
                new_listings=1200 * scale * wave, pending_sales=900 * scale * wave, inventory=3000 * scale * wave,
            )
            labour = None if m == dt.date(*gap, 1) else 5.0 + i * 0.1
            rows.append((e, f"E{e} County", m, *[float(values[c]) for c in MEASURES], 3.0 + 0.05 * i, labour))
    schema = "county_fips string, county_name string, reference_month date, " + ", ".join(f"{c} double" for c in MEASURES)
    df = spark.createDataFrame(rows, schema + ", mortgage_rate_30y double, unemployment_rate double")
    return df.withColumn("prediction_as_of", F.date_add(F.add_months("reference_month", 1), 14))


_VALUES = {
    "median_sale_price": 500_000.0, "median_list_price": 510_000.0, "median_ppsf": 400.0, "avg_sale_to_list": 1.01,
    "sold_above_list": 0.4, "price_drops": 0.2, "off_market_in_two_weeks": 0.3,
}


def small_sources(spark):
    """2 entities x 4 months; the second lacks its last housing month."""
    ids = [("06001", "Alameda County"), ("06003", "Alpine County")]
    months = [month(i, (2024, 1)) for i in range(4)]
    entities = spark.createDataFrame(
        [(i, n, n.replace(" County", "").lower()) for i, n in ids], "county_fips string, county_name string, county_name_key string"
    )
    housing = spark.createDataFrame(
        [(i, n, m, *[_VALUES.get(c, 10.0) + (1000 * k if c == "median_sale_price" else 0) for c in MEASURES], dt.datetime(2024, 6, 1))
         for i, n in ids for k, m in enumerate(months) if not (i == "06003" and k == 3)],
        "county_fips string, county_name string, reference_month date, " + ", ".join(f"{c} double" for c in MEASURES)
        + ", redfin_last_updated timestamp",
    )
    rate = spark.createDataFrame(
        [(m, 6.5 + 0.1 * k, 6.5, 4, m) for k, m in enumerate(months)],
        "reference_month date, mortgage_rate_30y double, mortgage_rate_30y_last double, mortgage_rate_weeks_observed long, "
        "mortgage_rate_last_release date",
    )
    labour = spark.createDataFrame(
        [(i, m, 950.0, 1000.0, 50.0, 5.0) for i, _ in ids for m in months],
        "county_fips string, reference_month date, employed double, labor_force double, unemployed double, unemployment_rate double",
    )
    return entities, housing, rate, labour


PRED_SCHEMA = (
    "model string, county_fips string, county_name string, reference_month date, volume_tier string, split string, "
    "price_smoothed__log_diff3_o9 double, target_dg double, target_label string, predicted_dg double, predicted_label string, "
    "prob_cooling double, prob_stable double, prob_heating double"
)


def preds(spark, rows):
    """(model, entity, month index, tier, base, dg, label, predicted, predicted label, probs or None)."""
    out = []
    for model, e, i, tier, base, dg, lab, p, pl, probs in rows:
        out.append((model, e, f"{e} County", month(i), tier, "test", base, dg, lab, p, pl, *(probs or (None, None, None))))
    return spark.createDataFrame(out, PRED_SCHEMA)
