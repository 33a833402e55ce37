"""Adapter: the star-schema tables in the roles of the raw sources.

Suppliers are the entities.  Line items, grouped by supplier and ship month,
are the housing file; weekly orders are the national series; line items again,
in long form, are the labour series.  Everything is one partial aggregation over
the fact table with integer sums (exact, order-free and mergeable), so a
supplier holding a third of all lines is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import LABOUR_MEASURES, STAR, Contracts
from ..functions.scalar import compose_id
from . import staging

LABOUR_GAP = "2001-01-01"  # one skipped release, to exercise the fill
DROPS_FROM = "1996-07-01"  # price_drops starts late, as in the source it stands for


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def reference_codes(spark, folder) -> DataFrame:
    return table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        F.concat(F.lit(" "), F.col("s_nationkey").cast("string")).alias("statefp"),
        F.col("s_suppkey").cast("string").alias("countyfp"),
        F.concat("s_name", F.lit(" County ")).alias("countyname"),
        F.col("s_nationkey").cast("string").alias("state"),
    )


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def monthly_facts(spark, folder, by_flag: bool = False) -> DataFrame:
    """Additive sums per supplier and ship month (and, optionally, also by flag)."""
    line = table(
        spark, folder, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    ).select(
        "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus",
        F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"),
        F.dayofmonth("l_shipdate").cast("long").alias("day"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
    )
    sums = [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("cents", "qty", "disc", "tax", "day")],
        _count_if(F.col("l_linestatus") == "O").alias("n_open"),
        _count_if(F.col("l_returnflag") == "N").alias("n_new"),
        _count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        _count_if(F.col("l_returnflag") == "A").alias("n_accepted"),
        _count_if(F.col("tax") >= 5).alias("n_high_tax"),
        _count_if(F.col("disc") >= 6).alias("n_high_disc"),
        _count_if(F.col("day") <= 14).alias("n_early"),
        F.max("l_shipdate").cast("timestamp").alias("last_shipped"),
    ]
    if not by_flag:
        return line.groupBy("l_suppkey", "month").agg(*sums)
    line = line.withColumn("flag", F.col("l_returnflag"))
    return line.groupingSets(
        [[F.col("l_suppkey"), F.col("month")], [F.col("l_suppkey"), F.col("month"), F.col("flag")]],
        "l_suppkey", "month", "flag",
    ).agg(*sums)


def housing_bulk(spark, folder, facts: DataFrame) -> DataFrame:
    """Facts -> the bulk layout, with region names that still need normalising."""
    n = F.col("n")
    who = table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, folder, "region", "r_regionkey", "r_name")
    # nation and region are fixed code lists (25 and 5 rows at every scale)
    place = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    kind = (
        F.when(F.col("flag").isNull(), "All Residential").otherwise(F.concat(F.lit("Flag "), F.col("flag")))
        if "flag" in facts.columns else F.lit("All Residential")
    )
    # Places come after suppliers: a join's estimated size is a product, beside which no planner would leave the facts where they are.
    return facts.join(who, facts.l_suppkey == who.s_suppkey).join(place, who.s_nationkey == place.n_nationkey).select(
        F.col("month").cast("string").alias("period_begin"),
        F.lit("30").alias("period_duration"),
        F.lit("county").alias("region_type"),
        F.concat("s_name", F.lit(" County, "), "r_name").alias("region"),
        F.col("n_nationkey").cast("string").alias("state_code"),
        kind.alias("property_type"),
        F.col("last_shipped").alias("last_updated"),
        (F.col("cents") / (10 * n)).alias("median_sale_price"),
        (F.col("cents") / (10 * n) * (1 + F.col("tax") / (100 * n))).alias("median_list_price"),
        (F.col("cents") / (1000 * F.col("qty"))).alias("median_ppsf"),
        n.cast("double").alias("homes_sold"),
        F.col("n_open").cast("double").alias("pending_sales"),
        F.col("n_new").cast("double").alias("new_listings"),
        F.col("qty").cast("double").alias("inventory"),
        (F.col("qty") / n).alias("months_of_supply"),
        (F.col("day") / n).alias("median_dom"),
        (1 - F.col("disc") / (100 * n)).alias("avg_sale_to_list"),
        (F.col("n_high_tax") / n).alias("sold_above_list"),
        F.when(F.col("month") >= F.lit(DROPS_FROM).cast("date"), F.col("n_high_disc") / n).alias("price_drops"),
        (F.col("n_early") / n).alias("off_market_in_two_weeks"),
    )


def two_decimals(hundredths: Column) -> Column:
    """Integer hundredths as text, exact: 2034 -> '20.34'."""
    return F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )


def rate_series(spark, folder) -> DataFrame:
    """Weekly rate moved by the share of urgent orders, as dated text; the first ISO week has no value."""
    orders = table(spark, folder, "orders", "o_orderdate", "o_orderpriority").select(
        F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 3).alias("day"), "o_orderpriority"
    )
    weekly = orders.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), _count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")
    )
    bp = 200 + F.floor(F.col("urgent") * 2000 / F.col("n"))
    return weekly.select(
        F.col("day").cast("string").alias("observation_date"),
        F.when(F.weekofyear("day") == 1, ".").otherwise(two_decimals(bp)).alias("mortgage30us"),
    )


def labour_series(spark, folder, c=STAR.staging) -> DataFrame:
    """Series metadata: four county series per supplier, plus one state series per nation."""
    codes = list(LABOUR_MEASURES)
    who = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    eid = compose_id(F.col("s_nationkey"), F.col("s_suppkey"), c.state_width, c.county_width)
    county = who.select(eid.alias("id"), F.explode(F.array(*map(F.lit, codes))).alias("measure_code")).select(
        F.concat(F.lit("LAU"), "id", "measure_code").alias("series_id"),
        F.lit("F").alias("area_type_code"),
        F.concat(F.lit("CN"), "id", F.lit("00000000")).alias("area_code"), "measure_code",
    )
    state = table(spark, folder, "nation", "n_nationkey").select(
        F.concat(F.lit("LAS"), F.col("n_nationkey").cast("string"), F.lit("03")).alias("series_id"),
        F.lit("A").alias("area_type_code"),
        F.concat(F.lit("ST"), F.col("n_nationkey").cast("string")).alias("area_code"),
        F.lit("03").alias("measure_code"),
    )
    return county.unionByName(state)


def labour_observations(spark, folder, facts: DataFrame, c=STAR.staging) -> DataFrame:
    """Long text observations: monthly values, annual 'M13' rows and one missing release."""
    who = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    eid = compose_id(F.col("s_nationkey"), F.col("s_suppkey"), c.state_width, c.county_width)
    n, r, a = F.col("n"), F.col("n_returned"), F.col("n_accepted")
    base = facts.join(who, facts.l_suppkey == who.s_suppkey)
    if "flag" in facts.columns:
        base = base.filter("flag IS NULL")

    def explode_measures(df):
        value = {
            "03": two_decimals(F.floor(r * 10000 / n)), "04": r.cast("string"),
            "05": a.cast("string"), "06": n.cast("string"),
        }
        rows = F.array(*[
            F.struct(F.lit(code).alias("code"), value[code].alias("value")) for code in LABOUR_MEASURES
        ])
        return df.select("id", "year", "period", F.explode(rows).alias("m")).select(
            F.concat(F.lit("LAU"), "id", "m.code").alias("series_id"), "year", "period",
            F.col("m.value").alias("value"),
        )

    monthly = base.filter(F.col("month") != F.lit(LABOUR_GAP).cast("date")).select(
        eid.alias("id"), F.year("month").cast("string").alias("year"),
        F.concat(F.lit("M"), F.date_format("month", "MM")).alias("period"), n, r, a,
    )
    annual = base.groupBy(eid.alias("id"), F.year("month").cast("string").alias("year")).agg(
        F.sum("n").alias("n"), F.sum("n_returned").alias("n_returned"), F.sum("n_accepted").alias("n_accepted"),
    ).withColumn("period", F.lit("M13"))
    return explode_measures(monthly).unionByName(explode_measures(annual))


def stage_all(spark, folder, contracts: Contracts = STAR, facts: DataFrame | None = None) -> dict:
    """The four staged sources, from the star tables."""
    c = contracts.staging
    facts = monthly_facts(spark, folder) if facts is None else facts
    entities = staging.stage_entities(reference_codes(spark, folder), c)
    return {
        "entities": entities,
        "housing": staging.stage_housing(housing_bulk(spark, folder, facts), entities.table, c),
        "mortgage_rate": staging.stage_rate(rate_series(spark, folder)),
        "unemployment": staging.stage_labour(
            labour_observations(spark, folder, facts, c), labour_series(spark, folder, c), entities.table, c
        ),
    }
