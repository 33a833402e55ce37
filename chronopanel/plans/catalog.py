"""Every operator as a named query over the star-schema tables.

A query takes ``(spark, folder)`` and returns a DataFrame.  Doubles are rounded
at the very end so results can be compared with another engine's; nothing is
sampled, truncated or limited unless the limit is the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import STAR, FillPolicy
from ..functions import scalar as S
from ..functions.transforms import apply_transform, positive
from ..operators import (
    audits, bootstrap, eda, features as feat, learned, metrics, naive, panel as pan, profile, quality, quantiles,
    results, rows, split as sp, target as tgt,
)
from ..schema import CLASSES, CONTEXT, ENTITY, KEY, NAME, PERIOD, TEST, TRAIN, VALIDATION
from ..session import is_landed, landed, new_folder, on_release
from ..sources import io, manifest, staging, star
from . import jobs

C = STAR
PRICES = ("median_sale_price", "median_list_price", "median_ppsf", "price_smoothed")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles, one integer width."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            # Prices are ratios that often end exactly half-way in decimal places, where engines round apart;
            # they are compared in single precision, to which every engine rounds alike.
            c = c.cast("float").cast("double") if f.name in PRICES else F.round(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
    return fn


# ------------------------------------------------------------- shared inputs
# Landed once per application in the shared folder, bucketed by entity, the way
# a pipeline publishes its panel, feature and prediction tables.


def facts(spark, folder) -> DataFrame:
    """The fact table's one aggregation; landed, so line items are scanned once for all sources."""
    return landed(spark, f"facts@{folder}", lambda: star.monthly_facts(spark, folder))


def facts_by_flag(spark, folder) -> DataFrame:
    """The same by flag too, which only row accounting reads: not landed, so that sums nobody asks for are never shuffled."""
    return star.monthly_facts(spark, folder, by_flag=True)


def staged(spark, folder):
    return star.stage_all(spark, folder, C, facts(spark, folder))


def panel(spark, folder) -> DataFrame:
    return landed(
        spark, f"panel@{folder}", lambda: built_panel(spark, folder), bucket_by=ENTITY, sort_by=KEY, co_located=True
    )


CORE = [*KEY, NAME, "median_sale_price", "homes_sold_median", "volume_tier", "is_included", "target_dg", "target_label", "has_target"]


def built_panel(spark, folder) -> DataFrame:
    """The panel's plan, to be landed ``co_located``; what is not selected of it is not computed."""
    return jobs.panel_from(staged(spark, folder), C, by_entity=True)


def core(spark, folder) -> DataFrame:
    """The published panel, or before it is published the few columns that most tables over it read."""
    if is_landed(spark, f"panel@{folder}"):
        return panel(spark, folder)
    return landed(spark, f"core@{folder}", lambda: built_panel(spark, folder).select(*CORE), co_located=True)


def model_rows(spark, folder) -> DataFrame:
    return tgt.modelling_rows(panel(spark, folder))


def core_rows(spark, folder) -> DataFrame:
    return tgt.modelling_rows(core(spark, folder))


def features(spark, folder) -> DataFrame:
    return landed(
        spark, f"features@{folder}", lambda: feat.build_features(panel(spark, folder), C.features),
        bucket_by=ENTITY, sort_by=KEY, clustered=True,
    )


def split(spark, folder) -> DataFrame:
    return sp.assign_split(features(spark, folder), C.split, C.features)


def naive_rows(spark, folder) -> DataFrame:
    """The split with the four features that naive models read; without published features only these are computed."""
    if is_landed(spark, f"features@{folder}"):
        return split(spark, folder)

    def build():
        base = panel(spark, folder) if is_landed(spark, f"panel@{folder}") else built_panel(spark, folder)
        own = sp.assign_split(feat.build_features(base, C.features), C.split, C.features)
        return own.filter(F.col("split").isin(TRAIN, VALIDATION, TEST)).select(*naive.READS)

    return landed(spark, f"naive_rows@{folder}", build, co_located=True)


def predictions(spark, folder) -> DataFrame:
    return landed(spark, f"predictions@{folder}", lambda: naive.predict_naive(naive_rows(spark, folder), C.target.tau), partition_by=["split"])


def run(spark, folder) -> learned.Run:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _runs:
        _runs[key] = learned.train_and_score(split(spark, folder), C.features, C.target.tau)
    return _runs[key]


def all_predictions(spark, folder) -> DataFrame:
    return landed(spark, f"all_predictions@{folder}", lambda: run(spark, folder).predictions, partition_by=["split"])


_runs: dict = {}
on_release.append(_runs.clear)


def train(spark, folder):
    return split(spark, folder).filter(F.col("split") == TRAIN)


def test_rows(spark, folder):
    return results.scored(predictions(spark, folder))


# -------------------------------------------------------- sources and staging


@query
def staged_entities(spark, folder):
    return staging.stage_entities(star.reference_codes(spark, folder), C.staging).table.drop("state_code")


@query
def staged_entities_one_state(spark, folder):
    one = replace(C.staging, state="15")
    codes = star.reference_codes(spark, folder).withColumn("statefp", S.zero_pad(F.col("statefp"), 2))
    return staging.stage_entities(codes, one).table.drop("state_code")


@query
def staged_housing(spark, folder):
    return staged(spark, folder)["housing"].table


@query
def housing_row_accounting(spark, folder):
    s = star.stage_all(spark, folder, C, facts_by_flag(spark, folder))["housing"]
    return rows.account(s.tagged, s.source)


def _one_state_housing(spark, folder):
    one = replace(C.staging, state="15")
    codes = star.reference_codes(spark, folder).withColumn("statefp", S.zero_pad(F.col("statefp"), 2))
    known = staging.stage_entities(codes, one).table
    bulk = star.housing_bulk(spark, folder, facts_by_flag(spark, folder))
    return staging.stage_housing(bulk, known, C.staging)


@query
def housing_name_lookup_accounting(spark, folder):
    s = _one_state_housing(spark, folder)
    return rows.account(s.tagged, s.source)


@query
def housing_unmatched_names(spark, folder):
    return staging.unmatched_names(_one_state_housing(spark, folder))


@query
def staged_rate(spark, folder):
    return staged(spark, folder)["mortgage_rate"].table


@query
def rate_row_accounting(spark, folder):
    s = staged(spark, folder)["mortgage_rate"]
    return rows.account(s.tagged, s.source)


@query
def labour_series_decode(spark, folder):
    return staging.labour_series(star.labour_series(spark, folder), C.staging)


@query
def staged_labour(spark, folder):
    return staged(spark, folder)["unemployment"].table


@query
def labour_row_accounting(spark, folder):
    s = staged(spark, folder)["unemployment"]
    return rows.account(s.tagged, s.source)


@query
def labour_unknown_entities(spark, folder):
    """Wide labour rows of entities outside a one-state reference list, per entity."""
    known = staged_entities_one_state(spark, folder)
    wide = staged(spark, folder)["unemployment"].table
    return staging.unknown_entities(wide, known).groupBy(ENTITY).agg(F.count(F.lit(1)).alias("rows"))


@query
def text_scan_reference_codes(spark, folder):
    path = new_folder(spark, "codes")
    raw = star.reference_codes(spark, folder).toDF("STATEFP", "COUNTYFP", "COUNTY NAME", "STATE")
    raw.write.option("sep", "|").option("header", True).csv(path)
    back = io.read_reference_codes(spark, path).withColumnRenamed("county_name", "countyname")
    return staging.stage_entities(back, C.staging).table.drop("state_code")


@query
def text_scan_housing_bulk(spark, folder):
    path = new_folder(spark, "bulk")
    bulk = star.housing_bulk(spark, folder, facts(spark, folder))
    out = bulk.withColumn("period_end", F.lit(None).cast("string"))
    out.toDF(*[c.upper() for c in out.columns]).write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    landed_path = new_folder(spark, "bulk_parquet")
    io.land_housing_bulk(io.read_housing_bulk(spark, path, staging.MEASURES), landed_path)
    back = spark.read.parquet(landed_path).withColumn("state_code", F.col("state_code").cast("string"))
    known = staging.stage_entities(star.reference_codes(spark, folder), C.staging).table
    return staging.stage_housing(back, known, C.staging).table.drop("redfin_last_updated")


@query
def text_scan_rate_series(spark, folder):
    path = new_folder(spark, "rate")
    star.rate_series(spark, folder).toDF("observation_date", "MORTGAGE30US").write.option("header", True).csv(path)
    return staging.stage_rate(io.read_rate_series(spark, path)).table


@query
def text_scan_labour_padded(spark, folder):
    series_path, data_path = new_folder(spark, "series"), new_folder(spark, "observations")
    padded = lambda df: df.select(*[F.concat(F.lit("  "), F.col(c), F.lit(" ")).alias(f" {c} ") for c in df.columns])
    tsv = lambda df, p: padded(df).write.option("sep", "\t").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p)
    tsv(star.labour_series(spark, folder), series_path)
    tsv(star.labour_observations(spark, folder, facts(spark, folder)), data_path)
    known = staging.stage_entities(star.reference_codes(spark, folder), C.staging).table
    return staging.stage_labour(
        io.read_labour_observations(spark, data_path), io.read_labour_series(spark, series_path), known, C.staging
    ).table


def _written_and_read(pairs) -> DataFrame:
    """Rows of each table, and the rows that a write and a guarded read lost or gained."""
    out = None
    for name, table, back in pairs:
        part = io.same_content(table, back).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query
def staged_tables_sink(spark, folder):
    tables = {k: v.table for k, v in staged(spark, folder).items()}
    paths = io.write_tables(tables, new_folder(spark, "staged"), "stg_")
    return _written_and_read([(n, tables[n], io.read_table(spark, p)) for n, p in paths.items()])


@query
def snapshot_sink(spark, folder):
    """The declared slices of one state, against the staged tables filtered alike."""
    tables, state = {k: v.table for k, v in staged(spark, folder).items()}, "15"
    paths = io.write_snapshots(tables, new_folder(spark, "snapshots"), state)
    cut = {n: t.filter(F.substring(ENTITY, 1, 2) == state) if ENTITY in t.columns else t for n, t in tables.items()}
    return _written_and_read([(n, cut[n], io.read_table(spark, p)) for n, p in paths.items()])


@query
def panel_sink_roundtrip(spark, folder):
    base = new_folder(spark, "tables")
    own = {"panel": panel(spark, folder), "modelling": model_rows(spark, folder)}
    for name, table in own.items():
        io.write_table(table, f"{base}/{name}.parquet")
    return _written_and_read([(n, t, io.read_table(spark, f"{base}/{n}.parquet")) for n, t in own.items()])


@query
def predictions_sink(spark, folder):
    path, own = new_folder(spark, "saved"), predictions(spark, folder)
    io.write_table(own, path, partition_by=["split"])
    return _written_and_read([("predictions", own, spark.read.parquet(path).select(*own.columns))])


@query
def table_fingerprint_check(spark, folder):
    """Order years against a recorded fingerprint, with one year altered, one lost and one new."""
    year = F.year("o_orderdate").alias("y")
    orders = star.table(spark, folder, "orders")
    recorded = io.fingerprint(orders.filter(F.year("o_orderdate") != 2001), year)
    changed = orders.filter(F.year("o_orderdate") != 1996).withColumn(
        "o_totalprice", F.when(F.year("o_orderdate") == 1998, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return io.compare_fingerprints(recorded, io.fingerprint(changed, year))


@query
def partition_manifest_check(spark, folder):
    """Orders by year against their manifest: 1998 altered, 1995 rewritten as it was; only these two are read."""
    path = new_folder(spark, "orders") + "/table"
    orders = star.table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    spread = F.pmod(F.xxhash64("o_orderkey"), F.lit(8))  # a year's rows go to several tasks
    put = lambda rows: (
        rows.repartition("y", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("y").parquet(path))
    put(orders)
    manifest.record(spark, path, "y")
    put(orders.filter("y IN (1995, 1998)").withColumn(
        "o_totalprice", F.when(F.col("y") == 1998, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return manifest.check(spark, path, "y")


# ------------------------------------------------------------------- scalars


@query
def scalar_identifiers(spark, folder):
    df = star.table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey")
    return df.select(
        "s_suppkey", S.compose_id(F.col("s_nationkey"), F.col("s_suppkey")).alias("short_id"),
        S.name_key(F.concat("s_name", F.lit(" City and Borough, west st."))).alias("key_borough"),
        S.name_key(F.concat(F.lit(" "), F.col("s_name"), F.lit("  PARISH"))).alias("key_parish"),
    )


@query
def scalar_dates(spark, folder):
    day = S.to_date(F.col("o_orderdate"))
    m = S.month_start(F.col("o_orderdate"))
    return star.table(spark, folder, "orders", "o_orderdate").select(day.alias("day"), m.alias("month")).groupBy("day", "month").agg(
        F.count(F.lit(1)).alias("orders")
    ).select(
        "day", "month", "orders", S.cutoff(F.col("month")).alias("cutoff"), S.published_at(F.col("month"), 50).alias("published"),
        S.period_label(F.col("month"), "Q").alias("quarter"), S.period_label(F.col("month"), "Y").alias("year"),
        F.month("month").alias("calendar_month"), F.date_format("month", "MMM").alias("abbr"),
    )


@query
def scalar_numbers(spark, folder):
    """Coercion of text to numbers and the positive mask, per event type and digit."""
    df = star.table(spark, folder, "events", "event_type", "props", "value")
    n = S.to_number(F.regexp_replace("props", r"[^0-9a-z]", ""))  # 'k69' is not a number
    m = S.to_number(F.regexp_replace("props", r"[^0-9]", ""))
    return df.groupBy("event_type").agg(
        F.count(n).alias("letters_parsed"), F.count(m).alias("digits_parsed"), F.sum(m.cast("long")).alias("digit_sum"),
        F.count(positive(m)).alias("positive_values"), F.count(F.lit(1)).alias("rows"),
    )


@query
def scalar_labels_and_bands(spark, folder):
    t = C.target
    p = panel(spark, folder)
    return p.select(
        *KEY, S.classify(F.col("target_dg"), t.tau).alias("label"), S.tier(F.col("homes_sold"), t.tiers).alias("tier"),
        S.band(F.col("mortgage_rate_30y"), C.rate_edges, C.rate_labels).alias("rate_band"),
    )


# --------------------------------------------------------------------- panel


@query
def panel_spine(spark, folder):
    s = staged(spark, folder)
    return pan.build_spine(s["entities"].table, s["housing"].table)


@query
def panel_spine_report(spark, folder):
    s = staged(spark, folder)
    return pan.spine_report(pan.build_spine(s["entities"].table, s["housing"].table))


@query
def panel_joined(spark, folder):
    s = staged(spark, folder)
    return pan.build_panel(*[s[k].table for k in jobs.SOURCES], C)


@query
def panel_join_report(spark, folder):
    s = staged(spark, folder)
    return pan.join_report(*[s[k].table for k in jobs.SOURCES])


@query
def duplicate_line_keys(spark, folder):
    return rows.duplicate_keys(star.table(spark, folder, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query
def validated_orders_customer_join(spark, folder):
    o = star.table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = star.table(spark, folder, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey")
    joined = rows.validated_join(o, c, ["o_custkey"], validate="many_to_one")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    )


# -------------------------------------------------------------------- target

_TARGET = ["homes_sold_median", "volume_tier", "is_included", "price_smoothed", "growth_yoy", "target_dg", "target_label", "has_target"]


@query
def target_columns(spark, folder):
    s = staged(spark, folder)
    return jobs.panel_from(s, C).select(*KEY, *_TARGET)


@query
def target_accounting(spark, folder):
    return tgt.target_report(panel(spark, folder))


@query
def target_excluded_entities(spark, folder):
    return tgt.excluded_entities(panel(spark, folder))


@query
def entity_volume_tiers(spark, folder):
    return tgt.entity_volume(panel(spark, folder), C.target)


@query
def modelling_rows(spark, folder):
    return model_rows(spark, folder).select(*KEY, "target_dg", "target_label")


@query
def base_effect_decomposition(spark, folder):
    return tgt.base_effect_parts(panel(spark, folder), C.target)


# ------------------------------------------------------ transforms, features


def _transform(spark, folder, name, params, column, lag=0):
    w = tgt.entity_window()
    return panel(spark, folder).select(
        *KEY, *[apply_transform(F.col(column), name, p, lag, w).alias(f"{name}{p}") for p in params]
    )


@query
def transform_lag(spark, folder):
    return _transform(spark, folder, "lag", (0, 1, 12), "growth_yoy")


@query
def transform_diff(spark, folder):
    return _transform(spark, folder, "diff", (1, 3, 12), "unemployment_rate", 2)


@query
def transform_log_diff(spark, folder):
    return _transform(spark, folder, "log_diff", (3, 12), "pending_sales")


@query
def transform_rollmean(spark, folder):
    return _transform(spark, folder, "rollmean", (6, 12), "homes_sold", 1)


@query
def transform_rollstd(spark, folder):
    return _transform(spark, folder, "rollstd", (6, 12), "growth_yoy")


@query
def transform_reltrend(spark, folder):
    return _transform(spark, folder, "reltrend", (6, 12), "inventory", 1)


@query
def capped_forward_fill(spark, folder):
    return feat.fill_gaps(panel(spark, folder), C.features).select(*KEY, "unemployment_rate", "unemployment_imputed")


@query
def uncapped_forward_fill(spark, folder):
    c = replace(C.features, fills=(FillPolicy(C.features.fills[0].source, 0, "unemployment_imputed"),))
    return feat.fill_gaps(panel(spark, folder), c).select(*KEY, "unemployment_rate", "unemployment_imputed")


@query
def feature_matrix(spark, folder):
    return feat.build_features(panel(spark, folder), C.features)


@query
def feature_accounting(spark, folder):
    return feat.feature_report(features(spark, folder), C.features)


@query
def feature_family_filled_cells(spark, folder):
    """Observed cells per feature family, over the whole matrix."""
    f = features(spark, folder)
    fam = C.features.families()
    cells = lambda names: F.sum(sum((F.col(n).isNotNull().cast("long") for n in names), F.lit(0).cast("long")))
    wide = f.agg(*[cells(v).alias(k) for k, v in fam.items()])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("family"), F.lit(len(v)).alias("features"), F.col(k).alias("cells")) for k, v in fam.items()
    ])).alias("x")).select("x.*")


@query
def feature_availability(spark, folder):
    return feat.availability(features(spark, folder), C.features)


# ------------------------------------------------------------------- quality


@query
def quality_checks(spark, folder):
    return quality.check_panel(panel(spark, folder), C)


@query
def quality_checks_rebuild(spark, folder):
    """The full rebuild job: staged tables, panel and modelling rows written, checks returned."""
    return jobs.rebuild(spark, staged(spark, folder), C, new_folder(spark, "rebuild"))["checks"]


@query
def quality_hard_bounds(spark, folder):
    return quality.bound_violations(panel(spark, folder), C.registry, "hard")


@query
def quality_plausible_bounds(spark, folder):
    return quality.bound_violations(panel(spark, folder), C.registry, "plausible")


@query
def quality_missingness(spark, folder):
    return quality.missingness(panel(spark, folder), C.registry)


@query
def quality_worst_missing(spark, folder):
    return quality.worst_missing(panel(spark, folder), C.registry)


@query
def quality_on_broken_panel(spark, folder):
    """The same checks on a panel with repeats, a lost month and impossible prices."""
    p = panel(spark, folder)
    broken = p.filter(F.col(PERIOD) != F.lit("1998-05-01").cast("date")).withColumn(
        "median_sale_price", F.when(F.month(PERIOD) == 7, -F.col("median_sale_price")).otherwise(F.col("median_sale_price"))
    ).drop("price_drops")
    return quality.check_panel(broken.unionByName(broken.filter(F.col("volume_tier") == "mid")), C)


@query
def split_row_count_guard(spark, folder):
    """Recorded counts against the split; the one recorded for the test split is off by one."""
    own = split(spark, folder)
    counts = {r["split"]: r["n"] for r in own.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per split
    counts["eligible"] = sum(n for s, n in counts.items() if s != "ineligible")
    recorded = tuple((s, counts.get(s, 0) + (s == TEST)) for s in (TRAIN, VALIDATION, TEST, "embargo", "eligible"))
    return sp.row_count_guard(own, replace(C.split, expected_rows=recorded))


@query
def split_counts_on_record(spark, folder):
    """The split without one month against the counts that writing the whole split recorded."""
    own, path = split(spark, folder), new_folder(spark, "split") + "/table"
    sp.write_split(own, path)
    later = own.filter(F.col(PERIOD) != F.lit("1998-05-01").cast("date"))
    return sp.row_count_guard(later, C.split, sp.recorded_counts(spark, path))


@query
def column_profile(spark, folder):
    return profile.observe(panel(spark, folder))


@query
def data_dictionary(spark, folder):
    return profile.dictionary(panel(spark, folder), C.registry)


@query
def coverage_by_entity(spark, folder):
    return eda.coverage(core(spark, folder))


@query
def coverage_lowest(spark, folder):
    return eda.lowest_coverage(core(spark, folder))


# -------------------------------------------------------------------- audits


@query
def audit_spine_gaps(spark, folder):
    """Gaps of the observed (not completed) housing months."""
    return audits.spine_gaps(staged(spark, folder)["housing"].table)


@query
def audit_publication(spark, folder):
    return audits.publication_audit(panel(spark, folder), C.features)


@query
def audit_publication_short_lag(spark, folder):
    """Negative control: a labour lag of one month must be reported as a leak."""
    short = C.features.with_release_lag(C.features.fills[0].source, 1)
    return audits.publication_audit(panel(spark, folder), short)


@query
def audit_cutoff(spark, folder):
    p = panel(spark, folder)
    bad = audits.cutoff_mismatches(p, C.features)
    return p.agg(F.count(F.lit(1)).alias("rows")).withColumn("mismatches", bad.agg(F.count(F.lit(1))).scalar())


@query
def audit_replay(spark, folder):
    """Every month of the panel as a cut."""
    return audits.replay_report(panel(spark, folder), C.features)


@query
def audit_early_features(spark, folder):
    return audits.early_features(features(spark, folder), C.features)


@query
def audit_split_boundaries(spark, folder):
    return audits.boundary_audit(split(spark, folder), C.target.horizon)


@query
def split_assignment(spark, folder):
    return split(spark, folder).select(*KEY, "split")


@query
def split_complete_features(spark, folder):
    """The stricter eligibility: every feature present."""
    c = replace(C.split, require_complete=True)
    return sp.assign_split(features(spark, folder), c, C.features).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query
def split_accounting(spark, folder):
    return sp.split_report(split(spark, folder))


# --------------------------------------------------------- naive forecasters


@query
def naive_parameters(spark, folder):
    return naive.fit_naive(naive_rows(spark, folder).filter(F.col("split") == TRAIN))


@query
def naive_predictions(spark, folder):
    return naive.predict_naive(naive_rows(spark, folder), C.target.tau)


# ------------------------------------------------------------------- metrics

_OUT = ["n", "mae", "rmse", "mean_error", "medae"]


@query
def metrics_magnitude(spark, folder):
    return metrics.evaluate(predictions(spark, folder), ["model", "split"]).select("model", "split", *_OUT)


@query
def metrics_direction(spark, folder):
    return metrics.evaluate(predictions(spark, folder), ["model", "split"]).select("model", "split", "n", "accuracy", "macro_f1", "balanced_accuracy")


@query
def metrics_probability(spark, folder):
    return metrics.evaluate(predictions(spark, folder), ["model", "split"]).select("model", "split", "log_loss", "brier")


@query
def metrics_forward(spark, folder):
    return metrics.evaluate(predictions(spark, folder), ["model", "split"], forward=True).select("model", "split", *metrics.FORWARD)


@query
def metrics_confusion(spark, folder):
    return metrics.confusion(predictions(spark, folder), ["model", "split"])


@query
def metrics_per_class(spark, folder):
    return metrics.per_class(predictions(spark, folder), ["model", "split"])


@query
def metrics_by_tier(spark, folder):
    return metrics.evaluate(test_rows(spark, folder), ["model", "volume_tier"])


@query
def metrics_by_year(spark, folder):
    return metrics.by_period(predictions(spark, folder), ["model"], "Y")


@query
def metrics_by_quarter(spark, folder):
    return metrics.by_period(test_rows(spark, folder), ["model"], "Q")


@query
def metrics_by_entity(spark, folder):
    return metrics.evaluate(test_rows(spark, folder), ["model", ENTITY], bounded=True)


@query
def metrics_model_table(spark, folder):
    return metrics.model_table(predictions(spark, folder))


@query
def metrics_skill(spark, folder):
    return metrics.skill_table(predictions(spark, folder))


@query
def exact_quantiles_bracketed(spark, folder):
    """Quantiles of three hot groups, over the whole line-item table."""
    li = star.table(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity")
    return quantiles.exact_quantiles(
        li, ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.975], ["l_returnflag"]
    )


# ----------------------------------------------------------------- bootstrap


@query
def bootstrap_intervals_entities(spark, folder):
    return bootstrap.intervals(test_rows(spark, folder), ["model"], blocks=("county",), contract=C.bootstrap)


@query
def bootstrap_intervals_months(spark, folder):
    return bootstrap.intervals(
        test_rows(spark, folder), ["model"], ("mae", "rmse", "mean_error", "accuracy", "macro_f1", "balanced_accuracy"),
        blocks=("month",), contract=C.bootstrap,
    )


@query
def bootstrap_median_error(spark, folder):
    return bootstrap.intervals(test_rows(spark, folder), ["model"], ("medae",), blocks=("month",), contract=C.bootstrap)


@query
def bootstrap_poisson_weights(spark, folder):
    """The other scheme: weights without a shuffle on the drawn block."""
    return bootstrap.intervals(
        test_rows(spark, folder), ["model"], ("mae",), blocks=("county",), contract=replace(C.bootstrap, scheme="poisson"))


@query
def bootstrap_paired_difference(spark, folder):
    p = predictions(spark, folder)
    return bootstrap.paired_difference(
        results.scored(p, TEST, "base_effect"), results.scored(p, TEST, "zero_change"), "mae", "county", C.bootstrap
    )


@query
def bootstrap_paired_median(spark, folder):
    """Difference of median errors under both block schemes."""
    p = predictions(spark, folder)
    a, b = results.scored(p, TEST, "base_effect"), results.scored(p, TEST, "zero_change")
    return bootstrap.paired_difference(a, b, "medae", "county", C.bootstrap).unionByName(
        bootstrap.paired_difference(a, b, "medae", "month", C.bootstrap))


# ----------------------------------------------------------------------- EDA


@query
def eda_target_distribution(spark, folder):
    return eda.describe_target(model_rows(spark, folder))


@query
def eda_prevalence(spark, folder):
    return eda.prevalence(core_rows(spark, folder))


@query
def eda_prevalence_by_year(spark, folder):
    return eda.prevalence_by_year(core_rows(spark, folder))


@query
def eda_crosstab_by_year(spark, folder):
    return eda.crosstab(core_rows(spark, folder).withColumn("year", F.year(PERIOD)), ["year"])


@query
def eda_prevalence_by_tier(spark, folder):
    return eda.prevalence_by_tier(model_rows(spark, folder), C.target)


@query
def eda_prevalence_by_entity(spark, folder):
    return eda.prevalence_by_entity(core_rows(spark, folder))


@query
def eda_dispersion(spark, folder):
    return eda.dispersion(core_rows(spark, folder))


@query
def eda_dispersion_excluded(spark, folder):
    return eda.excluded_dispersion(panel(spark, folder))


@query
def eda_dispersion_labelled(spark, folder):
    return eda.labelled_dispersion(panel(spark, folder), C.target)


@query
def eda_coverage_summary(spark, folder):
    return eda.coverage_summary(panel(spark, folder))


@query
def eda_outliers(spark, folder):
    return eda.outliers(panel(spark, folder), C.registry)


@query
def eda_seasonality(spark, folder):
    return eda.seasonality(core_rows(spark, folder))


@query
def eda_regime_series(spark, folder):
    return eda.regime_series(core_rows(spark, folder))


@query
def eda_shift_scan(spark, folder):
    return eda.shift_scan(core_rows(spark, folder))


@query
def eda_regime_shifts(spark, folder):
    return eda.regime_shifts(core_rows(spark, folder))


@query
def eda_regime_shifts_by_tier(spark, folder):
    return eda.regime_shifts(core_rows(spark, folder), ["volume_tier"])


@query
def eda_rate_regimes(spark, folder):
    return eda.rate_regimes(model_rows(spark, folder), C)


@query
def eda_representatives(spark, folder):
    return eda.representatives(model_rows(spark, folder))


@query
def eda_representative_series(spark, folder):
    return eda.representative_series(panel(spark, folder), model_rows(spark, folder))


@query
def eda_histogram(spark, folder):
    return eda.histogram(core_rows(spark, folder))


@query
def eda_histogram_tails(spark, folder):
    return eda.omitted_tails(core_rows(spark, folder))


# ------------------------------------------------------------------- results

_A, _B = "base_effect", "mean_reversion"  # the two models the tables compare


def _result_tables(prefix: str, rows: Callable, a: str, b: str, claim: tuple[str, str]) -> None:
    """Register every result table over ``rows``, comparing ``a`` (errors) and ``b`` (classes)."""
    t = replace(C.target, tiers=C.target.tiers[:-1])
    tables = {
        "headline": lambda p: results.headline(p, VALIDATION),
        "concise": results.concise,
        "by_tier": lambda p: results.by_tier(p, a, C.target),
        "tier_table": lambda p: results.tier_table(p, a, b, C.target),
        "by_entity": lambda p: results.by_entity(p, a),
        "base_effect_correlation": lambda p: results.base_effect_correlation(p, a),
        "forward_rows": lambda p: results.forward_rows(p, claim[0]),
        "intervals": lambda p: results.interval_table(p, {a: ("mae",), b: ("macro_f1",)}, C.bootstrap),
        "claim_facts": lambda p: results.claim_facts(p, t, *claim),
        "full_tables": results.full_tables,
        "breakdown": lambda p: results.breakdown(p, [a, b], C.target),
        "confusion": lambda p: results.confusion_tables(p, [a, b]),
    }
    for name, table in tables.items():
        QUERIES[f"{prefix}_{name}"] = lambda spark, folder, table=table: tidy(table(rows(spark, folder)))


_result_tables("results", predictions, _A, _B, (_B, _A))
_result_tables("learned", all_predictions, results.RIDGE, results.LOGISTIC, (results.RIDGE, results.LOGISTIC))
QUERIES["learned_results"] = QUERIES.pop("learned_concise")


# ------------------------------------------------------- learned forecasters


@query
def imputer_medians(spark, folder):
    return quantiles.exact_quantiles(train(spark, folder), C.features.names(), [0.5]).select("column", F.col("value").alias("median"))


@query
def imputer_scaling(spark, folder):
    s = learned.moments(train(spark, folder), C.features.names()).scaling
    rows_ = [(f, float(m), float(a), float(d)) for f, m, a, d in zip(s.features, s.medians, s.means, s.sds)]
    return spark.createDataFrame(rows_, "feature string, median double, mean double, scale double")


@query
def ridge_normal_equations(spark, folder):
    """The system that the chosen ridge fit on the training rows solves, and its solution: cells in long form, per row of data."""
    found = run(spark, folder)
    return learned.normal_equations(spark, found.moments, found.params["alpha"])


@query
def ridge_coefficients(spark, folder):
    return run(spark, folder).ridge.coefficients(spark)


@query
def ridge_alpha_scan(spark, folder):
    return run(spark, folder).ridge_scores


@query
def logistic_c_scan(spark, folder):
    return run(spark, folder).logistic_scores


@query
def logistic_coefficients(spark, folder):
    return run(spark, folder).logistic.coefficients(spark)


@query
def learned_predictions(spark, folder):
    return all_predictions(spark, folder).filter(F.col("model").isin(results.RIDGE, results.LOGISTIC))


@query
def coefficient_top(spark, folder):
    """The 15 largest standardised coefficients of each learned model."""
    found = run(spark, folder)
    return learned.top_coefficients(spark, {results.RIDGE: found.ridge, results.LOGISTIC: found.logistic})


@query
def family_ablation(spark, folder):
    found, val = run(spark, folder), split(spark, folder).filter(F.col("split") == VALIDATION)
    m = found.moments
    vv = learned.assemble(val, m.scaling, naive.TRUTH)
    return learned.ablate(m, m.assembled(naive.TRUTH), vv, C.features, found.params["alpha"], found.chosen, C.target.tau).drop("steps")
