import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from chronopanel.contracts import MEASURES, PRODUCTION
from chronopanel.operators.rows import account
from chronopanel.sources import io, staging

C = PRODUCTION.staging


@pytest.fixture(scope="module")
def codes(tmp_path_factory):
    p = tmp_path_factory.mktemp("raw") / "codes.txt"
    p.write_text("STATE|STATEFP|COUNTYFP|COUNTYNAME\nCA|06|001|Alameda County\nCA|06|037|Los Angeles County\nNV|32|003|Clark County\n")
    return str(p)


@pytest.fixture(scope="module")
def entities(spark, codes):
    return staging.stage_entities(io.read_reference_codes(spark, codes), C)


def counts(s):
    return {r.reason: r.rows for r in account(s.tagged, s.source).collect()}


def test_reference_codes(entities):
    rows = entities.table.orderBy("county_fips").collect()
    assert [(r.county_fips, r.county_name_key) for r in rows] == [("06001", "alameda"), ("06037", "los angeles")]
    assert counts(entities) == {"staged": 2, "other state": 1}


def test_housing_bulk(spark, entities, tmp_path):
    head = ["PERIOD_BEGIN", "PERIOD_END", "PERIOD_DURATION", "REGION_TYPE", "REGION", "STATE_CODE", "PROPERTY_TYPE", "LAST_UPDATED", "IGNORED", *[m.upper() for m in MEASURES]]

    def line(region, state="CA", duration="30", kind="county", prop="All Residential", price="500000"):
        return ["2024-01-01", "2024-01-31", duration, kind, region, state, prop, "2024-03-01 10:00:00", "x", price, *["1.5"] * 12]

    lines = [
        line("Los Angeles County, CA"), line("Alameda County, CA", price=""), line("Nowhere County, CA"), line("Clark County, NV", "NV"),
        line("Los Angeles County, CA", duration="90"), line("Los Angeles County, CA", prop="Condo/Co-op"), line("CA", kind="state"),
    ]
    path = tmp_path / "bulk.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join("\t".join(r) for r in [head, *lines]) + "\n")
    raw = io.read_housing_bulk(spark, str(path), MEASURES)
    s = staging.stage_housing(raw, entities.table, C)
    rows = {r.county_fips: r for r in s.table.collect()}
    assert set(rows) == {"06001", "06037"} and rows["06001"].median_sale_price is None and rows["06037"].median_sale_price == 500000.0
    assert rows["06037"].reference_month == dt.date(2024, 1, 1) and rows["06037"].redfin_last_updated == dt.datetime(2024, 3, 1, 10)
    assert counts(s) == {"staged": 2, "not an entity-month aggregate row": 4, "name not in the reference list": 1}
    assert [r.region for r in staging.unmatched_names(s).collect()] == ["Nowhere County, CA"]
    out = str(tmp_path / "landed")
    io.land_housing_bulk(raw, out)
    landed = spark.read.parquet(out)
    assert landed.count() == 7
    plan = landed.filter("state_code = 'CA'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state_code" in plan


def test_rate_series(spark, tmp_path):
    p = tmp_path / "rate.csv"
    p.write_text("observation_date,MORTGAGE30US\n2024-01-25,6.9\n2024-01-04,6.5\n2024-01-11,.\n2024-02-01,7.0\nbad,7.1\n")
    s = staging.stage_rate(io.read_rate_series(spark, str(p)))
    jan = s.table.filter("reference_month = '2024-01-01'").first()
    assert jan.mortgage_rate_30y == pytest.approx(6.7) and jan.mortgage_rate_30y_last == 6.9
    assert jan.mortgage_rate_weeks_observed == 2 and jan.mortgage_rate_last_release == dt.date(2024, 1, 25)
    assert counts(s)["missing or non-numeric rate"] == 1


def test_labour_files_are_padded(spark, entities, tmp_path):
    series, data = tmp_path / "series.txt", tmp_path / "data.txt"
    series.write_text(
        "series_id      \tarea_type_code\tarea_code      \tmeasure_code \n"
        + "".join(f"LA{a}{m}   \t{t}\t{p}{a}00000000\t{m} \n" for t, p, a in (("F", "CN", "06037"), ("F", "CN", "06999"), ("A", "ST", "06000")) for m in ("03", "04", "05", "06", "07"))
    )
    data.write_text(
        "series_id \tyear\tperiod\t       value\tfootnote_codes\n"
        "LA0603703 \t2024\tM01\t        5.1\t\nLA0603706 \t2024\tM01\t     1000\t\nLA0603703 \t2024\tM13\t        5.0\t\n"
        "LA0603703 \t2024\tM02\t        -  \t\nLA0600003 \t2024\tM01\t        4.0\t\nLA0603707 \t2024\tM01\t        1.0\t\nLA0699903 \t2024\tM01\t 3.3\t\n"
    )
    s = staging.stage_labour(io.read_labour_observations(spark, str(data)), io.read_labour_series(spark, str(series)), entities.table, C)
    rows = s.table.collect()
    assert len(rows) == 1 and (rows[0].county_fips, rows[0].unemployment_rate, rows[0].labor_force, rows[0].employed) == ("06037", 5.1, 1000.0, None)
    assert counts(s) == {"staged": 3, "annual average or non-monthly period": 1, "not a wanted series": 2, "unparseable date or suppressed value": 1}


def test_key_guard(spark, tmp_path):
    bad = spark.createDataFrame([(6037, 1.0)], "county_fips int, x double")
    with pytest.raises(TypeError, match="string"):
        io.write_table(bad, str(tmp_path / "t"))
    bad.write.parquet(str(tmp_path / "u"))
    with pytest.raises(TypeError, match="string"):
        io.read_table(spark, str(tmp_path / "u"))
    good = bad.withColumn("county_fips", F.lit("06037"))
    io.write_table(good, str(tmp_path / "v"))
    assert io.read_table(spark, str(tmp_path / "v")).first().county_fips == "06037"


def test_fingerprint_reports_every_part(spark):
    a = spark.range(100).select((F.col("id") % 5).alias("p"), F.col("id").alias("x"))
    b = a.filter("p <> 1").withColumn("x", F.when(F.col("x") == 7, 8).otherwise(F.col("x"))).unionByName(spark.sql("select 9L p, 1L x"))
    got = {r.part: r.status for r in io.compare_fingerprints(io.fingerprint(a, "p"), io.fingerprint(b.repartition(7), "p")).collect()}
    assert got == {"0": "ok", "1": "missing", "2": "mismatch", "3": "ok", "4": "ok", "9": "not recorded"}


def test_manifest_reads_changed_partitions_alone(spark, tmp_path):
    import os

    from chronopanel.sources import manifest

    path = str(tmp_path / "t")
    rows = spark.range(60).select(F.col("id").alias("x"), F.when(F.col("id") % 4 < 3, F.concat(F.lit("a:"), F.col("id") % 4)).alias("p"))
    put = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(path)
    put(rows)
    kept = manifest.record(spark, path, "p")
    assert tuple(manifest.total(kept).first()) == tuple(io.fingerprint(spark.read.parquet(path), F.lit("all")).select("rows", "content_hash").first())
    status = lambda: {r.part: (r.status, r.was_read) for r in manifest.check(spark, path, "p").collect()}
    assert status() == {p: ("ok", False) for p in ("a:0", "a:1", "a:2", None)}

    put(rows.filter("p IS NULL").withColumn("x", F.col("x") + 1))
    put(spark.sql("SELECT 1L x, 'new' p"))
    put(rows.filter("p = 'a:1'"))
    unread = next((tmp_path / "t" / "p=a%3A0").glob("*.parquet"))
    was = unread.stat()
    unread.write_bytes(b"\0" * was.st_size)  # no reader gets through this
    os.utime(unread, ns=(was.st_atime_ns, was.st_mtime_ns))
    for f in (tmp_path / "t" / "p=a%3A2").glob("*"):
        f.rename(f.with_suffix(".gone"))
    assert status() == {"a:0": ("ok", False), "a:1": ("ok", True), "a:2": ("missing", False), None: ("mismatch", True), "new": ("not recorded", True)}


def test_shared_folder_is_the_clusters(spark):
    from chronopanel import session

    class Context:
        master, applicationId = "spark://host", "app-1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": "hdfs://shared/work/"}

    assert session.shared_folder(Session()) == "hdfs://shared/work"
    Session.conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    assert session.shared_folder(spark) == session.shared_folder(spark)


def test_release_deletes_what_was_written(spark, tmp_path, monkeypatch):
    import os

    from chronopanel import session

    for kept in ("_landed", "_tables", "_written"):  # the landed tables of other tests stay
        monkeypatch.setattr(session, kept, {})
    monkeypatch.setattr(session, "on_release", [])
    paths = [session.new_folder(spark, "one"), session.new_folder(spark, "two")]
    spark.range(3).write.parquet(paths[0] + "/table")
    spark.range(3).write.parquet(paths[1])
    assert session.land(spark.range(3).toDF("x"), "three").count() == 3
    mine = [*session._written[spark.sparkContext.applicationId]]
    assert len(mine) == 3 and all(os.path.exists(p) for p in mine)
    session.release(spark)
    assert not any(os.path.exists(p) for p in mine)


def test_joins_refuse_repeated_keys(spark, entities):
    from chronopanel.operators.panel import build_panel
    from helpers import small_sources

    labour = staging.LABOUR_MEASURES
    code = next(iter(labour))
    series = spark.createDataFrame([("S1", "F", "CN0603700000000", code)] * 2, "series_id string, area_type_code string, area_code string, measure_code string")
    seen = spark.createDataFrame([("S1", "2024", "M01", "5.0")], "series_id string, year string, period string, value string")
    with pytest.raises(Exception, match="series key repeats"):
        staging.stage_labour(seen, series, entities.table, C).table.collect()
    once = series.distinct()
    assert staging.stage_labour(seen, once, entities.table, C).table.count() == 1
    with pytest.raises(Exception, match="given twice"):
        staging.stage_labour(seen.unionByName(seen), once, entities.table, C).table.collect()
    e, h, r, u = small_sources(spark)[:4]
    from chronopanel.contracts import PRODUCTION

    with pytest.raises(Exception, match="rate key repeats"):
        build_panel(e, h, r.unionByName(r), u, PRODUCTION).collect()


def test_names_are_looked_up_within_their_state(spark):
    from dataclasses import replace

    codes = spark.createDataFrame(
        [("06", "001", "Lake County", "CA"), ("08", "003", "Lake County", "CO")], "statefp string, countyfp string, countyname string, state string")
    every = replace(C, state=None, state_abbrev=None)
    known = staging.stage_entities(codes, every).table
    rows = spark.createDataFrame(
        [("2024-01-01", "30", "county", "Lake County, CA", "CA", "All Residential", "x", 1.0), ("2024-01-01", "30", "county", "Lake County, CO", "CO", "All Residential", "x", 2.0)],
        "period_begin string, period_duration string, region_type string, region string, state_code string, property_type string, last_updated string, m double")
    wide = rows.selectExpr("*", *[f"m AS {x}" for x in MEASURES])
    got = staging.stage_housing(wide, known, every).table.collect()
    assert sorted((r.county_fips, r.homes_sold) for r in got) == [("06001", 1.0), ("08003", 2.0)]
    with pytest.raises(Exception, match="key repeats"):
        staging.stage_housing(wide, known.drop("state_code"), every).table.collect()


def test_snapshots_and_content(spark, tmp_path):
    t = spark.createDataFrame([("06001", 1), ("06001", 1), ("08001", 2)], "county_fips string, n int")
    rate = spark.createDataFrame([(1.5,)], "rate double")
    tables = {"entities": t, "housing": t, "mortgage_rate": rate, "unemployment": t}
    paths = io.write_snapshots(tables, str(tmp_path), "06")
    assert spark.read.parquet(paths["housing"]).count() == 2 and spark.read.parquet(paths["mortgage_rate"]).count() == 1
    with pytest.raises(KeyError, match="unemployment"):
        io.write_snapshots({k: v for k, v in tables.items() if k != "unemployment"}, str(tmp_path))
    same = lambda a, b: tuple(io.same_content(a, b).first())
    assert same(t, t) == (3, 3, 0, 0) and same(t, t.distinct()) == (3, 2, 1, 0)
    assert same(t, t.withColumn("n", t.n + 1)) == (3, 3, 3, 3)
