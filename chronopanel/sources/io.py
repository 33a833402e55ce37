"""Scans and sinks.

Raw text files are read with an all-string schema (a padded code must never be
inferred as a number) and cast with ``try_cast`` afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import snake_case
from ..schema import ENTITY, PERIOD


def read_delimited(spark: SparkSession, path: str, sep: str, columns: list[str] | None = None) -> DataFrame:
    """Header-bearing text table, every column a trimmed string, names snake_cased.

    Only the header line is looked at to build the schema; the scan itself is
    lazy and parses just the selected columns.
    """
    reader = spark.read.option("sep", sep).option("header", True)
    header = reader.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    raw = reader.schema(schema).option("enforceSchema", True).csv(path)
    raw = raw.toDF(*snake_case(header))
    names = columns or raw.columns
    return raw.select(*[F.trim(F.col(c)).alias(c) for c in names])


def read_reference_codes(spark, path):
    """Pipe-delimited entity codes."""
    return read_delimited(spark, path, "|")


def read_housing_bulk(spark, path, measures):
    """Tab-separated bulk file, pruned to the context columns and the measures.

    A gzip file is one task; land it once as Parquet (``land_housing_bulk``) and
    read that instead when it is used more than once.
    """
    context = ["period_begin", "period_end", "period_duration", "region_type", "region",
               "state_code", "property_type", "last_updated"]
    raw = read_delimited(spark, path, "\t", context + list(measures))
    return raw.select(*context, *[F.col(m).try_cast("double").alias(m) for m in measures])


def land_housing_bulk(bulk: DataFrame, path: str, spread: int = 16) -> None:
    """Splittable copy, partitioned on the two columns every reader filters on.

    Rows of one state and year are spread over ``spread`` tasks and files, so a hot one is not one task's.
    """
    (bulk.withColumn("period_year", F.year(F.col("period_begin").try_cast("date")))
     .repartition("state_code", "period_year", F.pmod(F.xxhash64("region", "period_begin"), F.lit(spread)))
     .write.mode("overwrite").partitionBy("state_code", "period_year").parquet(path))


def read_rate_series(spark, path):
    """Comma-separated dated series; the value stays text until it is coerced."""
    return read_delimited(spark, path, ",")


def read_labour_series(spark, path):
    return read_delimited(spark, path, "\t", ["series_id", "area_type_code", "area_code", "measure_code"])


def read_labour_observations(spark, path):
    return read_delimited(spark, path, "\t", ["series_id", "year", "period", "value"])


def guard_keys(df: DataFrame) -> DataFrame:
    """Schema check only: the entity key must be text and the month a date."""
    types = dict(df.dtypes)
    if types.get(ENTITY, "string") != "string":
        raise TypeError(f"{ENTITY} must be string, found {types[ENTITY]}")
    if types.get(PERIOD, "date") != "date":
        raise TypeError(f"{PERIOD} must be date, found {types[PERIOD]}")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return guard_keys(spark.read.parquet(path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = guard_keys(df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, prefix: str = "") -> dict[str, str]:
    """One Parquet table per entry; the staged (``stg_``) and snapshot sinks."""
    paths = {name: f"{folder}/{prefix}{name}.parquet" for name in tables}
    for name, table in tables.items():
        write_table(table, paths[name])
    return paths


SNAPSHOTS = ("entities", "housing", "mortgage_rate", "unemployment")


def write_snapshots(tables: dict[str, DataFrame], folder: str, state: str | None = None, names=SNAPSHOTS) -> dict[str, str]:
    """The declared slices of the staged tables, cut to one state's entities where there are any.

    Every declared table must be there; tables without entities are written whole.
    """
    absent = [n for n in names if n not in tables]
    if absent:
        raise KeyError(f"no staged table for the snapshots {', '.join(absent)}")
    own = lambda t: t.filter(F.col(ENTITY).startswith(state)) if state and ENTITY in t.columns else t
    return write_tables({n: own(tables[n]) for n in names}, folder, "snapshot_")


# ------------------------------------------------------------- fingerprints


def fingerprint(df: DataFrame, by: Column | str, name: str = "part") -> DataFrame:
    """Order-free content hash per part: row count and the sum of row hashes.

    The sum is a decimal because a long sum overflows under ANSI mode.
    """
    part = (F.col(by) if isinstance(by, str) else by).cast("string").alias(name)
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("content_hash"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table, and rows that the other lacks, copies counted."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    sides = a.select(*columns, F.lit(1).alias("_d")).unionByName(b.select(*columns, F.lit(-1).alias("_d")))
    per = sides.groupBy(*columns).agg(F.sum("_d").alias("_d"), F.count_if(F.col("_d") > 0).alias("_a"), F.count_if(F.col("_d") < 0).alias("_b"))
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
        ("_a", "rows"), ("_b", "rows_back"), (F.greatest("_d", F.lit(0)), "lost"), (F.greatest(-F.col("_d"), F.lit(0)), "gained"))])


def compare_fingerprints(recorded: DataFrame, current: DataFrame, name: str = "part") -> DataFrame:
    """Every part with its status; a mismatch never hides the ones after it."""
    a, b = recorded.alias("a"), current.alias("b")
    joined = a.join(b, F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")), "full_outer")
    same = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))
    status = (
        F.when(F.col("b.rows").isNull(), "missing")
        .when(F.col("a.rows").isNull(), "not recorded")
        .when(same, "ok")
        .otherwise("mismatch")
    )
    return joined.select(
        F.coalesce(F.col(f"a.{name}"), F.col(f"b.{name}")).alias(name),
        F.col("a.rows").alias("rows_recorded"),
        F.col("b.rows").alias("rows_found"),
        status.alias("status"),
    )
