"""Integrity of partitioned tables by a manifest beside them.

A manifest has one row per partition: how its files look (names, sizes, times) and
its fingerprint.  Checking lists the files, and reads only partitions whose files
are not those recorded; the table's fingerprint is the sum over the manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import compare_fingerprints, fingerprint


def manifest_path(path: str) -> str:
    return path.rstrip("/") + ".manifest"


def file_states(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``(part, files, bytes, state)`` per partition; no file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    own = F.xxhash64(F.regexp_extract("path", "[^/]+$", 0), "length", "modificationTime").cast("decimal(38,0)")
    return listed.groupBy(F.col(by).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum(own).alias("state"))


def record(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Read the table once and write its manifest in place of an earlier one."""
    states = file_states(spark, path, by).alias("a")
    prints = fingerprint(spark.read.parquet(path), by).alias("b")
    (states.join(prints, F.col("a.part").eqNullSafe(F.col("b.part")), "left")
     .select("a.*", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("content_hash", F.lit(0)).alias("content_hash"))
     .write.mode("overwrite").parquet(manifest_path(path)))
    return spark.read.parquet(manifest_path(path))


def total(manifest: DataFrame) -> DataFrame:
    """The whole table's fingerprint; equal to that of its rows, however they are partitioned."""
    return manifest.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("content_hash").alias("content_hash"))


def _among(by: str, parts: list[str | None]) -> Column:
    own = F.col(by).cast("string")
    return reduce(lambda a, b: a | b, [own.isin([p for p in parts if p is not None]), *([own.isNull()] if None in parts else [])])


def check(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``(part, rows_recorded, rows_found, status, was_read)`` for every partition recorded or found.

    The names of partitions with other files are collected (the driver holds the
    table's file list anyway) and become partition filters of the only scan.  A
    partition rewritten with equal rows is ``ok`` and was read.
    """
    recorded = spark.read.parquet(manifest_path(path))
    a, b = file_states(spark, path, by).alias("a"), recorded.alias("b")
    joined = a.join(b, F.col("a.part").eqNullSafe(F.col("b.part")), "left")
    other = [r[0] for r in joined.filter(~F.col("a.state").eqNullSafe(F.col("b.state"))).select("a.part").collect()]
    there = a.join(b, F.col("a.part").eqNullSafe(F.col("b.part")) & F.col("a.state").eqNullSafe(F.col("b.state")))
    current = there.select("b.part", "b.rows", "b.content_hash", F.lit(False).alias("was_read"))
    if other:
        fresh = fingerprint(spark.read.parquet(path).filter(_among(by, other)), by)
        current = current.unionByName(fresh.withColumn("was_read", F.lit(True)))
    found = compare_fingerprints(recorded, current.drop("was_read")).alias("f")
    read = current.select("part", "was_read").alias("r")
    return found.join(read, F.col("f.part").eqNullSafe(F.col("r.part")), "left").select(
        "f.*", F.coalesce("was_read", F.lit(False)).alias("was_read"))
