"""What several operators need: landing tables, slicing batches, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

SLICE_BYTES = 2 << 20  # text handled at a time inside a task


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it back (cuts lineage, survives lost executors)."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster installs or ships it)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def slices(lengths: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows holding at most ``most`` units each, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES):
    """Cut Arrow batches to slices of bounded text; yields (slice, list of whole texts with null as '')."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = [n or 0 for n in pc.binary_length(batch.column(at)).to_pylist()]
        for lo, hi in slices(sizes, most):
            part = batch.slice(lo, hi - lo)
            yield part, [t or "" for t in part.column(at).to_pylist()]


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge table ``(a, b)`` of longs.

    Large-star and small-star steps alternate until no edge changes.  Each is an
    aggregate for the smallest neighbour (combined map-side, so a hub's
    neighbours never meet in one task) and a join back that adaptive execution
    may split.  Every round is landed.  Returns ``(node, component)`` for nodes
    with an edge; an empty edge table gives an empty result.
    """
    low = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = store(low.distinct(), f"{name}-0")
    mark = _mark(now)
    for step in range(1, most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        now = store(small, f"{name}-{step}")
        was, mark = mark, _mark(now)
        if mark == was:
            heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
    raise RuntimeError(f"components still changing after {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Equal marks mean equal edge sets (row count and two independent hash sums)."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.hash("v", "u").cast("long"))
    ).first()
    return tuple(row)
