"""Session helpers: a local session for tests, and where intermediate tables land."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int | str = "*", app: str = "chronopanel") -> SparkSession:
    n = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_folders:
        _local_folders[key] = tempfile.mkdtemp(prefix="spark-chronopanel-")
    return _local_folders[key]


_local_folders: dict[str, str] = {}
_landed: dict[tuple[str, str], DataFrame] = {}
_tables: dict[tuple[str, str], str] = {}
_written: dict[str, list[str]] = {}
on_release: list = []  # called by ``release``, for what else is kept of landed tables


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; ``release`` deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def joins_by_part_of_keys(spark: SparkSession):
    """Within it, joins accept sides that are both distributed by the same part of the keys; the session's setting is put back."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def land(
    df: DataFrame, name: str, bucket_by: str | None = None, sort_by: list[str] | None = None,
    clustered: bool = False, partition_by: list[str] | None = None, buckets: int | None = None,
    observe: tuple[Observation, list[Column]] | None = None, co_located: bool = False,
) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    This cuts lineage (a lost executor re-reads files) and, with ``bucket_by``,
    leaves the table hash-distributed on that column, so later windows and
    aggregations on it need no exchange.  ``clustered`` says the rows already sit
    that way (they come from a table bucketed alike), so they are not moved again.
    ``buckets`` is the table's own number, by default that of the shuffle partitions.
    ``observe`` takes aggregates along in the writing stage itself, after the last
    exchange, where a task that runs twice is counted once.  ``co_located`` says the
    plan's joins lie by part of their keys on purpose, which must then suffice.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if bucket_by is not None and not clustered:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        df = df.repartition(buckets, bucket_by)
    if observe:
        df = df.observe(observe[0], *observe[1])
    how = joins_by_part_of_keys(spark) if co_located else nullcontext()
    if bucket_by is None:
        with how:
            df.write.partitionBy(*(partition_by or [])).parquet(path)
        return spark.read.schema(df.schema).parquet(path).select(*df.columns)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    table = f"chronopanel_{name}_{uuid.uuid4().hex[:12]}"
    with how:
        (
            df.write.option("path", path)
            .format("parquet")
            .bucketBy(buckets, bucket_by)
            .sortBy(*(sort_by or [bucket_by]))
            .saveAsTable(table)
        )
    _tables[(spark.sparkContext.applicationId, table)] = table
    return spark.table(table)


def landed(spark: SparkSession, key: str, build, **how) -> DataFrame:
    """Land a table on first use and share it for the rest of the application."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _landed:
        _landed[k] = land(build(), key.split("@")[0], **how)
    return _landed[k]


def is_landed(spark: SparkSession, key: str) -> bool:
    return (spark.sparkContext.applicationId, key) in _landed


def release(spark: SparkSession) -> None:
    """Forget this application's landed tables and delete all it wrote to the shared folder."""
    app = spark.sparkContext.applicationId
    for forget in on_release:
        forget()
    for k in [k for k in _landed if k[0] == app]:
        del _landed[k]
    for k in [k for k in _tables if k[0] == app]:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(k)}")
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for folder in _written.pop(app, []):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
