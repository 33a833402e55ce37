"""Column profiles: what the registry declares next to what the panel holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import registry_frame
from .quantiles import exact_quantiles


def observe(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, null rate, range, median, share true or distinct count of each column.

    One aggregation covers everything additive; medians use the exact bracketed
    quantile and distinct texts are counted after a grouping pass each, because
    neither has bounded state in a single task.
    """
    fields = {f.name: f.dataType for f in panel.schema.fields}
    names = columns or panel.columns
    numeric = [c for c in names if isinstance(fields[c], T.NumericType)]
    dates = [c for c in names if isinstance(fields[c], (T.DateType, T.TimestampType))]
    flags = [c for c in names if isinstance(fields[c], T.BooleanType)]
    texts = [c for c in names if isinstance(fields[c], T.StringType)]

    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggs.append(F.count(c).alias(f"n{i}"))
        if c in numeric:
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
        if c in dates:
            aggs += [F.min(F.to_date(c)).alias(f"lo{i}"), F.max(F.to_date(c)).alias(f"hi{i}")]
        if c in flags:
            aggs.append(F.count_if(F.col(c)).alias(f"t{i}"))
    wide = panel.agg(*aggs)
    null = F.lit(None)

    def cell(i, c):
        num, day, flag = c in numeric, c in dates, c in flags
        return F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(fields[c].simpleString()).alias("dtype"),
            (1 - F.try_divide(F.col(f"n{i}"), F.col("rows"))).alias("null_rate"),
            (F.col(f"lo{i}") if num else null.cast("double")).alias("min"),
            (F.col(f"hi{i}") if num else null.cast("double")).alias("max"),
            (F.col(f"lo{i}") if day else null.cast("date")).alias("first_date"),
            (F.col(f"hi{i}") if day else null.cast("date")).alias("last_date"),
            (F.try_divide(F.col(f"t{i}"), F.col(f"n{i}")) if flag else null.cast("double")).alias("share_true"),
        )

    base = wide.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(names)])).alias("c")).select("c.*")
    out = base
    if numeric:
        medians = exact_quantiles(panel, numeric, [0.5]).select("column", F.col("value").alias("median"))
        out = out.join(F.broadcast(medians), "column", "left")
    else:
        out = out.withColumn("median", null.cast("double"))
    if texts:
        distinct = (
            panel.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in texts
            ])).alias("x")).select("x.*").filter("v IS NOT NULL")
            .groupBy("column", "v").agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        )
        out = out.join(F.broadcast(distinct), "column", "left")
    else:
        out = out.withColumn("distinct", null.cast("long"))
    return out


def dictionary(panel: DataFrame, registry) -> DataFrame:
    """Declared fields joined to the observation of every documented panel column."""
    names = [c.name for c in registry if c.name in panel.columns]
    declared = registry_frame(panel.sparkSession, registry)
    return observe(panel, names).join(F.broadcast(declared), "column")
