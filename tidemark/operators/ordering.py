"""Ranks and running sums over a whole table, without one task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut


def ranked(df: DataFrame, order: list[Column], name: str = "rank", total: str | None = None, running: str | None = None, partitions: int | None = None) -> DataFrame:
    """Adds ``name``, 1, 2, ... in ``order`` (which must be total), and with ``total`` and ``running`` the running sum of
    a column up to and including the row. Rows are dealt by range; only a count and a sum for each range reach the
    driver.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    value = F.sum(total) if total else F.lit(0)
    sizes = sorted(dealt.groupBy("_part").agg(F.count("*").alias("n"), value.alias("s")).collect(), key=lambda r: r._part)
    before = list(accumulate([r.n for r in sizes], initial=0))
    sums = list(accumulate([r.s or 0 for r in sizes], initial=0))
    bases = spark.createDataFrame([(r._part, before[k], float(sums[k])) for k, r in enumerate(sizes)] or [(0, 0, 0.0)], "_part int, _before long, _sum double")
    w = Window.partitionBy("_part").orderBy(*order)
    out = dealt.join(F.broadcast(bases), "_part").withColumn(name, F.row_number().over(w) + F.col("_before"))  # a row for each range
    if total and running:
        out = out.withColumn(running, F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum"))
    return out.drop("_part", "_before", "_sum")


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """(bin, low, high, n): equal bins between the least and the greatest value; one bin if they are equal."""
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    step = (high - low) / width
    at = F.least(F.floor((x - low) / step), F.lit(width - 1)).cast("int") if step > 0 else F.lit(0)
    bins = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(width if step > 0 else 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(bins, "bin", "left").select("bin", (low + F.col("bin") * step).alias("low"), (low + (F.col("bin") + 1) * step if step > 0 else F.lit(high)).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """(n, least, greatest, mean, deviation), the deviation of the population."""
    return df.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("greatest"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))


def bars(rows: DataFrame, height: int = 20) -> str:
    """A histogram as text, one line for each level. For logs."""
    counts = [r.n for r in rows.orderBy("bin").collect()]  # a row for each bin
    top = max(counts, default=0)
    return "\n".join("".join("#" if top and c * height >= top * level else " " for c in counts).rstrip() for level in range(height, 0, -1))
