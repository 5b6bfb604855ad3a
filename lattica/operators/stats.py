"""Statistics, histograms and ordered scans that need no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def population_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, population variance and deviation, min, max and range."""
    v = F.col(value).cast("double")
    out = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.withColumn("range", F.col("max") - F.col("min"))


def count_flagged(rows: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """Rows that have the flag, and all rows, of each group."""
    return rows.groupBy(*by).agg(F.count_if(flag).alias("flagged"), F.count(F.lit(1)).alias("n"))


def packed_size(faces: DataFrame, label: str, dim: int) -> DataFrame:
    """size: numbers that packed geometries take; an offset and a head of two for each label, ``dim`` for each face."""
    return faces.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.coalesce(F.sum(F.lit(2) + dim * F.col("n")), F.lit(0)) + F.count(F.lit(1))).cast("long").alias("size"))


def level_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("level").agg(F.count(F.lit(1)).alias("n_cells"))


def prefix_sum(rows: DataFrame, value: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Exclusive running total in the order (bucket, *order).

    Buckets are ranked in their own tasks and only their sums are carried over, so no task
    sees all rows; ``bucket`` has to be monotone in the wanted order.
    """
    dealt = rows.withColumn("_b", bucket)
    sums = dealt.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(sums), "_b").withColumn(name, F.col("_base") + F.col("_in")).drop("_b", "_base", "_in")


def next_in_order(rows: DataFrame, value: str, bucket: Column, name: str) -> DataFrame:
    """Adds the next larger value of a distinct column, bucket by bucket; ``bucket`` is monotone in the value."""
    dealt = rows.withColumn("_b", bucket)
    firsts = dealt.groupBy("_b").agg(F.min(value).alias("_first"))
    after = firsts.select("_b", F.lead("_first").over(Window.orderBy("_b")).alias("_next"))  # a row per bucket
    inside = Window.partitionBy("_b").orderBy(value)
    return dealt.withColumn("_in", F.lead(value).over(inside)).join(F.broadcast(after), "_b").withColumn(name, F.coalesce("_in", "_next")).drop("_b", "_in", "_next")
