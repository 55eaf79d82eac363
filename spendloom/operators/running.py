"""Ranks and running totals over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendloom.operators.shipping import settled

#: Ranges that the values are dealt into; each one is sorted by itself.
RANGES = 64


def running(df: DataFrame, value: str, tie: str, partitions: int = RANGES) -> DataFrame:
    """df with `rank` (1 for the largest value), `cumulative` and `total`.

    The bounds of the ranges are approximate quantiles, `partitions` numbers; every range is
    ranked alone and shifted by the sums of the ranges before it, which are as few rows. What df
    is made from is read once. Many rows of one equal value share a range.
    """
    df = settled(df)
    shares = [i / partitions for i in range(1, partitions)]
    bounds = df.agg(F.percentile_approx(value, shares, 10_000).alias("b")).first()["b"] or []
    place = F.lit(0)
    for b in sorted({*bounds}):
        place = place + (F.col(value) < F.lit(b)).cast("int")
    dealt = df.withColumn("_range", place)
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_so_far"), F.sum("_sum").over(whole).alias("total"))
    own = Window.partitionBy("_range").orderBy(F.desc(value), tie)
    ranked = dealt.withColumns({"rank": F.row_number().over(own), "cumulative": F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(sums), "_range")
    return ranked.withColumns({"rank": (F.col("rank") + F.col("_before")).cast("long"), "cumulative": F.col("cumulative") + F.col("_so_far")}).drop("_range", "_before", "_so_far")


def leading(df: DataFrame, value: str, tie: str, percent: float) -> DataFrame:
    """The shortest prefix, largest first, whose running total reaches percent of the total."""
    ranked = running(df, value, tie)
    reached = ranked.where(F.col("cumulative").cast("double") >= F.col("total").cast("double") * (percent / 100)).agg(F.min("rank").alias("_cut"))
    return ranked.join(F.broadcast(reached), F.col("rank") <= F.coalesce("_cut", F.lit(2**62)), "inner").drop("_cut")
