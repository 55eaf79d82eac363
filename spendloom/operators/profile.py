"""Column profiles: fill, distinct values, numbers, lengths, top values, overlaps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.operators.running import running


def cells(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value) of every cell, in one scan."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(C.text(c)).alias("value")) for c in columns))).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value, n): what every profile below is computed from; combined before its shuffle."""
    return cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows, filled cells, fill % and exact distinct values of each column."""
    filled = F.sum(F.when(C.non_blank("value"), F.col("n")).otherwise(0))
    per = value_counts(df, columns).groupBy("column").agg(F.sum("n").alias("total"), filled.alias("filled"), F.count(F.when(C.non_blank("value"), 1)).alias("distinct_values"))
    return per.select("column", F.col("total").cast("long").alias("total_rows"), F.col("filled").cast("long").alias("filled"), C.percent(F.col("filled"), F.col("total")).alias("fill_pct"), "distinct_values")


def fill_rates(df: DataFrame, columns: Iterable[str], spend: Column | None = None) -> DataFrame:
    """Share of cells with a real value, and the share of spend on their rows; one scan, one row a task."""
    columns, amount = [*columns], spend if spend is not None else F.lit(0).cast("decimal(18,2)")
    wide = df.select(amount.alias("_amount"), *(C.effective(c).alias(f"_{i}") for i, c in enumerate(columns)))
    one = wide.agg(
        F.count("*").alias("rows"), F.sum("_amount").alias("amount"),
        F.array(*(F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(f"_{i}"), 1)).alias("filled"), F.sum(F.when(F.col(f"_{i}"), F.col("_amount"))).alias("covered")) for i, c in enumerate(columns))).alias("each"),
    )
    each = one.select("rows", "amount", F.explode("each").alias("x"))
    return each.select("x.column", "x.filled", C.percent(F.col("x.filled"), F.col("rows")).alias("fill_pct"), C.percent(F.coalesce("x.covered", F.lit(0)), F.col("amount")).alias("spend_pct"))


def deep_stats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Nulls, fill, distinct, lengths, numbers and case of each column."""
    n, value = F.col("n"), F.col("value")
    amount = C.number("value")
    on = lambda cond: F.sum(F.when(cond, n).otherwise(0)).cast("long")
    full = C.non_blank("value")
    per = value_counts(df, columns).groupBy("column").agg(
        F.sum("n").cast("long").alias("total_rows"), on(~full).alias("blank"), F.count(F.when(full, 1)).alias("distinct_values"),
        on(full & amount.isNotNull()).alias("numeric"), F.min(F.when(full, F.length("value"))).alias("min_len"), F.max(F.when(full, F.length("value"))).alias("max_len"),
        F.sum(F.when(full, F.length("value") * n)).alias("_chars"), on(full & value.rlike("[0-9]")).alias("with_digit"), on(full & value.rlike("[^A-Za-z0-9 ]")).alias("with_special"),
        F.min(amount).alias("min_number"), F.max(amount).alias("max_number"), F.sum(amount * n).alias("_sum"), F.sum(amount * amount * n).alias("_squares"),
        F.coalesce(F.bool_and(F.when(full, value == F.upper("value"))), F.lit(False)).alias("all_upper"), F.coalesce(F.bool_and(F.when(full, value == F.lower("value"))), F.lit(False)).alias("all_lower"),
    )
    filled = F.col("total_rows") - F.col("blank")
    mean = F.try_divide("_sum", "numeric")
    deviation = F.when(F.col("numeric") > 0, F.sqrt(F.greatest(F.try_divide("_squares", "numeric") - mean * mean, F.lit(0.0))))
    return per.withColumns({
        "mean": F.round(mean, 4), "stddev": F.round(deviation, 4),
        "fill_pct": C.percent(filled, F.col("total_rows")), "unique_pct": C.percent(F.col("distinct_values"), filled),
        "numeric_pct": C.percent(F.col("numeric"), F.greatest(filled, F.lit(1))), "avg_len": F.round(F.col("_chars") / F.greatest(filled, F.lit(1)), 2),
    }).drop("_chars", "_sum", "_squares")


def top_values(df: DataFrame, columns: Iterable[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column, ties by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df, columns).where(C.non_blank("value")).withColumn("rank", rank).where(F.col("rank") <= k).select("column", "value", F.col("n").alias("count"), "rank")


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The element at n // 2 of the sorted numbers (not interpolated); found on counts of equal values."""
    counts = df.select(F.col(column).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    # From the largest: element n // 2 from below is element n - n // 2 from above.
    ranked = running(counts.select("n", "x", F.col("x").alias("key")), "key", "key")
    sums = ranked.groupBy((F.col("rank") / 100_000).cast("long").alias("block")).agg(F.sum("n").alias("size"))
    before = sums.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    own = F.sum("n").over(Window.partitionBy("block").orderBy("rank"))
    placed = ranked.withColumn("block", (F.col("rank") / 100_000).cast("long")).withColumn("upto", own).join(F.broadcast(before), "block")
    wanted = F.expr("all - all div 2")
    return placed.where((F.col("upto") + F.col("before") >= wanted) & (F.col("upto") + F.col("before") - F.col("n") < wanted)).select(F.col("x").alias("median_value"), F.col("all").cast("long").alias("n"))


def null_proxies(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    per = value_counts(df, columns).groupBy("column").agg(F.sum("n").alias("total"), F.sum(F.when(C.null_proxy("value"), F.col("n")).otherwise(0)).alias("proxies"), F.sum(F.when(~C.non_blank("value"), F.col("n")).otherwise(0)).alias("blank"))
    return per.select("column", F.col("total").cast("long").alias("total_rows"), F.col("proxies").cast("long").alias("proxies"), F.col("blank").cast("long").alias("blank"), C.percent(F.col("proxies"), F.col("total")).alias("proxy_pct"))


def duplicate_estimate(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    per = df.groupBy(*[*columns][:5]).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("long").alias("total_rows"), (F.sum("n") - F.count("*")).cast("long").alias("duplicates"))


def overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Distinct normalised values: of each side, shared, and the three ratios in use."""
    side = lambda df, c, mark: df.select(C.match_key(c).alias("key")).where(C.non_blank("key")).distinct().withColumn("side", F.lit(mark))
    both = side(left, left_column, 1).union(side(right, right_column, 2)).groupBy("key").agg(F.sum("side").alias("s"))
    n = both.agg(F.count(F.when(F.col("s").isin(1, 3), 1)).alias("left_distinct"), F.count(F.when(F.col("s") >= 2, 1)).alias("right_distinct"), F.count(F.when(F.col("s") == 3, 1)).alias("shared"))
    a, b, s = F.col("left_distinct"), F.col("right_distinct"), F.col("shared")
    return n.select("*", C.percent(s, a).alias("of_left_pct"), C.percent(s, F.least(a, b)).alias("of_smaller_pct"))


def slice_by(df: DataFrame, dimension: str, measure: Column | None, how: str, k: int = 15) -> DataFrame:
    """sum, avg, count or distinct of a measure by a dimension, the k largest."""
    f = {"sum": F.sum, "avg": F.avg, "distinct": F.countDistinct}.get(how)
    value = F.count("*") if f is None else f(measure)
    out = df.groupBy(F.col(dimension).alias("dimension")).agg(F.round(value.cast("double"), 2).alias("value"))
    return out.orderBy(F.desc("value"), "dimension").limit(k)
