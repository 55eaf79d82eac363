"""Assessments of columns and tables before they are normalised or merged: one scan each."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.operators import profile

#: A column filled in fewer percent of the rows than this is warned of.
LEAST_POPULATED = 60


def populated(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value per column, their share to one decimal, and a warning where it is low."""
    columns = [*columns]
    filled = df.agg(F.count("*").alias("total"), *(F.count(F.when(C.non_blank(c), 1)).alias(f"c{i}") for i, c in enumerate(columns)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("populated")) for i, c in enumerate(columns))))
    rows = filled.select(each.alias("x"), "total").select("x.column", "x.populated", "total")
    share = F.coalesce(F.try_divide(F.col("populated") * 100.0, F.col("total")), F.lit(0.0))
    return rows.select("column", "populated", "total", F.round(share, 1).alias("pct_populated"), (share < LEAST_POPULATED).alias("warn"))


def analysis_scores(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Quality, consistency and usability of each column, from 0 to 100, and what they rest on.

    Values are counted before they move, so one scan and one shuffle of distinct values give
    all columns' fill, distinct values and share of numbers. `patterns` and `analyses` list what the
    column shows and allows; `overall` is the mean fill of all the columns.
    """
    columns = [*(columns if columns is not None else df.columns)]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), C.match_key(C.column(c)).alias("v"), C.non_blank(C.column(c)).alias("given"), C.looks_numeric(C.column(c)).alias("numeric")) for c in columns))
    each = df.select(F.explode(cells).alias("x")).select("x.column", F.when(F.col("x.given"), F.col("x.v")).alias("v"), "x.numeric")
    counted = each.groupBy("column", "v", "numeric").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    given = F.col("v").isNotNull()
    per = counted.groupBy("column").agg(F.sum("n").alias("rows"), total(given).alias("non_null"), F.count_distinct("v").alias("distinct_values"), total(given & F.col("numeric")).alias("_numbers"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    per = per.withColumns({"_fill": ratio("non_null", "rows"), "_unique": ratio("distinct_values", "non_null"), "_num": ratio("_numbers", "non_null")})
    score = lambda x: F.bround(x).cast("int")
    balance = F.lit(1.0) - F.abs(F.lit(0.5) - F.col("_num"))
    per = per.withColumns({"quality": score((0.7 * F.col("_fill") + 0.3 * F.least(F.col("_unique"), F.lit(1.0))) * 100), "consistency": score((0.6 * F.col("_fill") + 0.4 * balance) * 100)})
    kind = F.when(F.col("_num") >= 0.8, "mostly_numeric").when(F.col("_num") <= 0.2, "mostly_text").otherwise("mixed_numeric_text")
    per = per.withColumns({
        "usability": score(0.55 * F.col("quality") + 0.45 * F.col("consistency")), "inferred_type": F.when(F.col("_num") >= 0.8, "numeric").otherwise("text"),
        "patterns": F.concat(kind, F.when(F.col("_fill") >= 0.95, ",high_fill").otherwise("")), "analyses": F.concat(F.lit("filter,group"), F.when(F.col("_num") >= 0.8, ",sum,avg").otherwise("")),
    })
    # One row a column from here on.
    overall = F.bround(F.avg("_fill").over(Window.partitionBy()) * 100).cast("int")
    return per.select("column", "rows", "non_null", "distinct_values", F.round("_fill", 4).alias("fill"), F.round("_num", 4).alias("numeric_ratio"), "quality", "consistency", "usability", "inferred_type", "patterns", "analyses", overall.alias("overall"))


def spend_metrics(df: DataFrame, column: str) -> DataFrame:
    """Total of the numeric cells, and how many cells with a value are numeric or not."""
    is_number = C.number(column).isNotNull()
    count = lambda c: F.count(F.when(C.non_blank(column) & c, 1))
    return df.agg(F.count("*").alias("rows"), F.round(F.sum(C.spend(column)), 0).alias("total_spend"), count(is_number).alias("numeric"), count(~is_number).alias("non_numeric"))


def currency_quality(df: DataFrame, currency: str, local: str, reporting: str, k: int = 20, rest: str = "Others") -> DataFrame:
    """Rows, share of all rows and both spends of the k codes with most reporting spend; all others together.

    Codes are compared trimmed and in upper case; rows without one count only in the whole.
    """
    code = F.when(C.non_blank(currency), F.upper(F.trim(currency)))
    per = df.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.sum(local).alias("local"), F.sum(reporting).alias("reporting"))
    total = per.agg(F.sum("n").alias("all"))
    known = per.where("code is not null")
    top = known.orderBy(F.desc_nulls_last("reporting"), F.desc("n"), "code").limit(k).select("code", F.lit(True).alias("top"))
    named = known.join(F.broadcast(top), "code", "left").groupBy(F.when(F.col("top"), F.col("code")).otherwise(F.lit(rest)).alias("code"))
    summed = named.agg(*(F.sum(c).alias(c) for c in ("n", "local", "reporting"))).join(F.broadcast(total))
    whole = lambda c: F.round(F.col(c).cast("double"), 0)
    return summed.select("code", F.col("n").alias("rows"), C.percent(F.col("n"), F.col("all")).alias("rows_pct"), whole("local").alias("local_spend"), whole("reporting").alias("reporting_spend"))


def alphanumeric_spend(df: DataFrame, description: str, spend: str, currency: str) -> DataFrame:
    """Spend of rows whose description has a letter or digit, by currency."""
    hit = df.where(C.non_blank(description) & F.col(description).rlike("[A-Za-z0-9]"))
    return hit.groupBy(F.upper(F.trim(currency)).alias("currency")).agg(F.count("*").alias("rows"), F.round(F.sum(spend).cast("double"), 2).alias("total_spend"))


def time_metrics(df: DataFrame, date: str, spend: str) -> DataFrame:
    """Total, first and last year, mean month, and the months (yyyymm) of most and least spend; ties to the earlier."""
    month = F.year(date) * 100 + F.month(date)
    per = df.where(F.col(date).isNotNull()).groupBy(month.alias("month")).agg(F.sum(spend).alias("spend"))
    amount = lambda c: F.round(c.cast("double"), 2)
    return per.agg(
        amount(F.sum("spend")).alias("total_spend"), (F.min("month") / 100).cast("int").alias("first_year"), (F.max("month") / 100).cast("int").alias("last_year"),
        F.round(F.sum("spend").cast("double") / F.count("*"), 2).alias("avg_month"),
        F.max_by("month", F.struct(F.col("spend"), -F.col("month"))).alias("highest_month"), amount(F.max("spend")).alias("highest_spend"),
        F.min_by("month", F.struct("spend", "month")).alias("lowest_month"), amount(F.min("spend")).alias("lowest_spend"),
    )


def schema_consistency(schemas: list[list[str]]) -> float:
    """Mean Jaccard similarity of the tables' headers, pair by pair; 1 for fewer than two tables."""
    sets = [{c.strip().lower() for c in s} for s in schemas]
    found = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in combinations(sets, 2)]
    return sum(found) / len(found) if found else 1.0


def table_overlap(tables: dict[str, DataFrame]) -> DataFrame:
    """Per pair of tables that share headers: shared headers by the smaller number of columns, and the mean
    over shared headers of shared values by the smaller number of distinct values.

    Each table's distinct values shuffle once, whatever the number of pairs; headers are compared
    trimmed and in lower case, values as match keys.
    """
    names = {t: {c.strip().lower(): c for c in df.columns} for t, df in tables.items()}
    pairs = [(a, b, sorted(names[a].keys() & names[b].keys())) for a, b in combinations(tables, 2)]
    pairs = [(a, b, shared) for a, b, shared in pairs if shared]
    spark = next(iter(tables.values())).sparkSession
    headers = spark.createDataFrame([(a, b, len(s), min(len(names[a]), len(names[b]))) for a, b, s in pairs], "a string, b string, shared_headers int, fewest int")
    sides: DataFrame | None = None
    for t, df in tables.items():
        wanted = sorted({h for a, b, s in pairs if t in (a, b) for h in s})
        if wanted:
            renamed = df.select(*(C.match_key(F.col(f"`{names[t][h]}`")).alias(h) for h in wanted))
            values = profile.value_counts(renamed, wanted).where(C.non_blank("value")).select(F.lit(t).alias("t"), "column", "value")
            sides = values if sides is None else sides.union(values)
    if sides is None:
        return headers.select("a", "b", "shared_headers", F.lit(0.0).alias("header_overlap"), F.lit(None).cast("double").alias("value_overlap"))
    distinct = sides.groupBy("t", "column").agg(F.count("*").alias("n"))
    # The sets hold table names, at most as many as there are tables.
    holders = sides.groupBy("column", "value").agg(F.collect_set("t").alias("ts"))
    both = holders.groupBy("column", "ts").agg(F.count("*").alias("n"))
    order = spark.createDataFrame([(a, b, h) for a, b, s in pairs for h in s], "a string, b string, column string")
    met = order.join(both, "column").where(F.array_contains("ts", F.col("a")) & F.array_contains("ts", F.col("b"))).groupBy("a", "b", "column").agg(F.sum("n").alias("shared"))
    size = lambda x: distinct.select(F.col("t").alias(x), "column", F.col("n").alias(f"n{x}"))
    per = order.join(size("a"), ["a", "column"]).join(size("b"), ["b", "column"]).join(met, ["a", "b", "column"], "left")
    mean = per.groupBy("a", "b").agg(F.round(F.avg(F.coalesce("shared", F.lit(0)) / F.least("na", "nb")), 4).alias("value_overlap"))
    return headers.join(mean, ["a", "b"], "left").select("a", "b", "shared_headers", F.round(F.col("shared_headers") / F.col("fewest"), 4).alias("header_overlap"), "value_overlap")
