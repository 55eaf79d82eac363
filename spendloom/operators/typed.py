"""The typed spend table: all sources mapped to canonical fields and cast, with a report of what failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import dates

NUMBERS = {"total_spend", "local_spend", "quantity", "unit_price"}
DATES = {"invoice_date", "po_document_date"}
EMPTY_WORDS = ["nan", "None", "NULL", "<NA>"]


def cast(c: str | Column, field: str) -> Column:
    value = F.trim(C.text(c))
    if field in NUMBERS:
        bare = F.regexp_replace(value, r"[,$€£¥\s]", "")
        return F.when(bare.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    if field in DATES:
        return dates.parse(value)
    return F.when(value.isin(*EMPTY_WORDS) | value.isNull(), F.lit("")).otherwise(value)


def build(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """mapping: column -> field. Fields without a column are absent."""
    return df.select(*(cast(c, f).alias(f) for c, f in mapping.items()))


def report(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Per field: given, cast, failed and the share that was cast; one scan, one row a task."""
    pairs = [*mapping.items()]
    good = lambda c, f: F.count(F.when(C.non_blank(c) & (cast(c, f).isNotNull()), 1))
    one = df.agg(F.array(*(F.struct(F.lit(f).alias("field"), F.count(F.when(C.non_blank(c), 1)).alias("given"), good(c, f).alias("valid")) for c, f in pairs)).alias("each"))
    return one.select(F.explode("each").alias("x")).select("x.*", (F.col("x.given") - F.col("x.valid")).alias("failed"), C.percent(F.col("x.valid"), F.col("x.given")).alias("valid_pct"))


def failures(df: DataFrame, mapping: dict[str, str], k: int = 5) -> DataFrame:
    """The k most frequent values of each field that did not cast."""
    from spendloom.operators.profile import top_values

    bad = df.select(*(F.when(C.non_blank(c) & cast(c, f).isNull(), C.text(c)).alias(f) for c, f in mapping.items()))
    return top_values(bad, [*mapping.values()], k)


def null_rows(typed: DataFrame, spend: str = "total_spend", date: str = "invoice_date") -> DataFrame:
    """Rows that analysis cannot place: without spend or without a date."""
    return typed.where(F.col(spend).isNull() | F.col(date).isNull())


def build_all(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """(typed rows of all uploads with their table, those that analysis cannot place).

    tables: name -> (table, column -> field). A field that one upload lacks is null there;
    every row keeps the name of its upload.
    """
    parts = [build(df, mapping).withColumn("_source_table", F.lit(name)) for name, (df, mapping) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    missing = {"total_spend": "double", "invoice_date": "date"}
    out = out.withColumns({c: F.lit(None).cast(k) for c, k in missing.items() if c not in out.columns})
    return out, null_rows(out)


def original_fill(tables: dict[str, tuple[DataFrame, dict[str, str]]], shown: dict[str, str] | None = None) -> DataFrame:
    """(column_name, source_column, place, fill_rate, spend_coverage) of the columns as they were uploaded.

    tables: as in build_all. A row's spend is cast beside its own cells, so nothing is joined back:
    each upload gives one row of counts, and the counts of a column that several uploads have
    add up. Shares are of the rows and the net spend of all uploads, to one decimal; coverage is null
    where there is no net spend. shown names the headers as they were written.
    """
    columns = [*dict.fromkeys(c for df, _ in tables.values() for c in df.columns if c != "RECORD_ID")]
    parts = []
    for df, mapping in tables.values():
        source = next((c for c, f in mapping.items() if f == "total_spend"), None)
        amount = F.coalesce(cast(source, "total_spend"), F.lit(0.0)) if source else F.lit(0.0)
        each = F.array(*(F.struct(F.lit(c).alias("column"), F.count(F.when(C.non_blank(c), 1)).alias("filled"), F.sum(F.when(C.non_blank(c), amount)).alias("covered")) for c in df.columns if c in columns))
        parts.append(df.agg(F.count("*").alias("rows"), F.sum(amount).alias("amount"), each.alias("each")))
    # One row an upload from here on.
    counted = reduce(lambda a, b: a.union(b), parts)
    whole = counted.agg(F.sum("rows").alias("rows"), F.sum("amount").alias("amount"))
    per = counted.select(F.explode("each").alias("x")).groupBy("x.column").agg(F.sum("x.filled").alias("filled"), F.sum("x.covered").alias("covered"))
    joined = per.join(F.broadcast(whole)).where("rows > 0")
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int") - 1
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in (shown or {"": ""}).items() for x in pair)), F.col("column")), F.col("column"))
    coverage = F.when(F.col("amount") != 0, F.round(F.coalesce("covered", F.lit(0.0)) / F.col("amount") * 100, 1))
    return joined.select(name.alias("column_name"), F.col("column").alias("source_column"), place.alias("place"), F.round(F.col("filled") / F.col("rows") * 100, 1).alias("fill_rate"), coverage.alias("spend_coverage"))
