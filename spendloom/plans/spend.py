"""The supplied tables in procurement roles, as DataFrames and as the oracle's SQL."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.functions import columns as C

#: Stand-in currencies by nation, as no table has any.
CURRENCIES = ["USD", "EUR", "GBP", "JPY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def pick(c: str, values: list[str]) -> Column:
    """The value at c modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))


def _lines() -> list[Column]:
    net = money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    return [net.alias("total_spend"), money("l_extendedprice").alias("local_spend"), F.col("l_shipdate").alias("invoice_date"), F.col("l_orderkey"), F.col("l_linenumber")]


def _sides(spark: SparkSession, sf_dir: str, dims: tuple[str, ...]) -> Iterator[tuple[str, str, DataFrame]]:
    """(key of the line items, own key, own key with named columns) of each dimension asked for."""
    if "supplier" in dims:
        places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        vendors = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        yield "l_suppkey", "s_suppkey", vendors.select("s_suppkey", F.col("s_name").alias("supplier"), F.col("n_name").alias("vendor_country"), F.col("r_name").alias("region"), pick("n_nationkey", CURRENCIES).alias("currency"))
    if "part" in dims:
        yield "l_partkey", "p_partkey", table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"), F.col("p_name").alias("l3"), F.col("p_name").alias("description"))
    if "orders" in dims:
        yield "l_orderkey", "o_orderkey", table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("term"), F.col("o_orderdate").alias("po_document_date"))


def spend(spark: SparkSession, sf_dir: str, *dims: str) -> DataFrame:
    """Line items as typed spend with the dimensions asked for: supplier, part, orders.

    Which sides are broadcast is Spark's choice by their size; nothing is hinted.
    """
    df, columns = table(spark, sf_dir, "lineitem"), _lines()
    for key, own, side in _sides(spark, sf_dir, dims):
        df = df.join(side, F.col(key) == F.col(own))
        columns += [F.col(c) for c in side.columns[1:]]
    return df.select(*columns)


def filled(spark: SparkSession, sf_dir: str, *dims: str) -> DataFrame:
    """The rows of spend(), true where a field holds a value that is not blank, else null.

    That is told before the sides meet and travels as bits of one number: joins move keys and
    bits, no prices, names and dates.
    """
    names: list[str] = []

    def bits(df: DataFrame) -> Column:
        told = [F.when(C.non_blank(c), 1 << i).otherwise(0) for i, c in enumerate(df.columns, len(names))]
        names.extend(df.columns)
        return reduce(lambda a, b: a.bitwiseOR(b), told).cast("int")

    sides, lines = [*_sides(spark, sf_dir, dims)], _lines()
    keys = {key: F.col(key).alias(f"_{key}") for key, _, _ in sides}
    df = table(spark, sf_dir, "lineitem").select(*keys.values(), *lines)
    df = df.select(*(f"_{k}" for k in keys), bits(df.select(*df.columns[len(keys) :])).alias("_bits"))
    for key, own, side in sides:
        told = side.select(own, bits(side.drop(own)).alias("_more"))
        keys.pop(key)
        df = df.join(told, F.col(f"_{key}") == F.col(own)).select(*(f"_{k}" for k in keys), F.col("_bits").bitwiseOR(F.col("_more")).alias("_bits"))
    return df.select(*(F.when(F.col("_bits").bitwiseAND(1 << i) != 0, True).alias(c) for i, c in enumerate(names)))


#: The same as a common table expression `b`, with all dimensions.
BASE = """WITH b AS (
  SELECT l_extendedprice::DECIMAL(18,2) * (1::DECIMAL(4,2) - l_discount::DECIMAL(4,2)) AS total_spend, l_extendedprice::DECIMAL(18,2) AS local_spend,
    l_shipdate AS invoice_date, l_orderkey, l_linenumber, s_name AS supplier, n_name AS vendor_country, r_name AS region,
    ['USD', 'EUR', 'GBP', 'JPY'][n_nationkey % 4 + 1] AS currency, p_type AS l1, p_brand AS l2, p_name AS l3, p_name AS description,
    o_orderpriority AS term, o_orderdate AS po_document_date
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"coalesce(round(({part})::DOUBLE / nullif(({whole})::DOUBLE, 0) * 100, {digits}), 0)"


def dbl(x: str) -> str:
    return f"round(coalesce({x}, 0)::DOUBLE, 2)"
