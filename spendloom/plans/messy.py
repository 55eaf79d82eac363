"""Strings of the kind that uploads hold, derived from ids, in Spark and in the oracle's SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.plans.spend import table

_SUFFIXES = ["Acme Tools Inc.", "Globex Corporation", "Initech  Holdings, LLC", "umbrella.com", "Stark Industries Group Ltd", "Wayne Co.", "Hooli"]
_COUNTRIES = ["us", "U.S.A.", "DEU", "Germany", "gb", "Atlantis", "", "jp"]
_TERMS = ["Net 30", "N45", "60 days", "COD", "2%10 Net 30", "CIA", "whenever", "", "due on receipt", "90"]
_PLANTS = ["Plant A-001", "Site  B (old)", "Lyon_1234", "Main Works", "Depot C (x)-567"]
_NUMBERS = ["1,234.50", "$99", "(250.00)", "abc", "", "1e3", "-7", "12 000", "2024-01-15", "00042"]


def _cycle(values: list[str], step: int = 1):
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("id") / step).cast("long") % len(values) + 1).cast("int"))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: id, file, supplier, country, term, plant, amount, ccy, date_text, key_text."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    form = F.col("id") % 7
    text = (
        F.when(form == 0, F.date_format("d", "yyyy-MM-dd")).when(form == 1, F.date_format("d", "dd/MM/yyyy")).when(form == 2, F.date_format("d", "dd.MM.yyyy"))
        .when(form == 3, F.date_format("d", "yyyyMMdd")).when(form == 4, F.date_format("d", "dd-MMM-yyyy")).when(form == 5, F.datediff("d", F.lit("1899-12-30")).cast("string")).otherwise("n/a")
    )
    return o.select(
        "id", "d", F.concat(F.lit("file"), (F.col("id") % 3).cast("string")).alias("file"), _cycle(_SUFFIXES).alias("supplier"), _cycle(_COUNTRIES).alias("country"),
        _cycle(_TERMS).alias("term"), _cycle(_PLANTS).alias("plant"), _cycle(_NUMBERS).alias("amount"), _cycle(["usd", "EUR", "gbp ", "XXX", ""], 3).alias("ccy"),
        text.alias("date_text"), F.concat(F.lpad((F.col("id") % 500).cast("string"), 6, "0"), F.when(F.col("id") % 2 == 0, ".0").otherwise("")).alias("key_text"),
    )


def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of messy() and of all suppliers, with a typing error each at a place that the key tells: supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    at = (F.col("k") % 7 + 1).cast("int")
    cut = lambda a, b: F.substr("name", F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b)
    head, one, two, tail = cut(1, at - 1), cut(at, 1), cut(at + 1, 1), cut(at + 2, 1 << 20)
    wrong = F.when(F.col("k") % 3 == 0, F.concat(head, two, one, tail)).when(F.col("k") % 3 == 1, F.concat(head, two, tail)).otherwise(F.concat(head, one, one, two, tail))
    return s.select(F.explode(F.array("name", wrong)).alias("supplier")).union(messy(spark, sf_dir).select("supplier"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values: list[str], step: int = 1) -> str:
    return f"{_list(values)}[(o_orderkey // {step}) % {len(values)} + 1]"


MESSY = f"""WITH m AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS d, 'file' || (o_orderkey % 3) AS file, {_pick(_SUFFIXES)} AS supplier, {_pick(_COUNTRIES)} AS country, {_pick(_TERMS)} AS term,
    {_pick(_PLANTS)} AS plant, {_pick(_NUMBERS)} AS amount, {_pick(["usd", "EUR", "gbp ", "XXX", ""], 3)} AS ccy,
    CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y')
      WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 5 THEN date_diff('day', DATE '1899-12-30', o_orderdate::DATE)::VARCHAR ELSE 'n/a' END AS date_text,
    lpad((o_orderkey % 500)::VARCHAR, 6, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END AS key_text
  FROM orders)
"""

#: Rates for the conversion queries: currency, year, month, local units a dollar, from a rule.
RATE_SQL = """SELECT c AS currency, y::INT AS year, m::INT AS month, base + (y - 1995) * 0.01 + m * 0.001 AS rate
  FROM (VALUES ('EUR', 0.9), ('GBP', 0.75)) t(c, base), generate_series(1995, 2000) ys(y), generate_series(1, 12) ms(m)"""


def rates(spark: SparkSession) -> DataFrame:
    base = spark.createDataFrame([("EUR", 0.9), ("GBP", 0.75)], "currency string, base double")
    each = base.withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2000)))).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return each.select("currency", "year", "month", (F.col("base") + (F.col("year") - 1995) * F.lit(0.01) + F.col("month") * F.lit(0.001)).alias("rate"))
