"""Normalisers: dates by voted order, suppliers, countries, regions, plants, terms, currencies."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import constants as K
from spendloom.functions import dates
from spendloom.operators import clean, headers, nearnames
from spendloom.operators.shipping import settled


def _texts_by_file(df: DataFrame, column: str, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("file"), C.text(column).alias("v")).agg(F.count("*").alias("n"))


def _vote(per: DataFrame) -> DataFrame:
    d, m = dates.votes("v")
    out = per.groupBy("file").agg(F.coalesce(F.sum(d * F.col("n")), F.lit(0)).cast("long").alias("dmy"), F.coalesce(F.sum(m * F.col("n")), F.lit(0)).cast("long").alias("mdy"))
    return out.withColumn("date_order", dates.order_of(F.col("dmy"), F.col("mdy")))


def dmy_votes(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per file: votes for day first and month first, and the order; distinct texts vote by their count."""
    return _vote(_texts_by_file(df, column, by))


def dates_by_file(df: DataFrame, column: str, by: str, new: str, reference_year: int = 2024) -> DataFrame:
    """df with the parsed date, in the order its file voted for; null files have none.

    Each distinct text of a file is parsed once and joined back, as dates repeat; what is no date is not joined.
    """
    per = settled(_texts_by_file(df, column, by))
    known = per.join(_vote(per).select("file", "date_order"), "file").select(F.col("file").alias("_file"), F.col("v").alias("_text"), dates.parse("v", F.col("date_order"), reference_year).alias("_date"))
    joined = df.join(known.where("_date is not null"), (F.col(by) == F.col("_file")) & (C.text(column) == F.col("_text")), "left")
    return joined.withColumn(new, F.col("_date")).drop("_file", "_text", "_date")


def rewritten_dates(df: DataFrame, column: str, pattern: str, order: str = "DMY", new: str | None = None) -> DataFrame:
    """df with the column's dates written in one pattern, behind it; what is no date becomes an empty text."""
    value = F.coalesce(F.date_format(dates.parse(column, order), pattern), F.lit(""))
    return clean.place_after(df, column, new or f"{column}_norm", value)


def format_mix(df: DataFrame, column: str, by: str) -> DataFrame:
    per = df.where(C.non_blank(column)).groupBy(F.col(by).alias("file"), dates.format_name(column).alias("format")).agg(F.count("*").alias("rows"))
    return per


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, r) for r, cs in K.REGIONS.items() for c in cs], "country string, region string")


@lru_cache(1)
def iso_codes() -> dict[str, str]:
    """Two- and three-letter codes and names of all countries of the standard, from the platform's own list."""
    locale = SparkSession.active().sparkContext._jvm.java.util.Locale
    found = {}
    for code in locale.getISOCountries():
        country = locale("", code)
        name = K.COUNTRY_NAMES.get(code, country.getDisplayCountry(locale.ENGLISH))
        found |= {code: name, country.getISO3Country(): name}
    return found | K.COUNTRY_CODES | K.COUNTRY_ALIASES


def country_table(spark: SparkSession, codes: dict[str, str] | None = None) -> DataFrame:
    """(spelling, country): codes, and every country's own name in upper case."""
    codes = codes or iso_codes()
    names = {c for cs in K.REGIONS.values() for c in cs} | {*codes.values()}
    rows = {k.upper().replace(".", ""): v for k, v in codes.items()} | {n.upper(): n for n in names}
    return spark.createDataFrame(sorted(rows.items()), "spelling string, country string")


def countries(df: DataFrame, column: str, codes: dict[str, str] | None = None, into: str = "country") -> DataFrame:
    """df with country and normalized_via; the program's own dimension is a constant, so it is broadcast.

    A column of df named as the result is replaced by it.
    """
    table = country_table(df.sparkSession, codes).select(F.col("spelling").alias("_key"), F.col("country").alias("_found"))
    table = table if codes else F.broadcast(table)
    joined = df.withColumn("_spelling", F.replace(F.upper(F.trim(C.text(column))), F.lit("."), F.lit(""))).join(table, F.col("_spelling") == F.col("_key"), "left")
    via = F.when(F.col("_found").isNotNull(), F.lit("ISO Lookup")).otherwise(F.lit(""))
    return joined.withColumns({into: F.col("_found"), "normalized_via": via}).drop("_spelling", "_key", "_found")


def regions(df: DataFrame, country: str, region: str | None = None) -> DataFrame:
    """df with region_norm: a known region's code, else that of the country."""
    joined = df.join(F.broadcast(region_table(df.sparkSession).select(F.col("country").alias("_c"), F.col("region").alias("_r"))), F.trim(C.text(country)) == F.col("_c"), "left")
    given = F.upper(F.trim(C.text(region))) if region else F.lit(None).cast("string")
    own = F.when(given.isin(*K.REGIONS), given)
    return joined.withColumn("region_norm", F.coalesce(own, "_r")).drop("_c", "_r")


#: Texts of a missing region or country, besides blanks.
MISSING = ("nan", "none")


def inferred_regions(df: DataFrame, region: str, country: str) -> DataFrame:
    """df with region_norm and region_via, for tables whose regions are written freely or not at all.

    A blank region takes that of its row's country. One that names a region or a country is
    looked up. Any other takes the region that most of the rows with that text have by
    their country, of equally many the first by name; what no country explains stays as it is.
    The counts are made per text and region, so a hot text moves as one row a task.
    """
    found = countries(df, country, into="_country_std")
    found = countries(found, region, into="_region_std")
    table = region_table(df.sparkSession)
    of = lambda c, mark: F.broadcast(table.select(F.col("country").alias(f"_c{mark}"), F.col("region").alias(mark)))
    own = lambda std, raw: F.coalesce(F.col(std), F.trim(C.text(raw)))
    found = found.join(of("c", "_of_country"), own("_country_std", country) == F.col("_c_of_country"), "left").join(of("r", "_of_region"), own("_region_std", region) == F.col("_c_of_region"), "left")
    text = C.text(region)
    blank = ~C.non_blank(region) | F.lower(F.trim(text)).isin(*MISSING)
    told = F.when(F.upper(F.trim(text)).isin(*K.REGIONS), F.upper(F.trim(text)))
    found = found.withColumns({"_text": F.when(~blank, text), "_told": F.coalesce(told, F.when(~blank, F.col("_of_region")))})
    counts = found.where("_text IS NOT NULL AND _told IS NULL AND _of_country IS NOT NULL").groupBy(F.col("_text").alias("_key"), "_of_country").agg(F.count("*").alias("_n"))
    commonest = counts.groupBy("_key").agg(F.min_by("_of_country", F.struct(-F.col("_n"), F.col("_of_country"))).alias("_inferred"))
    out = found.join(commonest, F.col("_text") == F.col("_key"), "left")
    value = F.when(F.col("_text").isNull(), F.col("_of_country")).otherwise(F.coalesce("_told", "_inferred", "_text"))
    via = F.when(F.col("_text").isNull(), F.when(F.col("_of_country").isNotNull(), "country")).when(F.col("_told").isNotNull(), "lookup").when(F.col("_inferred").isNotNull(), "inferred")
    return out.select(*(C.column(c) for c in df.columns if c not in ("region_norm", "region_via")), value.alias("region_norm"), F.coalesce(via, F.lit("unresolved")).alias("region_via"))


def date_metrics(df: DataFrame, column: str, by: str) -> DataFrame:
    """Per file and format of a date column: rows, rounded percent, an example; per file the commonest format and whether it is the only one.

    All rows count, by mergeable counts of distinct texts. The order of day and month is voted by
    the whole column; min_year and max_year are those of the whole column. Rows without a file are not
    listed. Of equally common formats the first by name is dominant.
    """
    texts = df.where(C.non_blank(column)).groupBy(F.trim(C.text(by)).alias("file"), F.trim(C.text(column)).alias("v")).agg(F.count("*").alias("n"))
    d, m = dates.votes("v")
    year = F.nullif(F.regexp_extract("v", r"((?:19|20)\d\d)", 1), F.lit("")).cast("int")
    whole = texts.agg(F.sum(d * F.col("n")).alias("dmy"), F.sum(m * F.col("n")).alias("mdy"), F.min(year).alias("min_year"), F.max(year).alias("max_year"))
    whole = whole.select(dates.order_of(F.col("dmy"), F.col("mdy")).alias("date_order"), "min_year", "max_year")
    # One row, joined to all.
    named = texts.where("file <> ''").join(F.broadcast(whole))
    form = F.when(F.col("date_order") == "MDY", dates.format_name("v", "MDY")).otherwise(dates.format_name("v", "DMY"))
    per = named.groupBy("file", form.alias("format"), "date_order", "min_year", "max_year").agg(F.sum("n").alias("rows"), F.min("v").alias("example"))
    of_file = Window.partitionBy("file")
    per = per.withColumns({"_total": F.sum("rows").over(of_file), "_formats": F.count("*").over(of_file), "_place": F.row_number().over(of_file.orderBy(F.desc("rows"), "format"))})
    pct = F.bround(F.col("rows") * 100.0 / F.col("_total")).cast("int")
    return per.select("file", "format", "rows", pct.alias("pct"), "example", (F.col("_place") == 1).alias("dominant"), (F.col("_formats") == 1).alias("consistent"), "date_order", "min_year", "max_year")


def supplier_clusters(df: DataFrame, column: str, threshold: float = 0.9) -> DataFrame:
    """(supplier, cleaned, canonical): distinct names, cleaned ones under the first near one.

    Cleaned names are taken in the order of their lower case; each joins the first canonical
    name whose ratio is over the threshold, wherever they differ, or becomes canonical itself.
    """
    named = df.where(C.non_blank(column)).select(F.trim(C.text(column)).alias("supplier")).distinct().withColumn("cleaned", C.supplier_name("supplier"))
    # as long as each other: neither is broadcast
    return named.join(nearnames.canonical(named, "cleaned", threshold).hint("merge"), "cleaned").select("supplier", "cleaned", "canonical")


def suppliers(df: DataFrame, column: str, threshold: float = 0.9, new: str | None = None) -> DataFrame:
    """df with the standard name of each row's supplier behind its column.

    Names are cleaned and clustered as distinct values and joined back; what has no name keeps its
    text. A hot supplier is one row of the map, which Spark broadcasts where it is small.
    """
    known = supplier_clusters(df, column, threshold).select(F.col("supplier").alias("_name"), F.col("canonical").alias("_standard"))
    joined = df.withColumn("_trimmed", F.trim(C.text(column))).join(known, F.col("_trimmed") == F.col("_name"), "left")
    return clean.place_after(joined, column, new or f"{column}_norm", F.coalesce("_standard", C.text(column))).drop("_trimmed", "_name", "_standard")


def all_dates(df: DataFrame, by: str, reference_year: int = 2024) -> DataFrame:
    """df with every date column, told by its name, parsed into a column behind it.

    Each column is read in the order of day and month that its file votes for. The columns are found by
    `headers.date_columns`; a table without one is returned as it is.
    """
    for column in headers.date_columns([c for c in df.columns if c != by]):
        parsed = dates_by_file(df, column, by, "_parsed", reference_year)
        df = clean.place_after(parsed, column, f"{column}_norm", F.col("_parsed")).drop("_parsed")
    return df


def payment_terms(df: DataFrame, column: str) -> DataFrame:
    term = C.payment_term(column)
    return df.withColumns({"term_days": term["days"], "term_discount": term["discount"], "term_doubt": ~term["known"] & C.non_blank(column)})


def amount(c: str | Column) -> Column:
    """Spend text with currency signs, separators and accounting parentheses."""
    value = F.regexp_replace(F.trim(C.text(c)), r"[,$€£]", "")
    value = F.regexp_replace(value, r"^\((.+)\)$", "-$1")
    return F.when(value.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def override_rates(rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """rates with a caller's own ones in place, and whether a currency may fall back to its latest rate.

    overrides: currency, year, month, rate. With year and month a rate holds for that month, with
    a year alone for its twelve months; such a currency never falls back. Without a year it
    holds for all months there are, and as the latest rate. Repeated overrides are averaged.
    """
    code = F.upper(F.trim("currency"))
    own = overrides.select(code.alias("currency"), "year", "month", "rate").where("rate is not null")
    flat = own.where("year is null").groupBy("currency").agg(F.avg("rate").alias("_flat"))
    months = F.when(F.col("month").isNull(), F.sequence(F.lit(1), F.lit(12))).otherwise(F.array(F.col("month").cast("int")))
    given = own.where("year is not null").withColumn("month", F.explode(months)).groupBy("currency", F.col("year").cast("int").alias("year"), "month").agg(F.avg("rate").alias("_own"))
    merged = _distinct_rates(rates).join(given, ["currency", "year", "month"], "full").withColumn("rate", F.coalesce("_own", "rate"))
    known = merged.select("currency").distinct()
    alone = flat.join(known, "currency", "left_anti").select("currency", F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"), F.col("_flat").alias("rate"))
    all_ = merged.join(flat, "currency", "left").select("currency", "year", "month", F.coalesce("_flat", "rate").alias("rate")).union(alone)
    strict = given.select("currency").distinct().withColumn("_strict", F.lit(True))
    return all_.join(strict, "currency", "left").withColumn("fallback", F.col("_strict").isNull()).drop("_strict")


def _distinct_rates(rates: DataFrame) -> DataFrame:
    """One rate a currency and month: a repeated one would double the rows that it is joined with."""
    more = [F.min("fallback").alias("fallback")] if "fallback" in rates.columns else []
    return rates.groupBy("currency", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).agg(F.avg("rate").alias("rate"), *more)


def convert(df: DataFrame, spend: str, currency: str, date: str | None, rates: DataFrame, mode: str = "monthly", year: int | None = None, target: str = "USD") -> DataFrame:
    """df with fx_rate, converted and status.

    rates: (currency, year, month, rate), local units a US dollar; it has currencies x months
    rows and is joined by Spark's own choice of side. Modes: monthly, with the latest rate as
    fallback; scope_year, the mean of one year; latest. Rates into another target are bridged
    over the dollar. Repeated rates of one month are averaged; a column `fallback` of rates
    (override_rates) tells which currencies may fall back. All columns of df are kept.
    """
    columns, rates = df.columns, _distinct_rates(rates)
    falling = rates.where("fallback") if "fallback" in rates.columns and mode == "monthly" else rates
    latest = falling.groupBy("currency").agg(F.max_by("rate", F.coalesce(F.col("year") * 12 + F.col("month"), F.lit(0))).alias("_latest"))
    yearly = rates.where(F.col("year") == (year or 0)).groupBy("currency").agg(F.avg("rate").alias("_mean"))
    df = df.withColumn("__in", F.struct("*")).withColumns({"_ccy": F.when(C.non_blank(currency), F.upper(F.trim(C.text(currency)))), "_amount": amount(spend)})
    when = F.col(date) if date else F.lit(None).cast("date")
    df = df.withColumns({"_y": F.year(when), "_m": F.month(when)})

    def rate_of(df: DataFrame, code: Column, mark: str) -> DataFrame:
        exact, back = F.lit(None).cast("double"), F.lit(None).cast("double")
        if mode == "monthly":
            monthly = rates.select(F.col("currency").alias(f"_mc{mark}"), F.col("year").alias(f"_my{mark}"), F.col("month").alias(f"_mm{mark}"), F.col("rate").alias(f"_mr{mark}"))
            df = df.join(monthly, (code == F.col(f"_mc{mark}")) & (F.col("_y") == F.col(f"_my{mark}")) & (F.col("_m") == F.col(f"_mm{mark}")), "left")
            exact = F.col(f"_mr{mark}")
        if mode == "scope_year":
            df = df.join(yearly.select(F.col("currency").alias(f"_yc{mark}"), F.col("_mean").alias(f"_yr{mark}")), code == F.col(f"_yc{mark}"), "left")
            exact = F.col(f"_yr{mark}")
        if mode in ("monthly", "latest"):
            df = df.join(latest.select(F.col("currency").alias(f"_lc{mark}"), F.col("_latest").alias(f"_lr{mark}")), code == F.col(f"_lc{mark}"), "left")
            back = F.col(f"_lr{mark}")
        dollar = code == "USD"
        rate = F.when(dollar, F.lit(1.0)).otherwise(F.coalesce(exact, back))
        fell = ~F.coalesce(dollar, F.lit(False)) & exact.isNull() & back.isNotNull() & F.lit(mode == "monthly")
        return df.withColumns({f"_rate{mark}": rate, f"_fell{mark}": fell})

    df = rate_of(df, F.col("_ccy"), "s")
    if target == "USD":
        rate, fell = F.col("_rates"), F.col("_fells")
    else:
        df = rate_of(df, F.lit(target), "t")
        same = F.coalesce(F.col("_ccy") == target, F.lit(False))
        rate = F.when(same, F.lit(1.0)).otherwise(F.col("_rates") / F.nullif(F.col("_ratet"), F.lit(0.0)))
        fell = ~same & (F.col("_fells") | F.col("_fellt"))
    df = df.withColumns({"_rate": rate, "_fell": F.coalesce(fell, F.lit(False))})
    lost_date = F.lit(mode == "monthly") & (when.isNull() if date else F.lit(False))
    status = (
        F.when(F.col("_amount").isNull(), "spend_invalid").when(F.col("_ccy").isNull(), "currency_missing")
        .when(F.col("_rate").isNull() & lost_date, "date_unparseable").when(F.col("_rate").isNull(), "unsupported_currency")
        .when(F.col("_fell"), "fallback").otherwise("converted")
    )
    good = status.isin("converted", "fallback")
    out = df.withColumns({"status": status, "fx_rate": F.when(good, F.col("_rate")), "converted": F.when(good, F.col("_amount") / F.nullif(F.col("_rate"), F.lit(0.0)))})
    return out.select(*(F.col("__in")[c].alias(c) for c in columns if c not in ("status", "fx_rate", "converted")), "status", "fx_rate", "converted")
