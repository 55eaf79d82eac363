"""What reports say of a view or a table: leaders and their shares, distinct values, kinds of columns, priorities."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import constants as K
from spendloom.functions import dates
from spendloom.functions import fields
from spendloom.operators import profile
from spendloom.operators.panels import seeded
from spendloom.operators.running import leading


def concentration(df: DataFrame, key: str, spend: str, tops: tuple[int, ...] = (3,)) -> DataFrame:
    """Keys, the one of most spend with its share, the share of the first k of them, and that of all others than the first.

    One row for a view of suppliers, countries, currencies or categories; ties go by key.
    """
    per = df.groupBy(F.col(key).alias("key")).agg(F.sum(spend).alias("spend"))
    total = per.agg(F.count("*").alias("members"), F.sum("spend").alias("total"))
    # As many rows as the largest k, whatever the table holds.
    first = per.orderBy(F.desc_nulls_last("spend"), F.asc_nulls_last("key")).limit(max(tops)).agg(F.array_sort(F.collect_list(F.struct((-F.col("spend")).alias("s"), "key"))).alias("first"))
    part = lambda k: F.aggregate(F.slice("first", 1, k), F.lit(0).cast("double"), lambda acc, x: acc - x["s"].cast("double"))
    share = lambda amount: C.percent(amount, F.col("total"), 1)
    leader = F.try_element_at("first", F.lit(1))
    return total.join(F.broadcast(first)).select(
        "members", leader["key"].alias("leader"), share(part(1)).alias("leader_pct"), *(share(part(k)).alias(f"top{k}_pct") for k in tops),
        F.when(F.col("members") > 1, F.round(F.lit(100) - share(part(1)), 1)).otherwise(F.lit(0.0)).alias("others_pct"),
    )


def long_tail(df: DataFrame, supplier: str, spend: str, percent: float = 80) -> DataFrame:
    """Suppliers that reach percent of spend, how many are left, and the share of spend that these hold."""
    per = df.groupBy(F.col(supplier).alias("supplier")).agg(F.sum(spend).alias("spend"))
    inside = leading(per, "spend", "supplier", percent).agg(F.count("*").alias("leading"), F.sum("spend").alias("reached"))
    whole = per.agg(F.count("*").alias("all"), F.sum("spend").alias("total"))
    return whole.join(F.broadcast(inside)).select("leading", (F.col("all") - F.col("leading")).alias("long_tail"), C.percent(F.col("total") - F.col("reached"), F.col("total"), 1).alias("long_tail_pct"))


def segment_leaders(df: DataFrame, column: str, segment: str, spend: str, k: int = 3) -> DataFrame:
    """The k segments of most spend with their share of all, and the k of them in the column of most spend."""
    per = df.groupBy(F.col(column).alias("column"), F.col(segment).alias("segment")).agg(F.sum(spend).alias("spend"))
    columns = per.groupBy("column").agg(F.sum("spend").alias("of_column"))
    total = columns.agg(F.sum("of_column").alias("total"), F.max_by("column", F.struct(F.col("of_column"), F.col("column"))).alias("leader"))
    ranked = per.join(F.broadcast(total))
    order = [F.desc("spend"), "column", "segment"]
    part = lambda rows, scope: rows.orderBy(*order).limit(k).withColumn("scope", F.lit(scope))
    both = part(ranked, "all").union(part(ranked.where(F.col("column") == F.col("leader")), "leading column"))
    return both.select("scope", "column", "segment", F.round(F.col("spend").cast("double"), 2).alias("total_spend"), C.percent(F.col("spend"), F.col("total"), 1).alias("pct_of_total"))


def distinct_values(df: DataFrame, columns: Iterable[str], most: int = 50) -> DataFrame:
    """The first `most` distinct values of each column, in their order; a task sends on as many a column."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return profile.value_counts(df, columns).where(C.non_blank("value")).select("column", "value", rank.alias("rank")).where(F.col("rank") <= most)


def currency_codes(df: DataFrame, column: str, most: int = 200) -> DataFrame:
    """Distinct codes, trimmed and in upper case, with their rows; the most frequent `most`."""
    per = df.where(C.non_blank(column)).groupBy(F.upper(F.trim(C.text(column))).alias("code")).agg(F.count("*").alias("rows"))
    return per.orderBy(F.desc("rows"), "code").limit(most)


def year_of(c: str | Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(C.text(c), r"((?:19|20)\d\d)", 1), F.lit("")).cast("int")


def month_label(index: Column) -> Column:
    """`Mar 1997` for a month counted as year * 12 + month."""
    year, month = F.floor((index - 1) / 12), F.pmod(index - 1, F.lit(12))
    return F.concat(F.get(F.array(*map(F.lit, K.MONTHS)), month.cast("int")), F.lit(" "), year.cast("string"))


def column_kinds(tables: Mapping[str, DataFrame], numeric: int = 80, date: int = 80, not_numeric: int = 50) -> DataFrame:
    """Over all tables that hold a column: rows, blanks, most distinct values, and is it a number, a date or text.

    A column is a number if more than 80 % of its values are; a date if more than 80 % look
    like one and fewer than 50 % are numbers.
    """
    parts = None
    for df in tables.values():
        n, full = F.col("n"), C.non_blank("value")
        form = dates.format_name("value")
        on = lambda cond: F.sum(F.when(cond, n).otherwise(0)).cast("long")
        per = profile.value_counts(df, df.columns).groupBy("column").agg(
            F.sum("n").cast("long").alias("rows"), on(~full).alias("blank"), F.count(F.when(full, 1)).alias("distinct"),
            on(full & C.number("value").isNotNull()).alias("numbers"), on(full & (form != "other")).alias("dates"),
        )
        parts = per if parts is None else parts.union(per)
    out = parts.groupBy("column").agg(*(F.sum(c).cast("long").alias(c) for c in ("rows", "blank")), F.max("distinct").alias("most_distinct"), F.sum("numbers").alias("numbers"), F.sum("dates").alias("dates"))
    filled = F.greatest(F.col("rows") - F.col("blank"), F.lit(1))
    of = lambda c: F.col(c) * 100.0 / filled
    kind = F.when(of("numbers") > numeric, "number").when((of("dates") > date) & (of("numbers") < not_numeric), "date").otherwise("text")
    return out.select("column", "rows", "blank", "most_distinct", kind.alias("kind"))


def semantic_tags(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, tags): what the filled values of each column are, by shares of all its rows.

    Values are trimmed. Codes, years, postal codes and debit or credit signs tag a column from 30 %
    on, country names and units from 20 %. A column without a filled value has no tags.
    """
    value, low = F.trim("value"), F.lower(F.trim("value"))
    kinds = {
        "currency_code": (value.rlike("^[A-Z]{3}$"), 30), "country_iso2": (value.rlike("^[A-Z]{2}$"), 30), "country_name": (low.isin(fields.COUNTRY_WORDS), 20),
        "year": (value.rlike("^(19|20)[0-9]{2}$"), 30), "uom": (low.isin(fields.UNIT_WORDS), 20), "postal_code": (value.rlike("^[0-9]{4,6}(-[0-9]{4})?$"), 30),
        "debit_credit": (low.isin(fields.DEBIT_CREDIT_WORDS), 30),
    }
    full = C.non_blank("value")
    on = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    per = profile.value_counts(df, columns).groupBy("column").agg(on(full).alias("filled"), *(on(full & cond).alias(tag) for tag, (cond, _) in kinds.items()))
    told = [F.when((F.col("filled") > 0) & (100 * F.col(tag) >= least * F.col("filled")), F.lit(tag)) for tag, (_, least) in kinds.items()]
    return per.select("column", F.array_compact(F.array(*told)).alias("tags"))


def merge_priorities(overlaps: DataFrame, fact: str) -> DataFrame:
    """Tables by how well they would merge with the fact table: 0.65 of shared values and 0.35 of shared headers."""
    pairs = overlaps.where((F.col("a") == fact) | (F.col("b") == fact))
    score = F.coalesce("value_overlap", F.lit(0.0)) * 0.65 + F.col("header_overlap") * 0.35
    label = F.when(score >= 0.65, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("none")
    return pairs.select(F.when(F.col("a") == fact, F.col("b")).otherwise(F.col("a")).alias("table"), F.round(score, 4).alias("priority"), label.alias("label"))


def sample_of_leaders(df: DataFrame, description: str, spend: str, n: int = 100, percent: float = 80, seed: int = 7) -> DataFrame:
    """n of the descriptions that together reach percent of spend, in a seeded random order; a sampling operator."""
    per = df.where(C.non_blank(description)).groupBy(F.trim(C.text(description)).alias("description")).agg(F.sum(spend).alias("spend"))
    return leading(per, "spend", "description", percent).orderBy(seeded("description", seed), "description").limit(n).select("description")
