"""Which columns of an upload hold dates, currency codes and spend: header words weighed with what the first rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import constants as K
from spendloom.functions import dates
from spendloom.operators.normalise import amount

#: A date column parses in at least so many of its cells, the other two fit in at least so many.
LEAST_DATES, LEAST_FITTING = 0.6, 0.7
#: Spend that is mostly positive counts more.
POSITIVE_BONUS = 1.2


def suggest_columns(df: DataFrame, order: str | None = None, first: int = 100) -> DataFrame:
    """(role, column, score): the best column for date, currency and spend by the first rows, which the feature looks at.

    One pass gives one row of counts. Empty cells and words for missing values do not count as
    filled; roles without a fitting column are absent, and of equal scores the first column wins.
    """
    weight = lambda c, words: max((w for k, w in words.items() if k in c.lower().strip()), default=0.0)
    found = {c: (any(k in c.lower() for k in K.DATE_WORDS), weight(c, K.CURRENCY_WORDS), weight(c, K.SPEND_WORDS)) for c in df.columns if c != order}
    found = {c: w for c, w in found.items() if any(w)}
    spark, schema = df.sparkSession, "role string, column string, score double"
    if not found:
        return spark.createDataFrame([], schema)
    rows = (df.orderBy(order) if order else df).limit(first)
    on = lambda cond: F.count(F.when(cond, 1))
    each = []
    for i, c in enumerate(found):
        full, number = C.non_blank(c) & ~F.trim(C.text(c)).isin("nan", "None", "<NA>"), amount(F.regexp_replace(C.text(c), r"\s", ""))
        each += [on(full).alias(f"f{i}"), on(full & dates.parse(c).isNotNull()).alias(f"d{i}"), on(full & F.upper(F.trim(C.text(c))).rlike("^[A-Z]{3}$")).alias(f"c{i}"), on(number.isNotNull()).alias(f"n{i}"), on(number > 0).alias(f"p{i}")]
    one = rows.agg(F.count("*").alias("rows"), *each).first()
    scores: list[tuple[str, str, float]] = []
    for i, (c, (dated, currency, spend)) in enumerate(found.items()):
        filled, total = one[f"f{i}"], max(one["rows"], 1)
        if not filled:
            continue
        dates_, codes, numbers = one[f"d{i}"] / filled, one[f"c{i}"] / filled, one[f"n{i}"] / total
        if dated and dates_ >= LEAST_DATES:
            scores.append(("date", c, dates_))
        if currency and codes >= LEAST_FITTING:
            scores.append(("currency", c, currency * codes * filled / total))
        if spend and numbers >= LEAST_FITTING:
            bonus = POSITIVE_BONUS if 2 * one[f"p{i}"] >= one[f"n{i}"] else 1.0
            scores.append(("spend", c, spend * numbers * filled / total * bonus))
    best = {}
    for role, c, score in scores:
        if role not in best or score > best[role][1]:
            best[role] = (c, score)
    return spark.createDataFrame([(role, c, round(score, 3)) for role, (c, score) in best.items()], schema)
