"""Column builders: everything stays inside JVM code generation, no Python functions per row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendloom.functions import constants as K

MONEY = "decimal(18,2)"


def text(c: str | Column) -> Column:
    """The column as text; names are quoted, as headers may hold dots and slashes."""
    return (F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c).cast("string")


def column(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def non_blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(text(c)) != "", F.lit(False))


def null_proxy(c: str | Column, words: Iterable[str] = K.NULL_PROXIES) -> Column:
    return F.coalesce(F.lower(F.trim(text(c))).isin(*words), F.lit(False))


def effective(c: str | Column) -> Column:
    """Neither blank nor a word for a missing value."""
    return non_blank(c) & ~null_proxy(c)


def any_non_blank(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (non_blank(c) for c in columns), F.lit(False))


def looks_numeric(c: str | Column) -> Column:
    """Has a digit and only characters of numbers; dates like 2024-01-15 look numeric too."""
    value = F.trim(text(c))
    return F.coalesce(value.rlike("[0-9]") & value.rlike("^[0-9eE.+-]+$"), F.lit(False))


def number(c: str | Column) -> Column:
    """The value without thousands separators as a double, or null."""
    value = F.regexp_replace(F.trim(text(c)), "[, ]", "")
    return F.when(value.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))


def spend(c: str | Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def match_key(c: str | Column) -> Column:
    """Key that finds "00123" and "123.0" equal: the number where it is one, else lower case.

    Text of digits and signs that is no number, such as 2024-01-15, keeps its own text.
    """
    value = F.trim(text(c))
    return F.coalesce(F.when(looks_numeric(value), value.try_cast("double").cast("string")), F.lower(value))


def merge_key(columns: Iterable[str]) -> Column:
    """Composite key of lower-cased, trimmed values; null if any of them is."""
    parts = [F.trim(F.lower(text(c))) for c in columns]
    return reduce(lambda a, b: F.concat(a, F.lit("|||"), b), parts)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part of whole in percent, 0 without a whole."""
    share = F.round(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100, digits)
    return F.coalesce(share, F.lit(0.0))


def strip_zeros(c: str) -> Column:
    return F.when(F.trim(text(c)).rlike("^[0-9]+$"), F.regexp_replace(F.trim(text(c)), r"^0+(?=\d)", "")).otherwise(text(c))


def pad(c: str, width: int) -> Column:
    """Digits padded with zeros to width; longer ones keep their last `width` digits."""
    if not 1 <= width <= 50:
        raise ValueError("width must be from 1 to 50")
    value = F.trim(text(c))
    return F.when(value.rlike("^[0-9]+$"), F.right(F.concat(F.lit("0" * width), value), F.lit(width))).otherwise(text(c))


def money_text(c: Column) -> Column:
    """$1.2B, $3.4M, $5.6K or $7.89, as reports show amounts."""
    size = F.abs(c)
    scaled = lambda by, mark: F.concat(F.lit("$"), F.format_number(c / by, 1), F.lit(mark))
    return F.when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))


def word_count(c: str | Column) -> Column:
    value = F.trim(text(c))
    return F.when(value == "", 0).otherwise(F.size(F.split(value, r"\s+")))


def contains(columns: Iterable[str], keyword: str) -> Column:
    """The keyword, literally and in any case, in one of the columns."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.instr(F.lower(text(c)), keyword.lower()) > 0, F.lit(False)) for c in columns), F.lit(False))


def supplier_name(c: str | Column) -> Column:
    """Name without web domains, trailing legal forms and punctuation."""
    domains, ending = "|".join(K.WEB_DOMAINS), "|".join(K.SUPPLIER_SUFFIXES)
    bare = F.regexp_replace(F.trim(text(c)), rf"(?i)\.({domains})\b", "")
    named = F.trim(F.regexp_replace(bare, rf"(?i)(\b({ending})\s*,?\s*)+$", ""))
    return squeezed(F.rtrim(named, F.lit(K.SUPPLIER_TAIL)))


def squeezed(c: Column) -> Column:
    """Trimmed, with single spaces between words."""
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


def plant_name(c: str | Column) -> Column:
    """Plant without a numeric suffix, a trailing parenthesis and repeated spaces."""
    value = F.trim(text(c))
    for tail in (K.PLANT_NUMBER, K.PLANT_REMARK):
        value = F.regexp_replace(value, tail, "")
    return squeezed(value)


def payment_term(c: str | Column) -> Column:
    """struct(days, discount, known) of a payment term; days null where it says none."""
    value = F.regexp_replace(text(c), r"^\s+|\s+$", "")
    any_case = lambda p: f"(?i){p}"
    part = lambda p, i: F.regexp_extract(value, any_case(p), i)
    with_discount = value.rlike(any_case(K.DISCOUNT_TERM))
    days, discount = F.when(with_discount, part(K.DISCOUNT_TERM, 3)), F.when(with_discount, F.concat(part(K.DISCOUNT_TERM, 1), F.lit("% discount if paid within "), part(K.DISCOUNT_TERM, 2), F.lit(" days")))
    for pattern in K.DAYS_TERMS:
        days = days.when(value.rlike(any_case(pattern)), part(pattern, 1))
    for pattern, note in K.AT_ONCE:
        days, discount = days.when(value.rlike(any_case(pattern)), F.lit("0")), discount.when(value.rlike(any_case(pattern)), F.lit(note))
    return F.struct(days.alias("days"), F.coalesce(discount, F.lit("")).alias("discount"), (days.isNotNull() | F.lower(value).isin(K.NO_TERM)).alias("known"))
