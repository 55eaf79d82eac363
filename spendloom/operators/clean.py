"""Cleaning raw text tables: rows, columns, case, types, keys and headers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import dates

POSITION = "_pos"


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (POSITION, "FILE_NAME", "RECORD_ID")]


def drop_blank_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.where(C.any_non_blank(columns or _data_columns(df)))


def drop_blank_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value, unless all are; one pass gives one row to the driver."""
    columns = _data_columns(df)
    filled = df.agg(*(F.max(C.non_blank(c)).alias(str(i)) for i, c in enumerate(columns))).first()
    blank = [c for i, c in enumerate(columns) if not filled[str(i)]]
    return df if len(blank) == len(columns) else df.drop(*blank)


def case_trim(df: DataFrame, columns: Iterable[str] | None = None, case: str = "upper", trim: bool = True) -> DataFrame:
    """Upper or lower case, trimmed; blank cells become null."""
    change = {"upper": F.upper, "lower": F.lower}[case]

    def cell(c: str):
        value = F.trim(C.text(c)) if trim else C.text(c)
        return F.when(C.non_blank(c), change(value))

    return df.withColumns({c: cell(c) for c in columns or _data_columns(df)})


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """number: text of the number where it is one; date: ISO text where it parses; else unchanged."""
    new = {}
    for c, kind in types.items():
        value = C.number(c).cast("string") if kind == "number" else dates.parse(c).cast("string")
        new[c] = F.coalesce(value, C.text(c))
    return df.withColumns(new)


def dedup_keep_first(df: DataFrame, keys: Iterable[str], order: str = POSITION) -> DataFrame:
    """One row per exact key, the first in order; nulls are one value.

    Rows without an order come last. The rows are pre-aggregated by min_by before the shuffle, so copies of one key that hold a
    third of all rows move as one row a task and never meet in a window.
    """
    keys, rest = [*keys], [c for c in df.columns if c not in {*keys}]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), F.col(order))).alias("_first"))
    return first.select(*keys, "_first.*").select(df.columns)


def dedup_preview(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return per.agg(total.cast("long").alias("total_rows"), unique.alias("unique_rows"), (total - unique).cast("long").alias("duplicate_rows"))


def clean_table(df: DataFrame, drop: Iterable[str] = (), keys: Iterable[str] = (), case: str = "upper", types: Mapping[str, str] | None = None, order: str = POSITION) -> DataFrame:
    """The whole chain: drop columns, blank rows, blank columns, case, types, duplicates."""
    df = case_trim(drop_blank_columns(drop_blank_rows(df.drop(*drop))), case=case)
    df = apply_types(df, types) if types else df
    return dedup_keep_first(df, keys, order) if keys else df


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "RECORD_ID") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def concat_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if len(columns) < 2:
        raise ValueError("at least two columns are needed")
    return df.withColumn("Concat_" + "_".join(columns), F.concat(*(F.coalesce(C.text(c), F.lit("")) for c in columns)))


def standardize(df: DataFrame, actions: Mapping[str, str | int]) -> DataFrame:
    """'strip' removes leading zeros, a number pads digits to that width."""
    return df.withColumns({c: C.strip_zeros(c) if a == "strip" else C.pad(c, int(a)) for c, a in actions.items()})


def column_format(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Per column: rows, share of leading zeros and digits, lengths, and pad, strip or none.

    The values are counted first, so a table of many equal cells is shuffled as few rows.
    """
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(C.text(c)).alias("value")) for c in columns))).alias("x")).select("x.*")
    per = cells.where(C.non_blank("value")).groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("len", F.length("value"))
    lengths = per.groupBy("column", "len").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").rlike("^0[0-9]+$"), F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("value").rlike("^[0-9]+$"), F.col("n")).otherwise(0)).alias("digits"))
    out = lengths.groupBy("column").agg(
        F.sum("n").alias("total"), F.sum("zeros").alias("zeros"), F.sum("digits").alias("digits"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.max_by("len", F.struct("n", -F.col("len"))).alias("mode_len"),
    )
    zeros, digits = C.percent(F.col("zeros"), F.col("total")), C.percent(F.col("digits"), F.col("total"))
    advice = F.when((digits >= 90) & (zeros >= 5), F.lit("pad")).when((digits >= 90) & (F.col("min_len") != F.col("max_len")), F.lit("strip")).otherwise(F.lit("none"))
    return out.select("column", F.col("total").cast("long").alias("total"), zeros.alias("leading_zero_pct"), digits.alias("numeric_pct"), "min_len", "max_len", "mode_len", advice.alias("advice"))


def remove_columns(df: DataFrame, columns: Iterable[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, the removed columns with the row's key)."""
    return df.drop(*columns), df.select(key, *columns)


def restore_columns(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return df.join(removed, key, "left")


def unique_headers(names: Iterable[str | None]) -> list[str]:
    """Blank headers become COLUMN_n, repeated ones get a number; case does not tell them apart."""
    out, seen = [], {}
    for i, raw in enumerate(names, 1):
        name = re.sub(r"\s+", " ", (raw or "").strip()).upper() or f"COLUMN_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def pick_header(raw: DataFrame, header_row: int, names: list[str] | None = None, keep_above: bool = False) -> DataFrame:
    """Take row header_row (by POSITION, from 0) as header; blank rows and columns below it go.

    POSITION must number the rows from 0. RECORD_ID numbers what is left, by a count of the
    kept rows before each block of positions, so no task sees all rows.
    """
    cells = [c for c in raw.columns if c != POSITION]
    head = raw.where(F.col(POSITION) == header_row).first()
    if head is None:
        raise ValueError(f"there is no row {header_row}")
    new = unique_headers(names or [head[c] for c in cells])
    if len(new) != len(cells):
        raise ValueError(f"shape mismatch: {len(new)} names for {len(cells)} columns")
    body = raw.where(F.col(POSITION) != header_row if keep_above else F.col(POSITION) > header_row)
    body = body.select(POSITION, *(C.text(c).alias(n) for c, n in zip(cells, new, strict=True)))
    return number_rows(case_trim(drop_blank_columns(drop_blank_rows(body))), POSITION, "RECORD_ID").drop(POSITION)


def number_rows(df: DataFrame, order: str, name: str, block: int = 100_000) -> DataFrame:
    """Dense numbers from 1 in the order of a row position (whole numbers)."""
    blocks = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocks.groupBy("_block").agg(F.count("*").alias("_size"))
    before = sizes.select("_block", (F.sum("_size").over(Window.orderBy("_block")) - F.col("_size")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return blocks.withColumn(name, rank).join(before, "_block").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_block", "_before")


def best_rows(df: DataFrame, n: int, order: str, first: int = 1000) -> DataFrame:
    """Of the first 1000 rows, the n with most filled cells; a preview, limited by what it is."""
    filled = sum((C.non_blank(c).cast("int") for c in df.columns if c != order), F.lit(0))
    return df.orderBy(order).limit(first).withColumn("filled", filled).orderBy(F.desc("filled"), order).limit(n)


def header_row(raw: DataFrame, most: int = 10) -> int:
    """The first of the first ten rows that has values in over half of its cells; 0 without one."""
    cells = [c for c in raw.columns if c != POSITION]
    full = sum(((C.non_blank(c) & ~F.lower(F.trim(C.text(c))).isin("nan", "none")).cast("int") for c in cells), F.lit(0))
    found = raw.where(F.col(POSITION) < most).where(full * 2 > len(cells)).agg(F.min(POSITION)).first()[0]
    return int(found or 0)


def place_after(df: DataFrame, source: str, new: str, value: Column) -> DataFrame:
    """df with a derived column right behind its source; one of that name is replaced."""
    rest = [c for c in df.columns if c != new]
    at = rest.index(source) + 1
    return df.withColumn(new, value).select(*(C.column(c) for c in (*rest[:at], new, *rest[at:])))
