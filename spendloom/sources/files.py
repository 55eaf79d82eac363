"""Text files without a schema: CSV, ZIP archives of them and workbooks; and the sinks."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendloom.operators import shipping
from spendloom.operators.clean import POSITION
from spendloom.sources import workbooks

MEMBERS = "path string, file string, sheet string, pos long, cells array<string>, warning string"
_WORKBOOKS = (".xlsx", ".xlsm", ".xltx", ".xltm")


def read_csv(spark: SparkSession, path: str, multiline: bool = True, delimiter: str = ",") -> DataFrame:
    """Every cell as text in columns _c0, _c1, ... of the widest row, blanks as ''; with the file and the row's place.

    The schema is as wide as the widest row, so rows wider than the first one keep their cells.
    _place orders the rows of a file without a shuffle: the block of
    the file they are read from, then the row in it. multiline reads a file in one task; without
    it large files split. FILE_NAME is the base name, FILE_PATH tells equal names apart.
    """
    width = _width(spark, path, multiline, delimiter)
    names = [f"_c{i}" for i in range(width)]
    read = spark.read.schema(", ".join(f"{n} string" for n in names)).option("multiLine", multiline).option("encoding", "UTF-8").option("sep", delimiter)
    df = read.option("header", False).option("emptyValue", "").option("mode", "PERMISSIVE").csv(path)
    cells = [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*cells, F.col("_metadata.file_name").alias("FILE_NAME"), F.col("_metadata.file_path").alias("FILE_PATH"), place.alias("_place"))


#: Larger files are not read as one value: their width is bounded line by line.
WHOLE = 1 << 30


def _width(spark: SparkSession, path: str, multiline: bool, delimiter: str) -> int:
    """The cells of the widest record; delimiters within quotes are none.

    With multiline, files are read by the CSV rules, each in one task, record by record; of files over
    WHOLE bytes and without multiline it is a bound: a record has at most what a line holds outside
    quotes when it begins a record, and what another holds behind the quote that ends a cell.
    """
    widths: list[int] = []
    files = spark.read.format("binaryFile").load(path) if multiline else None
    if multiline:

        def widest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            csv.field_size_limit(1 << 30)
            for batch in batches:
                yield pd.DataFrame({"w": [max(map(len, csv.reader(io.TextIOWrapper(io.BytesIO(c), "utf-8-sig", "replace", newline=""), delimiter=delimiter)), default=0) for c in batch["content"]]})

        widths.append(files.where(F.col("length") <= WHOLE).select("content").mapInPandas(widest, "w long").agg(F.max("w")).first()[0] or 0)
    large = [r["path"] for r in files.where(F.col("length") > WHOLE).select("path").collect()] if multiline else path
    if large:
        lines = spark.read.text(large)
        # Whole quoted stretches go, then one that is open at the end of the line.
        outside = lambda c: F.regexp_replace(F.regexp_replace(c, '"[^"]*"', ""), '"[^"]*$', "")
        count = lambda c: F.length(c) - F.length(F.replace(c, F.lit(delimiter), F.lit("")))
        begun = count(outside(F.col("value")))
        ended = F.when(F.contains("value", F.lit('"')), count(outside(F.regexp_replace("value", '^[^"]*"', "")))).otherwise(0)
        row = lines.agg(F.max(begun).alias("begun"), F.max(ended).alias("ended")).first()
        widths.append((row["begun"] or 0) + (row["ended"] or 0) * multiline + 1)
    return max(*widths, 1)


def numbered(df: DataFrame, place: str = "_place") -> DataFrame:
    """POSITION from 0 within each file, in the order of place.

    Rows are ranked within blocks of a file and shifted by the counts of the blocks before, so
    no task holds a whole file of many blocks.
    """
    dealt = df.withColumn("_block", F.col(f"{place}.block"))
    sizes = dealt.groupBy("FILE_PATH", "_block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("FILE_PATH").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("FILE_PATH", "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("FILE_PATH", "_block").orderBy(place)) - 1
    return dealt.withColumn(POSITION, rank).join(before, ["FILE_PATH", "_block"]).withColumn(POSITION, F.col(POSITION) + F.col("_before")).drop("_block", "_before", place)


def _sheets(name: str, data: bytes, depth: int) -> Iterator[tuple]:
    """(file, sheet, position, cells, warning) of every table in a file; a bad one gives a warning."""
    lower = name.lower()
    try:
        if lower.endswith(".zip") and depth < 2:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for info in archive.infolist():
                    base = info.filename.rsplit("/", 1)[-1]
                    if not info.is_dir() and not base.startswith(".") and not info.filename.startswith("__MACOSX"):
                        yield from _sheets(f"{name}/{info.filename}" if depth else info.filename, archive.read(info), depth + 1)
        elif lower.endswith(".csv"):
            for i, row in enumerate(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""))):
                yield name, "", i, row, None
        elif lower.endswith(_WORKBOOKS):
            for sheet, _, package in workbooks.take_apart(data):
                for i, row in workbooks.sheet_rows(package):
                    yield name, sheet, i, row, None
        else:
            yield name, "", None, None, "neither CSV, ZIP nor a workbook"
    except Exception as bad:  # noqa: BLE001 - the other files of an archive still load
        yield name, "", None, None, f"{type(bad).__name__}: {bad}"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tables in the archives, CSV files and workbooks under path, one level of nesting.

    `path` is the outer file, so that equal names in two folders stay apart. Files are dealt out
    to tasks whole; workbooks outside archives are read sheet by sheet by `workbooks.read_workbooks`.
    """
    shipping.ship(spark)
    names = ["path", "file", "sheet", "pos", "cells", "warning"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for row in _sheets(path.rsplit("/", 1)[-1], bytes(content), 0):
                    held.append((path, *row))
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, MEMBERS)


def table_of(rows: DataFrame, file: str, sheet: str = "", path: str | None = None) -> DataFrame:
    """One table of an archive with columns RAW_0, RAW_1, ... and POSITION; short rows are padded."""
    own = rows.where((F.col("file") == file) & (F.col("sheet") == sheet) & F.col("warning").isNull() & (F.lit(path is None) | (F.col("path") == (path or ""))))
    width = own.agg(F.max(F.size("cells"))).first()[0] or 0
    return own.select(F.col("pos").alias(POSITION), *(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")).alias(f"RAW_{i}") for i in range(width)))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, nulls as blanks; one_file only for results that one task can write."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_workbook(df: DataFrame, path: str, name: str = "Sheet1") -> None:
    """A workbook of one sheet; more rows than a sheet holds are refused, not cut."""
    workbooks.write_tables({name: df}, path)


def write_all(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Every table as CSV in a folder of its name; signs that a path cannot hold become `_`."""
    names = [re.sub(r"[^A-Za-z0-9._-]+", "_", n) for n in tables]
    if len({*names}) < len(names):
        raise ValueError("two tables would share a folder")
    for name, df in zip(names, tables.values(), strict=True):
        write_csv(df, f"{path}/{name}")
    return names
