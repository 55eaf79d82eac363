"""Workbooks of the open XML format, read from their ZIP parts: no reader need be installed.

A workbook is taken apart where Spark reads it; its sheets then travel apart, so that one task
parses one sheet, row by row. What a sheet needs besides its own part are the shared
strings and the number formats.
"""

from __future__ import annotations

import datetime
import io
import pickle
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendloom.operators import shipping

ROWS = "path string, file string, sheet string, sheet_no int, pos long, cells array<string>, warning string"
_NAMES = ["path", "file", "sheet", "sheet_no", "pos", "cells", "warning"]
BATCH = 5_000

#: Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_ASIDE = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')
_PLACE = re.compile(r"([A-Z]+)(\d*)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(element) -> str:
    """The text of a string item: its own or that of its runs, without phonetic hints."""
    return "".join(t.text or "" for part in element if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else part) if _local(t.tag) == "t")


def _strings(archive: zipfile.ZipFile, name: str) -> list[str]:
    if name not in archive.namelist():
        return []
    out = []
    with archive.open(name) as part:
        for _, element in ElementTree.iterparse(part):
            if _local(element.tag) == "si":
                out.append(_texts(element))
                element.clear()
    return out


def _date_styles(archive: zipfile.ZipFile, name: str) -> list[bool]:
    """For each cell style whether it shows a date or a time."""
    if name not in archive.namelist():
        return []
    root, own, out = ElementTree.fromstring(archive.read(name)), {}, []
    for element in root.iter():
        if _local(element.tag) == "numFmt":
            code = _ASIDE.sub("", element.get("formatCode", "")).lower()
            own[int(element.get("numFmtId", -1))] = bool(re.search("[dmyhs]", code)) and "general" not in code
    for element in root.iter():
        if _local(element.tag) == "cellXfs":
            for style in element:
                number = int(style.get("numFmtId", 0))
                out.append(own.get(number, number in DATE_FORMATS))
    return out


def _target(base: str, target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"{base}/{target}"


def take_apart(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(sheet, its number, all that its rows need, packed) of a workbook's sheets."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {e.get("Id"): (e.get("Type", "").rpartition("/")[2], _target("xl", e.get("Target", ""))) for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        part = lambda kind, default: next((t for k, t in links.values() if k == kind), default)
        strings, dated = _strings(archive, part("sharedStrings", "xl/sharedStrings.xml")), _date_styles(archive, part("styles", "xl/styles.xml"))
        old = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        sheets = [e for e in book.iter() if _local(e.tag) == "sheet"]
        for i, sheet in enumerate(sheets):
            link = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), "")
            kind, name = links.get(link, ("", ""))
            if kind == "worksheet" and name in archive.namelist():
                yield sheet.get("name", ""), i, zlib.compress(pickle.dumps((archive.read(name), strings, dated, old)), 1)


def _moment(serial: float, old: bool) -> str:
    """A date's serial number as text: a time alone below one, else date and time."""
    days, rest = divmod(round(serial * 86_400), 86_400)
    clock = str(datetime.timedelta(seconds=rest)).zfill(8)
    if serial < 1:
        return clock
    # The format takes 1900 for a leap year, so numbers before its 29 February lie a day off.
    first = datetime.date(1904, 1, 1) if old else datetime.date(1899, 12, 30 if days > 59 else 31)
    return f"{first + datetime.timedelta(days=days)} {clock}"


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _cell(cell, strings: list[str], dated: list[bool], old: bool) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return next((_texts(e) for e in cell if _local(e.tag) == "is"), "")
    text = next((e.text or "" for e in cell if _local(e.tag) == "v"), "")
    if not text or kind == "e":
        return ""
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return str(text == "1")
    if kind != "n":
        return text
    style = int(cell.get("s", 0))
    try:
        return _moment(float(text), old) if style < len(dated) and dated[style] and float(text) >= 0 else _number(text)
    except (ValueError, OverflowError):
        return text


def sheet_rows(package: bytes) -> Iterator[tuple[int, list[str]]]:
    """(row number from 0, cells as text) of a sheet, one row at a time; rows without cells are left out."""
    data, strings, dated, old = pickle.loads(zlib.decompress(package))
    at = -1
    rows = ElementTree.iterparse(io.BytesIO(data), events=("start", "end"))
    holder = None
    for event, element in rows:
        tag = _local(element.tag)
        if event == "start":
            holder = element if tag == "sheetData" else holder
        elif tag == "row":
            at = int(element.get("r", at + 2)) - 1
            cells: list[str] = []
            for cell in element:
                place = _PLACE.match(cell.get("r", ""))
                column = 0
                for letter in place[1] if place else "":
                    column = column * 26 + ord(letter) - 64
                cells += [""] * ((column or len(cells) + 1) - 1 - len(cells))
                cells.append(_cell(cell, strings, dated, old))
            if any(cells):
                yield at, cells
            holder.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all sheets of the workbooks under path: path, file, sheet, sheet_no, pos, cells, warning.

    Cells are texts as the sheet holds them: whole numbers without a point, dates as
    `2025-01-15 00:00:00`, truth as True or False, errors and blanks empty. A file that is no
    workbook or a sheet that breaks off gives a row with a warning, and the others still load.
    """
    shipping.ship(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sheet", "sheet_no", "package", "warning"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    for sheet, i, package in take_apart(content.as_py()):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, sheet, i, package, None), kinds, strict=True)], names)
                except Exception as bad:  # noqa: BLE001 - the other files still load
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, "", 0, None, f"{type(bad).__name__}: {bad}"), kinds, strict=True)], names)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, sheet, i, package, warning in batch.itertuples(index=False):
                file, held = path.rsplit("/", 1)[-1], []
                try:
                    for pos, cells in sheet_rows(package) if package is not None else ():
                        held.append((path, file, sheet, i, pos, cells, None))
                        if len(held) == BATCH:
                            yield pd.DataFrame(held, columns=_NAMES)
                            held = []
                except Exception as bad:  # noqa: BLE001 - the other sheets still load
                    warning = f"{type(bad).__name__}: {bad}"
                if warning is not None:
                    held.append((path, file, sheet, i, None, None, warning))
                if held:
                    yield pd.DataFrame(held, columns=_NAMES).astype({"pos": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    sheets = files.mapInArrow(split, "path string, sheet string, sheet_no int, package binary, warning string")
    return sheets.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "sheet_no").mapInPandas(parse, ROWS)


def sheet_table(rows: DataFrame, file: str, sheet: str) -> DataFrame:
    """One sheet as a table: its first row names the columns, short rows are padded, blank rows go.

    FILE_NAME and RECORD_ID (from 1, in the order of the sheet) stand before the columns. Names
    are in upper case; empty and repeated ones get a number.
    """
    own = rows.where((F.col("file") == file) & (F.col("sheet") == sheet) & F.col("warning").isNull())
    head = own.select("pos", "cells").orderBy("pos").first()
    width = own.agg(F.max(F.size("cells"))).first()[0] or 0
    given = [c.strip().upper() for c in (head["cells"] if head else [])] + [""] * width
    names: list[str] = []
    for i, name in enumerate(given[:width]):
        name = name or f"COLUMN_{i + 1}"
        names.append(name if name not in (*names, "FILE_NAME", "RECORD_ID") else f"{name}_{i + 1}")
    body = own.where(F.col("pos") > (head["pos"] if head else 0))
    # A sheet has at most 1,048,576 rows, so one task can number them.
    number = F.row_number().over(Window.orderBy("pos")).cast("string")
    cell = lambda i: F.nullif(F.trim(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit(""))), F.lit(""))
    return body.select(F.col("file").alias("FILE_NAME"), number.alias("RECORD_ID"), *(cell(i).alias(n) for i, n in enumerate(names)))


def fx_rates(rows: DataFrame, file: str | None = None) -> DataFrame:
    """(currency, year, month, rate) of an exchange-rate sheet, as `normalise.convert` takes them.

    The layout: somewhere a row that begins with `Years`, its cells from the third on being
    currencies; below it a year, the month's short name, and a rate for each currency. Rows
    with another year or month and cells that are no numbers are passed over; of a workbook the first sheet
    counts. A workbook without such a header gives no rows.
    """
    own = rows.where(F.col("warning").isNull() & (F.col("sheet_no") == 0))
    own = own.where(F.col("file") == file) if file else own
    at = lambda i: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")))
    heads = own.where(at(1) == "Years").groupBy("path").agg(F.min_by(F.struct("pos", F.col("cells").alias("heads")), "pos").alias("h")).select("path", F.col("h.pos").alias("from"), "h.heads")
    body = own.join(heads, "path").where((F.col("pos") > F.col("from")) & at(1).rlike("^[0-9]{1,4}$") & at(2).isin(*MONTHS))
    cells = body.select("path", "pos", at(1).cast("int").alias("year"), F.array_position(F.array(*map(F.lit, MONTHS)), at(2)).cast("int").alias("month"), F.posexplode(F.arrays_zip("heads", "cells")).alias("i", "cell"))
    rate = F.trim("cell.cells").try_cast("double")
    found = cells.where("i >= 2").select("path", "pos", F.upper(F.trim("cell.heads")).alias("currency"), "year", "month", rate.alias("rate")).where("currency <> '' AND rate IS NOT NULL AND NOT isnan(rate)")
    # A month that is given twice counts as the lower row says.
    return found.groupBy("currency", "year", "month").agg(F.max_by("rate", F.struct("path", "pos")).alias("rate"))


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_RELATION = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_BOOK = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{}</sheets></workbook>'
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
MOST_ROWS = 1_048_576


def _xml_cell(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_UNWRITABLE.sub("", str(value)))}</t></is></c>'


def write_book(target: str | io.BytesIO, sheets: dict[str, Iterable[Iterable[object]]]) -> None:
    """A workbook of the given sheets, each an iterable of rows, written row by row; a sheet over the format's rows is refused."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        n = len(sheets)
        archive.writestr("[Content_Types].xml", _TYPES.format("".join(_SHEET_TYPE.format(i + 1) for i in range(n))))
        archive.writestr("_rels/.rels", _RELATIONS.format(_RELATION.format(1, "officeDocument", "xl/workbook.xml")))
        names = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, name in enumerate(sheets))
        archive.writestr("xl/workbook.xml", _BOOK.format(names))
        archive.writestr("xl/_rels/workbook.xml.rels", _RELATIONS.format("".join(_RELATION.format(i + 1, "worksheet", f"worksheets/sheet{i + 1}.xml") for i in range(n))))
        for i, rows in enumerate(sheets.values()):
            with archive.open(f"xl/worksheets/sheet{i + 1}.xml", "w", force_zip64=True) as part:
                part.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for k, row in enumerate(rows):
                    if k == MOST_ROWS:
                        raise ValueError("too many rows for one sheet; write CSV or Parquet")
                    part.write(f'<row r="{k + 1}">{"".join(map(_xml_cell, row))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")


def write_tables(tables: dict[str, DataFrame], target: str | io.BytesIO) -> None:
    """Each table as a sheet with a header row; rows come from Spark partition by partition."""
    rows = lambda df: (r for part in ([df.columns], df.toLocalIterator()) for r in part)
    write_book(target, {name: rows(df) for name, df in tables.items()})
