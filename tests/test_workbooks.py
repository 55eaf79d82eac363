"""Workbooks: planted parts, sheets of their own tasks, the exchange-rate layout, and what is broken."""

import io
import zipfile

import pytest

from spendloom.operators import normalise, shipping
from spendloom.sources import files, workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
STYLES = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="[Red]0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/></cellXfs></styleSheet>'
STRINGS = f'<sst xmlns="{MAIN}"><si><t>Invoice date</t></si><si><r><t>two </t></r><r><t xml:space="preserve">runs</t></r><rPh><t>no</t></rPh></si><si><t>a &lt;b&gt; &amp; é</t></si></sst>'
ROWS = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
    '<row r="3"><c r="A3" s="1"><v>45672</v></c><c r="B3"><v>100</v></c><c r="C3" t="inlineStr"><is><t>in line</t></is></c></row>'
    '<row r="5"><c r="A5" s="2"><v>45672.5</v></c><c r="B5" s="3"><v>2.5</v></c><c r="C5" t="b"><v>1</v></c><c r="AA5"><v>1E-3</v></c></row>'
    '<row r="6"><c r="A6" s="4"><v>0.75</v></c><c r="B6" t="e"><v>#N/A</v></c><c r="C6" t="str"><v>made</v></c></row>'
    '<row><c t="s"><v>2</v></c><c><v>1e20</v></c></row><row r="9"><c r="A9"/></row>'
)


def book(rows=ROWS, extra="", **parts):
    data = io.BytesIO()
    workbooks.write_book(data, {"First": [], "Second": [["x", 1]]})
    old = zipfile.ZipFile(io.BytesIO(data.getvalue()))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name in old.namelist():
            content = old.read(name)
            if name == "xl/worksheets/sheet1.xml":
                content = f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>'.encode()
            if name == "xl/workbook.xml":
                content = content.replace(b"<sheets>", extra.encode() + b"<sheets>")
            archive.writestr(name, content)
        archive.writestr("xl/styles.xml", STYLES)
        archive.writestr("xl/sharedStrings.xml", STRINGS)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    (at / "a.xlsx").write_bytes(book())
    (at / "old.xlsx").write_bytes(book(extra='<workbookPr date1904="1"/>'))
    (at / "broken.xlsx").write_bytes(b"no archive")
    (at / "cut.xlsx").write_bytes(book(rows='<row r="1"><c><v>1</v></c></row><row r="2"><c>'))
    return at


def test_cells(spark, folder):
    rows = workbooks.read_workbooks(spark, f"{folder}/*.xlsx").collect()
    first = {r.pos: r.cells for r in rows if r.file == "a.xlsx" and r.sheet == "First"}
    assert first == {
        1: ["Invoice date", "", "two runs"],
        2: ["2025-01-15 00:00:00", "100", "in line"],
        4: ["2025-01-15 12:00:00", "2.5", "True", *[""] * 23, "0.001"],
        5: ["18:00:00", "", "made"],
        6: ["a <b> & é", "1e+20"],
    }
    assert [r.cells for r in rows if r.file == "a.xlsx" and r.sheet == "Second"] == [["x", "1"]]
    assert [r.cells[0] for r in rows if r.file == "old.xlsx" and r.pos == 2] == ["2029-01-16 00:00:00"]
    warned = {(r.file, r.sheet): r.warning for r in rows if r.warning}
    assert set(warned) == {("broken.xlsx", ""), ("cut.xlsx", "First")} and "BadZipFile" in warned["broken.xlsx", ""]
    assert [r.cells for r in rows if r.file == "cut.xlsx" and r.sheet == "Second"] == [["x", "1"]]


def test_sheet_as_table(spark, folder):
    table = workbooks.sheet_table(workbooks.read_workbooks(spark, f"{folder}/a.xlsx"), "a.xlsx", "First")
    assert table.columns[:5] == ["FILE_NAME", "RECORD_ID", "INVOICE DATE", "COLUMN_2", "TWO RUNS"] and len(table.columns) == 29
    got = [(r["RECORD_ID"], r["INVOICE DATE"], r["COLUMN_2"], r["COLUMN_27"]) for r in table.collect()]
    assert got == [("1", "2025-01-15 00:00:00", "100", None), ("2", "2025-01-15 12:00:00", "2.5", "0.001"), ("3", "18:00:00", None, None), ("4", "a <b> & é", "1e+20", None)]


def test_mixed_labels_and_dates_stay_text(spark, tmp_path):
    workbooks.write_book(str(tmp_path / "m.xlsx"), {"Sheet1": [["Invoice date", "Amount"], ["2025-01-15", "100"], ["Invoice date", "200"]]})
    rows = workbooks.read_workbooks(spark, str(tmp_path))
    assert rows.where("warning IS NOT NULL").count() == 0
    assert [r[2] for r in workbooks.sheet_table(rows, "m.xlsx", "Sheet1").collect()] == ["2025-01-15", "Invoice date"]


def test_written_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<&>\x01", 0.1, True), (2, None, None, False)], "n long, t string, x double, b boolean")
    target = str(tmp_path / "w.xlsx")
    workbooks.write_tables({"One & only": df, "Two": df.limit(0)}, target)
    rows = {(r.sheet, r.pos): r.cells for r in workbooks.read_workbooks(spark, target).collect()}
    assert rows == {("One & only", 0): ["n", "t", "x", "b"], ("One & only", 1): ["1", "a<&>", "0.1", "True"], ("One & only", 2): ["2", "", "", "False"], ("Two", 0): ["n", "t", "x", "b"]}
    with pytest.raises(ValueError, match="too many"):
        workbooks.write_book(io.BytesIO(), {"s": ([] for _ in range(workbooks.MOST_ROWS + 1))})


def test_sheets_are_tasks_of_their_own(spark, tmp_path):
    workbooks.write_book(str(tmp_path / "big.xlsx"), {f"S{i}": [[i, k] for k in range(12_000)] for i in range(4)})
    got = workbooks.read_workbooks(spark, str(tmp_path))
    assert got.groupBy("sheet").count().collect() and {(r.sheet, r["count"]) for r in got.groupBy("sheet").count().collect()} == {(f"S{i}", 12_000) for i in range(4)}
    assert got.selectExpr("spark_partition_id() AS p").distinct().count() > 1


def test_rates_of_a_sheet_convert(spark, tmp_path):
    sheet = [["Exchange rates"], [], ["Years", "Months", "EUR", " gbp ", "", "JPY"], [2024, "Jan", 0.9, 0.8, 9, "n/a"], ["2024", "Feb", 0.95, 0.85, 9, 150], ["", "Mar", 1, 1], ["2024", "Sum", 1, 1], ["total", "Jan", 1], [2024, "Feb", 0.96]]
    workbooks.write_book(str(tmp_path / "fx.xlsx"), {"Rates": sheet, "Notes": [["Years", "Months", "XXX"], [2024, "Jan", 7]]})
    rates = workbooks.fx_rates(workbooks.read_workbooks(spark, str(tmp_path)), "fx.xlsx")
    assert {tuple(r) for r in rates.collect()} == {("EUR", 2024, 1, 0.9), ("GBP", 2024, 1, 0.8), ("EUR", 2024, 2, 0.96), ("GBP", 2024, 2, 0.85), ("JPY", 2024, 2, 150.0)}
    spend = spark.sql("SELECT * FROM VALUES (1, '90', 'eur', DATE'2024-01-05'), (2, '96', 'EUR', DATE'2024-05-05'), (3, '5', 'USD', DATE'2024-01-05'), (4, '5', 'CHF', DATE'2024-01-05') t(id, amount, ccy, d)")
    out = {r.id: (r.status, round(r.converted, 6) if r.converted is not None else None) for r in normalise.convert(spend, "amount", "ccy", "d", rates).collect()}
    assert out == {1: ("converted", 100.0), 2: ("fallback", 100.0), 3: ("converted", 5.0), 4: ("unsupported_currency", None)}
    assert workbooks.fx_rates(workbooks.read_workbooks(spark, str(tmp_path)), "other.xlsx").count() == 0


def test_workbooks_in_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as archive:
        archive.writestr("in/a.xlsx", book())
        archive.writestr("b.csv", "x,y\n1,2\n")
    rows = files.read_archive(spark, str(tmp_path)).collect()
    assert {(r.file, r.sheet) for r in rows} == {("in/a.xlsx", "First"), ("in/a.xlsx", "Second"), ("b.csv", "")}


def test_put(spark, tmp_path):
    path = shipping.put(spark, f"{tmp_path}/x/y.bin", b"\x00\xffabc")
    assert (tmp_path / "x/y.bin").read_bytes() == b"\x00\xffabc" and path.endswith("y.bin")
