"""Operators of the spend engine on small inputs with known answers."""

import datetime
import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import dates
from spendloom.operators import assess, clean, headers, matching, normalise, panels, profile, running, typed, views
from spendloom.operators.session import Session
from spendloom.sources import files
from spendloom.streaming import spend as stream

ROWS = [("2025-06-15", 1000.0, "A", "Detailed pump service"), ("2025-07-15", 100.0, "B", "Bolt"), ("2026-05-10", -50.0, "C", "Credit"), ("2026-06-10", 200.0, "B", "Safety gloves"), ("2026-07-01", 10000.0, "A", "Motor replacement")]


@pytest.fixture(scope="module")
def spend(spark):
    df = spark.createDataFrame(ROWS, "invoice_date string, total_spend double, supplier string, description string")
    return df.withColumn("invoice_date", F.to_date("invoice_date"))


def test_last_twelve_months_leave_the_latest_out(spend):
    row = panels.ltm(spend, "invoice_date", "total_spend").first()
    assert row["ltm_spend"] == 250.0 and row["from_month"] == 2025 * 12 + 7 and row["to_month"] == 2026 * 12 + 6
    assert panels.latest_full_year(spend, "invoice_date", "total_spend").count() == 0


def test_full_year(spark):
    rows = [(f"2024-{m:02d}-15", 100.0) for m in range(1, 13)] + [("2026-01-15", 50.0)]
    df = spark.createDataFrame(rows, "d string, s double").withColumn("d", F.to_date("d"))
    assert tuple(panels.latest_full_year(df, "d", "s").first()) == (2024, 1200.0)


def test_suppliers_and_bifurcation(spend):
    row = panels.supplier_breakdown(spend, "supplier", "total_spend").first()
    assert (row["suppliers"], row["reach_80"]) == (3, 1)
    row = panels.bifurcation(spend, "total_spend").first()
    assert (row["positive"], row["negative"], row["net"]) == (11300.0, -50.0, 11250.0)


def test_fill_and_coverage(spark, spend):
    df = spend.withColumn("optional", F.when(F.col("total_spend") == 1000, "filled").otherwise(""))
    row = profile.fill_rates(df, ["optional"], F.col("total_spend")).first()
    assert row["fill_pct"] == 20.0 and round(row["spend_pct"], 1) == 8.9


def test_header_pick(spark):
    raw = spark.createDataFrame([(0, "note row", None, None), (1, "Item", "Qty", "Price"), (2, "Widget", "10", "2.50"), (3, "", " ", None), (4, "Gizmo", "5", "1.99")], "_pos long, RAW_1 string, RAW_2 string, RAW_3 string")
    out = clean.pick_header(raw, 1)
    assert [tuple(r) for r in out.orderBy("RECORD_ID").select("RECORD_ID", "ITEM", "QTY", "PRICE").collect()] == [(1, "WIDGET", "10", "2.50"), (2, "GIZMO", "5", "1.99")]
    with pytest.raises(ValueError, match="shape mismatch"):
        clean.pick_header(raw, 1, ["A", "B"])
    with pytest.raises(ValueError):
        clean.pick_header(raw, 9)
    assert clean.unique_headers(["a", "A", None, " b  c "]) == ["A", "A_2", "COLUMN_3", "B C"]


def test_whole_clean_chain(spark):
    df = spark.createDataFrame([(0, " a ", "", "x"), (1, "A", None, "y"), (2, " ", "", None), (3, "b", " ", "z")], "_pos long, k string, empty string, other string")
    out = clean.clean_table(df, keys=["k"])
    assert sorted(map(tuple, out.select("_pos", "k", "other").collect())) == [(0, "A", "X"), (3, "B", "Z")] and "empty" not in out.columns


@pytest.mark.parametrize(
    ("raw", "order", "want"),
    [
        ("2024-03-05", "DMY", "2024-03-05"), ("05/03/2024", "DMY", "2024-03-05"), ("05/03/2024", "MDY", "2024-05-03"), ("5.3.24", "DMY", "2024-03-05"), ("20240305", "MDY", "2024-03-05"),
        ("45734", "DMY", "2025-03-18"), ("5-Mar-2024", "MDY", "2024-03-05"), ("March 5th, 2024", "DMY", "2024-03-05"), ("2024", "DMY", "2024-01-01"), ("Mar 2024", "DMY", "2024-03-01"), ("5 Mar", "DMY", "2020-03-05"),
        ("2024-03-05T10:11:12Z", "DMY", "2024-03-05"), ("05/03/2024 10:11", "DMY", "2024-03-05"), ("31/02/2024", "DMY", None), ("n/a", "DMY", None), ("", "DMY", None), (None, "DMY", None), ("99999", "DMY", None),
    ],
)
def test_dates(spark, raw, order, want):
    df = spark.createDataFrame([(raw,)], "x string").select(dates.parse("x", order, 2020).alias("d"))
    got = df.first()["d"]
    assert (got and str(got)) == want


def test_dates_round_trip(spark):
    days = [datetime.date(1999, 12, 28) + datetime.timedelta(days=i) for i in range(0, 12_000, 37)]
    rows = [(d.strftime(f), d) for d in days for f in ("%Y-%m-%d", "%d.%m.%Y", "%d-%b-%Y", "%d %B %Y", "%Y%m%d")]
    df = spark.createDataFrame(rows, "x string, d date")
    assert df.where(~dates.parse("x").eqNullSafe(F.col("d"))).count() == 0


def test_votes(spark):
    df = spark.createDataFrame([("a", "13/01/2024"), ("a", "01/02/2024"), ("b", "01/13/2024"), ("b", "Jan 5 2024"), ("c", "20240113"), (None, "13/01/2024")], "f string, x string")
    found = {r["file"]: (r["dmy"], r["mdy"], r["date_order"]) for r in normalise.dmy_votes(df, "x", "f").collect()}
    assert found == {"a": (1, 0, "DMY"), "b": (0, 2, "MDY"), "c": (0, 0, "DMY")}
    parsed = {(r["f"], r["x"]): r["p"] for r in normalise.dates_by_file(df, "x", "f", "p").collect()}
    assert parsed["b", "01/13/2024"] == datetime.date(2024, 1, 13) and parsed[None, "13/01/2024"] is None


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_running_totals(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    got = {r["id"]: (r["rank"], r["cumulative"]) for r in running.running(df, "v", "id", 7).collect()}
    total, want = 0, {}
    for rank, (i, v) in enumerate(sorted(enumerate(values), key=lambda x: (-x[1], x[0])), 1):
        want[i] = (rank, total := total + v)
    assert got == want


def test_empty_tables(spark, spend):
    none = spend.limit(0)
    assert views.pareto(none, "supplier", "total_spend").count() == 0 and profile.column_stats(none, ["supplier"]).count() == 0
    assert running.running(none, "total_spend", "supplier").count() == 0 and panels.ltm(none, "invoice_date", "total_spend").first()["ltm_spend"] == 0


def test_merge_keeps_the_base(spark):
    base = spark.createDataFrame([(1, " A ", 0), (2, "a", 0), (3, None, 0), (4, "z", 0)], "id long, k string, v int")
    source = spark.createDataFrame([(2, "A", "second"), (1, "a", "first"), (3, " ", "blank"), (4, None, "null")], "o long, k string, v string")
    out = matching.merge(base, source, [("k", "k")], ["v"], "o")
    assert sorted((r["id"], r["v_source"]) for r in out.collect()) == [(1, "first"), (2, "first"), (3, None), (4, None)]
    plan = matching.simulate(base, source, [("k", "k")]).first()
    assert (plan["base_rows"], plan["matched_rows"], plan["joined_rows"]) == (3, 2, 4) or plan["matched_rows"] == 2


def test_converted_amounts(spark):
    df = spark.createDataFrame([("(1,000.00)", "eur", "2024-01-10"), ("10", "", "2024-01-10"), ("x", "EUR", "2024-01-10"), ("10", "ABC", None), ("10", "ABC", "2024-01-10"), ("10", "EUR", "2030-01-01"), ("10", "usd", None)], "a string, c string, d string").withColumn("d", F.to_date("d"))
    rates = spark.createDataFrame([("EUR", 2024, 1, 0.5), ("EUR", 2024, 2, 0.8)], "currency string, year int, month int, rate double")
    out = [(r["status"], r["converted"]) for r in normalise.convert(df, "a", "c", "d", rates).collect()]
    assert sorted(out, key=str) == sorted([("converted", -2000.0), ("currency_missing", None), ("spend_invalid", None), ("date_unparseable", None), ("unsupported_currency", None), ("fallback", 12.5), ("converted", 10.0)], key=str)


def test_column_functions(spark):
    df = spark.createDataFrame([("Acme Inc., Ltd",), ("  S.A. ",), ("foo.com GmbH",)], "x string").select(C.supplier_name("x"))
    assert [r[0] for r in df.collect()][0] == "Acme" and [r[0] for r in df.collect()][2] == "foo"
    keys = spark.createDataFrame([("00123",), ("123.0",), ("2024-01-15",), (" Ab ",)], "x string").select(C.match_key("x"))
    a, b, c, d = (r[0] for r in keys.collect())
    assert a == b and (c, d) == ("2024-01-15", "ab")
    wide = spark.createDataFrame([("7",), ("12345",), ("x7",)], "x string").select(C.pad("x", 3))
    assert [r[0] for r in wide.collect()] == ["007", "345", "x7"]


def test_headers():
    found = {m.header: m for m in headers.match_all(["Invoice Date", "VendorName", "WAERS", "Unnamed: 3", "qqqq"])}
    assert [found[h].field for h in found] == ["invoice_date", "supplier", "currency", None, None] and found["Unnamed: 3"].tier == "drop"
    assert headers.match_header("xx", ["USD", "EUR"]).field == "currency" and headers.resolve(["Supplier", "vendor name", "zz"], "supplier") == ["Supplier", "vendor name"]
    assert headers.match_header("kreditor", learned=headers.learn({}, "Kreditor", "supplier")).field == "supplier"
    assert views.available_views({"supplier", "total_spend"}) == ["supplier_ranking", "pareto"]
    assert matching.plan_append({"a": ["x", "y"], "b": ["X", "Y", "z"], "c": ["q"]}) == [["b", "a"], ["c"]]


def test_typed(spark):
    df = spark.createDataFrame([("$1,200", "2024-01-01", " x "), ("bad", "n/a", "nan"), (None, None, None)], "a string, d string, s string")
    mapping = {"a": "total_spend", "d": "invoice_date", "s": "supplier"}
    rows = typed.build(df, mapping).collect()
    assert (rows[0]["total_spend"], str(rows[0]["invoice_date"]), rows[0]["supplier"], rows[1]["supplier"], rows[2]["supplier"]) == (1200.0, "2024-01-01", "x", "", "")
    assert {r["field"]: (r["given"], r["valid"]) for r in typed.report(df, mapping).collect()}["total_spend"] == (2, 1)
    assert typed.null_rows(typed.build(df, mapping)).count() == 2


def test_archive_and_csv(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.csv", "a,b\n1,2\n")
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr("one.csv", 'h1,h2\n"x, y",\nshort\n')
        z.writestr("in.zip", inner.getvalue())
        z.writestr("__MACOSX/one.csv", "junk")
        z.writestr("notes.txt", "text")
        z.writestr("bad.zip", b"no archive")
    rows = files.read_archive(spark, str(tmp_path / "up.zip")).persist()
    assert {r["file"] for r in rows.where("warning is null").collect()} == {"one.csv", "in.zip/deep.csv"}
    assert {r["file"] for r in rows.where("warning is not null").collect()} == {"notes.txt", "bad.zip"}
    table = clean.pick_header(files.table_of(rows, "one.csv"), 0)
    assert sorted(map(tuple, table.select("H1").collect())) == [("SHORT",), ("X, Y",)]
    (tmp_path / "t.csv").write_text('k,v\n1,\n2,"multi\nline"\n')
    raw = files.numbered(files.read_csv(spark, str(tmp_path / "t.csv")))
    assert [(r["_pos"], r["_c0"], r["_c1"]) for r in raw.orderBy("_pos").collect()] == [(0, "k", "v"), (1, "1", ""), (2, "2", "multi\nline")]
    files.write_csv(raw.drop("FILE_NAME"), str(tmp_path / "out"), one_file=True)
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "out")).count() == 3


def test_session(spark, spend):
    session = Session(spark, "my-session")
    session.save("a-b", spend)
    session.save("a_b", spend.limit(1))
    assert session.read("a-b").count() == 5 and session.read("a_b").count() == 1 and session.names() == ["a-b", "a_b"]
    with pytest.raises(KeyError):
        session.drop("a-b", "missing")
    assert session.exists("a-b")
    assert [session.save_version("final", spend), session.save_version("final", spend.limit(2))] == [1, 2] and session.latest("final").count() == 2
    session.close()
    with pytest.raises(ValueError):
        Session(spark, "bad name")


def test_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    schema.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema.schema).parquet(str(tmp_path / "in"))
    query = stream.windowed(source, "ts", "event_type", "value").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("win").agg(F.sum("n")).first()[0] == schema.count()


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as entry

    assert {"pareto_80", "supplier_ranking"} <= {*entry.queries()} and {*entry.oracle_sql()} <= {*entry.queries()}


def test_populated_of_blank_cells_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), (" ", "x"), (None, "y"), ("b", "z"), ("c", "")], "p string, q string")
    assert {tuple(r) for r in assess.populated(df, ["p", "q"]).collect()} == {("p", 3, 5, 60.0, False), ("q", 3, 5, 60.0, False)}
    assert {tuple(r) for r in assess.populated(df.limit(0), ["p"]).collect()} == {("p", 0, 0, 0.0, True)}


def test_currency_quality_counts_blank_codes_in_the_whole_only(spark):
    df = spark.createDataFrame([(" usd", 1.0, 9.0), ("USD", 1.0, 1.0), ("EUR", 2.0, 5.0), ("GBP", 3.0, None), ("", 7.0, 7.0), (None, 7.0, 7.0)], "c string, l double, r double")
    got = {tuple(r) for r in assess.currency_quality(df, "c", "l", "r", 2).collect()}
    assert got == {("USD", 2, 33.33, 2.0, 10.0), ("EUR", 1, 16.67, 2.0, 5.0), ("Others", 1, 16.67, 3.0, None)}


def test_overlap_of_tables(spark):
    a = spark.createDataFrame([("007", "x"), ("8", None), ("8", "y")], "Id string, name string")
    b = spark.createDataFrame([(7.0, 1), (9.0, 2)], "` id` double, other int")
    none = spark.createDataFrame([("q",)], "lone string")
    assert [tuple(r) for r in assess.table_overlap({"a": a, "b": b, "none": none}).collect()] == [("a", "b", 1, 0.5, 0.5)]
    assert assess.table_overlap({"a": a, "none": none}).count() == 0
    assert assess.schema_consistency([["A", "b"], ["a "], ["c"]]) == pytest.approx(1 / 6) and assess.schema_consistency([["a"]]) == 1.0
