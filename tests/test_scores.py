"""Scores of columns, appended rows counted as they pass, rows that a view can use."""

from spendloom.operators import assess, headers, matching, views


def test_scores(spark):
    df = spark.createDataFrame([("1", "a", None), ("2", "a", " "), ("2.0", "b", None), ("x", None, "")], "n string, t string, e string")
    got = {r.column: r for r in assess.analysis_scores(df).collect()}
    n = got["n"]
    assert (n.rows, n.non_null, n.distinct_values, n.numeric_ratio) == (4, 4, 3, 0.75)
    assert (n.quality, n.consistency, n.usability) == (92, 90, 91) and n.patterns == "mixed_numeric_text,high_fill"
    assert (got["t"].fill, got["t"].distinct_values, got["t"].inferred_type, got["t"].patterns) == (0.75, 2, "text", "mostly_text")
    assert (got["e"].non_null, got["e"].quality, got["e"].overall) == (0, 0, 58)
    assert assess.analysis_scores(df.limit(0)).count() == 0


def test_appended_rows_are_counted_as_they_pass(spark, tmp_path):
    tables = {"a": spark.createDataFrame([("x", 1), (None, 2)], "n string, k int"), "b": spark.createDataFrame([("y",)], "m string"), "none": spark.createDataFrame([], "n string")}
    got = {r.table: tuple(r)[1:] for r in matching.append_written(tables, {"a": {"n": "NAME", "k": "KIND"}, "b": {"m": "NAME"}, "none": {"n": "NAME"}}, ["NAME", "KIND"], str(tmp_path / "u")).collect()}
    assert got == {"a": (2, 2, 3, True), "b": (1, 1, 1, True), "none": (0, 0, 0, True)}
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3


def test_usable_rows(spark):
    df = spark.createDataFrame([("a", 1, None), (" ", 2, None), (None, 3, None)], "supplier string, total_spend int, region string")
    got = {r.view: (r.available, list(r.missing), r.rows) for r in views.usable_rows(df, {"one": ["supplier", "total_spend"], "two": ["total_spend"], "three": ["region"], "four": ["l1", "supplier"]}).collect()}
    assert got == {"one": (True, [], 1), "two": (True, [], 3), "three": (False, ["region"], 0), "four": (False, ["l1"], 0)}


def test_headers_by_the_values_of_a_table(spark):
    df = spark.createDataFrame([("EUR", "2024-01-05", "n"), ("USD", "2024-02-05", None)] * 20, "c1 string, c2 string, `Vendor Name` string")
    got = {r.header: (r.field, r.tier, r.filled) for r in headers.match_table(df).collect()}
    assert got == {"c1": ("currency", "values", 40), "c2": ("invoice_date", "values", 40), "Vendor Name": ("supplier", "alias", 20)}


def test_standard_fields_and_likeness():
    assert headers.standard_match(["x", "VENDOR", "supplier name", "Inv Due Date", "gl account description", " UOM "]) == {"supplier": "VENDOR", "invoice_due_date": "Inv Due Date", "description": "gl account description", "uom": " UOM "}
    assert headers.partial("terms", "payment terms of") == 1 and headers.partial("", "x") == 0
    found = {m.header: (m.field, m.tier) for m in headers.match_all(["the payment date is", "Vend Nm", "contract state", "GR Date", "vol1"])}
    assert found["the payment date is"] == ("payment_date", "fuzzy") and found["contract state"] == ("contract_status", "alias") and found["GR Date"] == ("goods_receipt_date", "alias")
    assert found["Vend Nm"] == ("supplier", "abbreviation") and found["vol1"][0] is None


def test_a_view_that_fails_as_it_runs_leaves_the_others(spark, tmp_path):
    df = spark.sql("SELECT DATE'2024-01-05' AS invoice_date, 2 AS total_spend, if(id = 1, raise_error('bad row'), 'x') AS supplier, 'DE' AS vendor_country FROM range(3)")
    found = views.write_views(df, ["spend_over_time", "supplier_ranking", "country_spend", "l1_spend"], str(tmp_path))
    assert isinstance(found["supplier_ranking"], Exception) and "bad row" in str(found["supplier_ranking"]) and isinstance(found["l1_spend"], Exception)
    assert spark.read.parquet(found["spend_over_time"]).count() == 1 and spark.read.parquet(found["country_spend"]).count() == 1
