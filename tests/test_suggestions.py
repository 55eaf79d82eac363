"""Suggested columns, approved headers, the typed union, all panels of a table, the country list."""

import pytest

from spendloom.operators import headers, normalise, panels, suggest, typed
from spendloom.plans import spend as S
from spendloom.sources import files


def test_suggested_columns(spark):
    rows = [("2024-01-0%d" % i, "USD", "$1,00%d" % i, "x") for i in range(1, 9)] + [(None, "", "", "x")]
    df = spark.createDataFrame(rows, "`Invoice Date` string, `Currency Code` string, `Total Spend` string, `amount note` string")
    found = {r["role"]: (r["column"], r["score"]) for r in suggest.suggest_columns(df).collect()}
    assert found == {"date": ("Invoice Date", 1.0), "currency": ("Currency Code", round(8 / 9, 3)), "spend": ("Total Spend", round(8 / 9 * 8 / 9 * 1.2, 3))}
    assert suggest.suggest_columns(df.limit(0)).count() == 0 and suggest.suggest_columns(df.select("amount note")).count() == 0


def test_header_decisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, c int, d int")
    out, learned = headers.apply_decisions(df, [{"source_col": "a.b", "action": "AUTO", "mapped_to": "supplier", "user_edited": True}, {"source_col": "c", "action": "DROP"}, {"source_col": "d", "action": "AUTO", "mapped_to": " "}])
    assert out.columns == ["supplier", "d"] and learned == {"a.b": "supplier"}
    with pytest.raises(ValueError):
        headers.apply_decisions(df, [{"source_col": "a.b", "action": "AUTO", "mapped_to": "D"}, {"source_col": "d"}])
    assert [headers.value_type(x) for x in (["2024-01-01", "x"], ["1,000", "2.5"], ["a"], [])] == ["date", "numeric", "text", "text"]


def test_typed_union(spark):
    a, b = spark.createDataFrame([("1", "2024-01-02"), ("x", "")], "m string, d string"), spark.createDataFrame([("7",)], "v string")
    rows, nulls = typed.build_all({"a": (a, {"m": "total_spend", "d": "invoice_date"}), "b": (b, {"v": "supplier"})})
    assert rows.count() == 3 and sorted(r["_source_table"] for r in nulls.collect()) == ["a", "b"]


def test_panels_and_files(spark, sf_dir, tmp_path):
    found = panels.quality_panels(S.spend(spark, sf_dir, "supplier", "part"))
    assert {"date_period", "bifurcation", "supplier", "non_procurable"} <= {*found} and "terms" not in found
    assert all(df.count() > 0 for name, df in found.items() if name != "non_procurable")
    assert files.write_all({"a/b": found["bifurcation"], "c": found["supplier"]}, str(tmp_path)) == ["a_b", "c"]
    assert spark.read.option("header", True).csv(str(tmp_path / "a_b")).count() == 1


def test_the_country_list(spark):
    codes = normalise.iso_codes()
    assert len(codes) > 490 and codes["CZ"] == codes["CZE"] == "Czech Republic" and codes["KR"] == "South Korea" and codes["UK"] == "United Kingdom"
    df = spark.createDataFrame([("PER",), ("tr",), ("S.A.",), ("Brazil",)], "c string")
    assert {r["c"]: r["country"] for r in normalise.countries(df, "c").collect()} == {"PER": "Peru", "tr": "Turkey", "S.A.": "Saudi Arabia", "Brazil": "Brazil"}
