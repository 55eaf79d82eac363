"""Dashboards and levers, tags of values, header sheets, groups of a session."""

import re

from pyspark.sql import functions as F

from spendloom.functions import fields
from spendloom.operators import headers, insights, normalise, views
from spendloom.operators.session import Session
from spendloom.plans import spend


def test_registries(spark):
    assert (len(fields.DASHBOARDS), len(fields.LEVERS), len(fields.FIELD_NAMES)) == (22, 13, 33)
    assert {f for _, needs in (fields.DASHBOARDS | fields.LEVERS).values() for f in needs} <= {*fields.FIELD_NAMES}
    df = spark.createDataFrame([], "local_spend double, total_spend double, supplier string")
    found = {r["view"]: r for r in views.procurement_views(df).collect()}
    assert len(found) == 35 and found["size_of_prize"]["available"] and found["supplier_rationalization"]["missing"] == []
    assert found["lcc_sourcing"]["missing"] == ["Vendor Country"] and found["contract_status"]["missing"] == ["Contract End Date", "Contract ID", "Contract Start Date"]


def test_tags_at_their_thresholds(spark):
    rows = [("USD", "Germany", "H")] * 3 + [("x", "nowhere", "x")] * 7 + [(None, " ", None)] * 9
    found = {r["column"]: r["tags"] for r in insights.semantic_tags(spark.createDataFrame(rows, "a string, b string, `c.d` string"), ["a", "b", "c.d"]).collect()}
    assert found == {"a": ["currency_code"], "b": ["country_name"], "c.d": ["debit_credit"]}
    fewer = [("USD",)] * 29 + [("x",)] * 71
    assert insights.semantic_tags(spark.createDataFrame(fewer, "a string"), ["a"]).first()["tags"] == []
    assert insights.semantic_tags(spark.createDataFrame([], "a string"), ["a"]).count() == 0
    assert insights.semantic_tags(spark.createDataFrame([(None,)], "a string"), ["a"]).first()["tags"] == []


def test_header_sheet(spark):
    df = spark.createDataFrame([("1", None), ("2", "y")], "`a.b` string, c string")
    sheet = headers.decision_sheet(df, [{"source_col": "a.b", "action": "AUTO", "mapped_to": "supplier"}, {"source_col": "c"}])
    assert sheet == [["AUTO", "KEEP"], ["supplier", ""], ["a.b", "c"], ["1", ""], ["2", "y"]]
    edited = [["drop", "what", None, "AUTO"], ["", "x"], ["a", " c ", "d", ""]]
    assert headers.sheet_decisions(edited) == [
        {"source_col": "a", "action": "DROP", "mapped_to": None}, {"source_col": "c", "action": "KEEP", "mapped_to": "x"}, {"source_col": "d", "action": "KEEP", "mapped_to": None},
    ]
    assert headers.sheet_decisions([]) == []


def test_currency_code_column():
    names = ["Currency", "PO Local Currency Code", "local_currency_code"]
    assert headers.currency_code_column("Total Amount paid in Local Currency", names) == "local_currency_code"
    assert headers.currency_code_column("po total amount in local currency", names) == "PO Local Currency Code"
    assert headers.currency_code_column("Total Amount paid in Local Currency", ["Currency"]) == "Currency"
    assert headers.currency_code_column("Spend", names) is None and headers.currency_code_column(None, names) is None


def test_rewritten_dates(spark):
    df = spark.createDataFrame([("2024-03-01", 1), ("31/12/2023", 2), ("never", 3), (None, 4)], "d string, x int")
    out = normalise.rewritten_dates(df, "d", "yyyyMMdd")
    assert out.columns == ["d", "d_norm", "x"] and [r["d_norm"] for r in out.orderBy("x").collect()] == ["20240301", "20231231", "", ""]


def test_groups_of_a_session(spark):
    session = Session(spark, "groups")
    try:
        session.save("appended__a", spark.range(3))
        session.save("hn__b", spark.range(5).selectExpr("id", "id AS other"))
        session.save("plain", spark.range(9))
        found = session.group_schema()
        assert [(g["group"], g["rows"], g["preview"]) for g in found] == [("hn__b", 5, "id, other"), ("appended__a", 3, "id")]
    finally:
        session.close()


def test_fields_are_told_before_sides_meet(spark, sf_dir, tmp_path):
    """Joins for counts of usable rows move keys and bits, and blank names and missing dates count as before."""
    for name in ("lineitem", "orders", "part", "supplier", "nation", "region"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "supplier":
            df = df.withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).otherwise(F.col("s_name")))
        if name == "orders":
            df = df.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
        if name == "lineitem":
            df = df.withColumns({"l_discount": F.when(F.col("l_linenumber") != 2, F.col("l_discount")), "l_partkey": F.when(F.col("l_linenumber") != 4, F.col("l_partkey"))})
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    dims, registry = ("supplier", "part", "orders"), {v: needs for v, (_, needs) in (fields.DASHBOARDS | fields.LEVERS).items()} | {"tied": ["supplier", "po_document_date"], "terms": ["term", "l_linenumber"]}
    count = lambda df: sorted(tuple(r) for r in views.usable_rows(df, registry).collect())
    full, told = spend.spend(spark, str(tmp_path), *dims), spend.filled(spark, str(tmp_path), *dims)
    assert told.columns == full.columns and count(told) == count(full)
    assert len({r[3] for r in count(told)}) > 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(spend.filled(spark, str(tmp_path), *dims)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) > 5 and not re.search("l_extendedprice|l_shipdate|p_name|o_orderdate", " ".join(moved))
