"""The nine executive panels from one scan equal their single queries; fill rates of uploads as they were."""

import pytest
from pyspark.sql import functions as F

from spendloom.operators import panels, profile, typed
from spendloom.plans import spend


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def facts(spark, sf_dir):
    df = spend.spend(spark, sf_dir, "supplier", "part").select("invoice_date", "supplier", "description", "l_linenumber", (F.col("total_spend") * F.when(F.col("l_linenumber") == 3, -1).otherwise(1)).alias("total_spend"))
    blank = F.when(F.col("l_linenumber") == 5, F.lit(" ")).otherwise(F.col("description"))
    return df.withColumns({"description": blank, "supplier": F.when(F.col("l_linenumber") == 6, F.lit(None)).otherwise(F.col("supplier"))})


def test_panels_equal_their_single_queries(facts):
    names = ("invoice_date", "total_spend", "supplier", "description")
    got = panels.executive_panels(facts, *names)
    single = {
        "date_period": panels.date_period(facts, "invoice_date"), "supplier_breakdown": panels.supplier_breakdown(facts, "supplier", "total_spend"), "categorization_effort": panels.categorization_effort(facts, "supplier", "description"),
        "column_fill_rate": profile.fill_rates(facts, facts.columns, F.col("total_spend")), "date_pivot": panels.date_pivot(facts, "invoice_date", "total_spend"), "bifurcation": panels.bifurcation(facts, "total_spend"),
        "pareto": panels.pareto_thresholds(facts, "supplier", "total_spend", "description"), "description_quality": panels.description_stats(facts, "description"),
    }
    for name, want in single.items():
        assert rows(got[name]) == rows(want), name
    figures = {r.figure: r.value for r in got["spend_breakdown"].collect()}
    assert figures["last twelve months"] == panels.ltm(facts, "invoice_date", "total_spend").first()["ltm_spend"]
    years = {f"fy {r.fy}": r.total_spend for r in panels.fiscal_years(facts, "invoice_date", "total_spend").collect()}
    assert years.items() <= figures.items() and len(got) == 9


def test_one_scan(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "f"))
    cube = panels.summary_cube(spark.read.parquet(str(tmp_path / "f")), "invoice_date", "total_spend", "supplier", "description")
    assert cube._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["of"]: r["n"] for r in cube.groupBy("of").agg(F.count("*").alias("n")).collect()}["all"] == 1


def test_fill_of_uploads_as_they_were(spark):
    cells = [("2025-06-15", "1000", "A", "Detailed pump service", "filled"), ("2025-07-15", "100", "B", "Bolt", ""), ("2026-05-10", "-50", "C", "Credit", ""), ("2026-06-10", "200", "B", "Safety gloves", ""), ("2026-07-01", "10000", "A", "Motor replacement", "")]
    df = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cells)], "RECORD_ID string, `INVOICE DATE` string, `SPEND AMOUNT` string, `SUPPLIER NAME` string, DESCRIPTION string, `OPTIONAL FIELD` string")
    mapping = {"INVOICE DATE": "invoice_date", "SPEND AMOUNT": "total_spend"}
    got = {r.column_name: tuple(r)[1:] for r in typed.original_fill({"sample.csv": (df, mapping)}, {"INVOICE DATE": "Invoice Date", "OPTIONAL FIELD": "Optional Field"}).collect()}
    assert got["Invoice Date"] == ("INVOICE DATE", 0, 100.0, 100.0) and got["Optional Field"] == ("OPTIONAL FIELD", 4, 20.0, 8.9)
    other = spark.createDataFrame([("x", "50"), (None, None)], "DESCRIPTION string, COST string")
    both = {r.source_column: tuple(r)[2:] for r in typed.original_fill({"a": (df, mapping), "b": (other, {"COST": "total_spend"})}).collect()}
    assert both["DESCRIPTION"] == (3, 85.7, 100.0) and both["COST"] == (5, 14.3, 0.4) and both["OPTIONAL FIELD"] == (4, 14.3, 8.8)
    assert typed.original_fill({"a": (df.limit(0), mapping)}).collect() == []


def test_pairs_meet_before_they_are_counted(spark, facts, tmp_path):
    """Tasks that count pairs hold the pairs of their own rows alone: rows are dealt out by pair before the first count, a hot pair to several tasks."""
    cube = panels.summary_cube(facts, "invoice_date", "total_spend", "supplier", "description")
    plan = cube._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Expand") < plan.index("RebalancePartitions [_s"), plan
    odd = spark.createDataFrame([("nan", float("nan"), 1.0, "A", " "), (None, 2.0, 2.0, "tbd", "x"), (" ", None, None, None, "x")], "w string, d double, v double, s string, t string").withColumn("day", F.lit("2024-02-29").cast("date"))
    fills = panels.executive_panels(odd, "day", "v", "s", "t")["column_fill_rate"]
    assert rows(fills) == rows(profile.fill_rates(odd, odd.columns, F.col("v")))
