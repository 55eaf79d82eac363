"""Files with ragged rows and equal names, rates that repeat, columns of clashing names, keys in several formats."""

import time

import pytest
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import constants
from spendloom.operators import clean, insights, matching, normalise
from spendloom.sources import files


@pytest.mark.parametrize("multiline", [True, False])
def test_rows_wider_than_the_first_keep_their_cells(spark, tmp_path, multiline):
    (tmp_path / "a.csv").write_text('note\nItem,Qty,Price\nW,10,2.5\n"x, y",1\n')
    raw = files.numbered(files.read_csv(spark, str(tmp_path / "a.csv"), multiline=multiline)).drop("FILE_NAME", "FILE_PATH")
    rows = [tuple(r) for r in raw.select("_c0", "_c1", "_c2").orderBy("_pos").collect()]
    assert rows == [("note", "", ""), ("Item", "Qty", "Price"), ("W", "10", "2.5"), ("x, y", "1", "")]
    assert raw.columns[:3] == ["_c0", "_c1", "_c2"] and clean.header_row(raw) == 1
    table = clean.pick_header(raw, clean.header_row(raw))
    assert [tuple(r) for r in table.select("ITEM", "PRICE").orderBy("RECORD_ID").collect()] == [("W", "2.5"), ("X, Y", None)]


def test_files_of_one_name_are_numbered_apart(spark, tmp_path):
    for folder, n in (("a", 3), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("".join(f"{folder}{i},1\n" for i in range(n)))
    raw = files.numbered(files.read_csv(spark, str(tmp_path / "*")))
    assert sorted((r["_c0"], r["_pos"]) for r in raw.collect()) == [("a0", 0), ("a1", 1), ("a2", 2), ("b0", 0), ("b1", 1)]
    rows = files.read_archive(spark, str(tmp_path / "*"))
    paths = [r["path"] for r in rows.select("path").distinct().orderBy("path").collect()]
    assert [files.table_of(rows, "x.csv", path=p).count() for p in paths] == [3, 2]


def test_an_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert files.numbered(files.read_csv(spark, str(tmp_path / "e.csv"))).count() == 0


def test_conversion_keeps_columns_and_rows(spark):
    rates = spark.createDataFrame([("EUR", 2024, 1, 0.5)] * 3, "currency string, year int, month int, rate double")
    df = spark.createDataFrame([("10", "EUR", "t", "mine", "old")], "a string, c string, _source_table string, _rate string, status string")
    out = normalise.convert(df.withColumn("d", F.lit("2024-01-15").cast("date")), "a", "c", "d", rates)
    row = out.collect()
    assert len(row) == 1 and out.columns == ["a", "c", "_source_table", "_rate", "d", "status", "fx_rate", "converted"]
    assert (row[0]["_source_table"], row[0]["_rate"], row[0]["status"], row[0]["converted"]) == ("t", "mine", "converted", 20.0)


def test_overridden_rates(spark):
    rates = spark.createDataFrame([("EUR", 2023, 1, 0.5), ("EUR", 2024, 1, 0.6), ("GBP", 2024, 1, 0.7)], "currency string, year int, month int, rate double")
    own = spark.createDataFrame([("EUR", 2024, 2, 0.9), ("GBP", None, None, 0.8), ("AED", None, None, 4.0)], "currency string, year int, month int, rate double")
    df = spark.createDataFrame([("EUR", "2024-02-01"), ("EUR", "2023-01-05"), ("EUR", "2020-01-01"), ("GBP", "2024-01-01"), ("GBP", "2020-01-01"), ("AED", "2024-01-01")], "c string, d string")
    df = df.withColumns({"d": F.col("d").cast("date"), "a": F.lit("72")})
    found = [(r["c"], r["status"], r["fx_rate"]) for r in normalise.convert(df, "a", "c", "d", normalise.override_rates(rates, own)).orderBy("c", "d").collect()]
    assert found == [("AED", "fallback", 4.0), ("EUR", "unsupported_currency", None), ("EUR", "converted", 0.5), ("EUR", "converted", 0.9), ("GBP", "fallback", 0.8), ("GBP", "converted", 0.8)]


def test_countries_of_a_column_named_country(spark):
    df = spark.createDataFrame([("us",), ("Atlantis",), (None,)], "country string")
    assert {(r["country"], r["normalized_via"]) for r in normalise.countries(df, "country").collect()} == {("United States", "ISO Lookup"), (None, "")}
    assert normalise.countries(df, "country", into="norm").columns == ["country", "norm", "normalized_via"]


def test_keep_first_of_rows_without_an_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3)], "k string, _pos long, x int")
    assert sorted((r["k"], r["x"]) for r in clean.dedup_keep_first(df, ["k"]).collect()) == [("a", 2), ("b", 3)]


def test_key_formats(spark):
    side = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    kind = lambda a, b: matching.key_format(a, "k", b, "k")[0]
    assert kind(side("V-1", "V-2", "V-30"), side("1", "2", "30")) == "prefix"
    assert kind(side("001", "020"), side("1", "20")) == "zeros"
    assert kind(side("a-1", "b-2"), side("a_1", "c_2")) == "separator"
    assert kind(side("x", "y"), side("x", "z")) == "none" and kind(side(), side("1")) == "none"
    found = matching.formatted_overlap(side("001", "020", "7"), "k", side("1", "20"), "k").where("keys = 'made equal'").first()
    assert (found["left_distinct"], found["right_distinct"], found["shared"], found["format"]) == (3, 2, 2, "zeros")


def test_years_labels_and_places(spark):
    df = spark.createDataFrame([("paid in 1999, not 2001", 1), ("18 of 1850", 2), (None, 3)], "t string, n int")
    assert [r[0] for r in df.select(insights.year_of("t")).collect()] == [1999, None, None]
    assert df.select(insights.month_label(F.lit(1997 * 12 + 12))).first()[0] == "Dec 1997"
    assert clean.place_after(df, "t", "u.x", F.col("n")).columns == ["t", "u.x", "n"] and clean.place_after(df, "t", "n", F.lit(1)).columns == ["t", "n"]


def test_payment_terms(spark):
    terms = ["Net_30", "n45", "N 45", "D60", "15 Days", "7", "C.O.D.", "Due on receipt", "2/10 N30", "3%15 net-60", "soon", "", None, "c.i.a."]
    got = [(r["x"]["days"], r["x"]["discount"]) for r in spark.createDataFrame([(t,) for t in terms], "t string").select(C.payment_term("t").alias("x")).collect()]
    want = ["30", "45", None, "60", "15", "7", "0", "0", "30", "60", None, None, None, "0"]
    assert [d for d, _ in got] == want and got[8][1] == "2% discount if paid within 10 days" and got[9][1] == "3% discount if paid within 15 days" and got[13][1] == "Cash in advance"


@pytest.mark.parametrize("multiline", [True, False])
def test_commas_in_a_cell_make_no_columns(spark, tmp_path, multiline):
    (tmp_path / "c.csv").write_text('a,b,c\n1,"' + "x," * 100_000 + '",3\n4,5,6,7\n8\n')
    start = time.perf_counter()
    got = files.read_csv(spark, str(tmp_path / "c.csv"), multiline)
    rows = got.orderBy("_place").collect()
    assert got.columns[:4] == ["_c0", "_c1", "_c2", "_c3"] and len([c for c in got.columns if c.startswith("_c")]) == 4
    assert [len(r[1]) for r in rows] == [1, 200_000, 1, 0] and rows[2][3] == "7" and rows[3][0] == "8"
    assert time.perf_counter() - start < 20


def test_cells_over_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "m.csv").write_text('a,b\n1,"one, two\nthree, four\nfive",6,7\n')
    rows = files.read_csv(spark, str(tmp_path / "m.csv")).orderBy("_place").collect()
    assert [list(r)[:4] for r in rows] == [["a", "b", "", ""], ["1", "one, two\nthree, four\nfive", "6", "7"]]
    monkeypatch.setattr(files, "WHOLE", 3)
    wide = files.read_csv(spark, str(tmp_path / "m.csv"))
    assert [list(r)[:4] for r in wide.orderBy("_place").collect()] == [list(r)[:4] for r in rows]


def test_terms_that_stay_doubtful(spark):
    known = {"Net 30": ("30", ""), "net-_45": ("45", ""), "N60": ("60", ""), "d 7": None, "D7": ("7", ""), "15 day": ("15", ""), "C.O.D.": ("0", ""), "c.i.a": ("0", "Cash in advance"), "Due on  receipt": ("0", ""), "2/10 net 30": ("30", "2% discount if paid within 10 days")}
    doubtful = ["N et 30", "C O D", "30 d a y s", "2 % 10 net 30", "Cash.", "d 7"]
    df = spark.createDataFrame([(t,) for t in [*known, *doubtful, "none", " ", None]], "t string")
    got = {r.t: (r.term_days, r.term_discount, r.term_doubt) for r in normalise.payment_terms(df, "t").collect()}
    assert all(got[t] == (None, "", True) for t in doubtful)
    assert all(got[t] == (*v, False) for t, v in known.items() if v)
    assert got["none"] == got[" "] == got[None] == (None, "", False)


def test_other_spellings_of_countries(spark):
    df = spark.createDataFrame([(s.title() if i % 2 else s,) for i, s in enumerate(constants.COUNTRY_ALIASES)], "c string")
    got = {r.c.upper(): r.country for r in normalise.countries(df, "c").collect()}
    assert got == constants.COUNTRY_ALIASES


def test_repeated_dates_are_parsed_once(spark):
    from datetime import date

    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "03/04/2020" if i % 3 else "25/12/2021") for i in range(12)] + [(12, None, "03/04/2020"), (13, "c", "04/25/2020"), (14, "c", "03/04/2020"), (15, "a", None), (16, "a", "none")], "i int, f string, x string")
    got = normalise.dates_by_file(df.withColumn("p", F.lit("old")), "x", "f", "p")
    # the rows themselves are only joined: no part of a date is cut out of each
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0] and got.columns == ["i", "f", "x", "p"]
    want = {i: date(2020, 4, 3) if i % 3 else date(2021, 12, 25) for i in range(12)} | {12: None, 13: date(2020, 4, 25), 14: date(2020, 3, 4), 15: None, 16: None}
    assert {r["i"]: r["p"] for r in got.collect()} == want and got.count() == 17
