"""All registered queries of the spend engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import dates, fields
from spendloom.operators import assess, clean, headers, insights, matching, normalise, panels, profile, running, suggest, typed, views
from spendloom.plans import intake
from spendloom.plans import spend as S
from spendloom.plans.messy import MESSY, RATE_SQL, messy, rates, typed_names
from spendloom.plans.spend import BASE, dbl, pct, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _on_spend(*dims: str):
    return lambda f: lambda spark, sf: f(S.spend(spark, sf, *dims))


# Views -------------------------------------------------------------------------------------
_MONTHS = BASE + ", mo AS (SELECT year(invoice_date)::INT AS year, month(invoice_date)::INT AS month, sum(total_spend) AS spend FROM b GROUP BY ALL)"
_TIME = {
    "monthly": f"SELECT year, month, {dbl('spend')} AS total_spend FROM mo",
    "yearly": f"SELECT year, {dbl('sum(spend)')} AS total_spend FROM mo GROUP BY year",
    "last12": f"SELECT year, month, {dbl('spend')} AS total_spend FROM mo WHERE year * 12 + month > (SELECT max(year * 12 + month) FROM mo) - 12",
}
for _grain, _sql in _TIME.items():
    _add(f"spend_over_time_{_grain}", _on_spend()(lambda b, g=_grain: views.spend_over_time(b, "invoice_date", "total_spend", g)), _MONTHS + _sql)

_RANKED = """, per AS (SELECT supplier, sum(total_spend) AS spend FROM b GROUP BY supplier),
r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, supplier) AS rank, sum(spend) OVER (ORDER BY spend DESC, supplier ROWS UNBOUNDED PRECEDING) AS cum, sum(spend) OVER () AS total FROM per)
"""
_add("supplier_ranking", _on_spend("supplier")(lambda b: views.supplier_ranking(b, "supplier", "total_spend")), BASE + _RANKED + f"SELECT rank, supplier, {dbl('spend')} AS total_spend, {pct('spend', 'total')} AS pct_of_total FROM r")
_CUT = "WHERE rank <= (SELECT min(rank) FROM r WHERE cum::DOUBLE >= total::DOUBLE * ({} / 100.0::DOUBLE))"
_add("pareto_80", _on_spend("supplier")(lambda b: views.pareto(b, "supplier", "total_spend")), BASE + _RANKED + f"SELECT rank, supplier, {dbl('spend')} AS total_spend, {pct('cum', 'total', 4)} AS cumulative_pct FROM r {_CUT.format(80)}")
_add(
    "pareto_thresholds", _on_spend("supplier", "part")(lambda b: panels.pareto_thresholds(b, "supplier", "total_spend", "description")),
    BASE + f""", pair AS (SELECT supplier, description, sum(total_spend) AS spend, count(*) AS n FROM b WHERE total_spend > 0 GROUP BY ALL),
per AS (SELECT supplier, sum(spend) AS spend, sum(n) AS n, count(*) AS pairs FROM pair GROUP BY supplier),
r AS (SELECT *, sum(spend) OVER (ORDER BY spend DESC, supplier ROWS UNBOUNDED PRECEDING) AS cum, sum(spend) OVER () AS total FROM per)
SELECT p::INT AS percent, count(*) AS suppliers, {dbl('sum(spend)')} AS total_spend, sum(n)::BIGINT AS transactions, sum(pairs)::BIGINT AS pairs
FROM r, (VALUES (80), (85), (90), (95)) t(p) WHERE cum::DOUBLE - spend::DOUBLE < total::DOUBLE * (p / 100.0::DOUBLE) GROUP BY p""",
)
for _name, _key, _dim, _amount in (("currency_spend", "currency", "supplier", "local_spend"), ("country_spend", "vendor_country", "supplier", "total_spend"), ("region_spend", "region", "supplier", "total_spend"), ("l1_spend", "l1", "part", "total_spend")):
    _add(
        _name, _on_spend(_dim)(lambda b, k=_key, a=_amount: views.share_by(b, k, a)),
        BASE + f"SELECT {_key} AS key, {dbl(f'sum({_amount})')} AS total_spend, {pct(f'sum({_amount})', f'sum(sum({_amount})) OVER ()')} AS pct_of_total FROM b GROUP BY {_key}",
    )
for _name, _a, _b in (("mekko_l1_l2", "l1", "l2"), ("mekko_l2_l3", "l2", "l3")):
    _add(
        _name, _on_spend("part")(lambda b, x=_a, y=_b: views.mekko(b, x, y, "total_spend")),
        BASE + f""", p AS (SELECT {_a} AS "column", {_b} AS segment, sum(total_spend) AS spend FROM b GROUP BY ALL), w AS (SELECT *, sum(spend) OVER (PARTITION BY "column") AS c, sum(spend) OVER () AS t FROM p)
SELECT "column", segment, {dbl('spend')} AS total_spend, {pct('c', 't')} AS width_pct, {pct('spend', 'c')} AS segment_pct FROM w""",
    )
_add(
    "category_drilldown", _on_spend("part")(lambda b: views.drilldown(b, ["l1", "l2", "l3"], "total_spend")),
    BASE + f""", t AS (SELECT l1, l2, l3, sum(total_spend) AS spend, (3 - grouping(l1) - grouping(l2) - grouping(l3))::INT AS depth FROM b GROUP BY ROLLUP (l1, l2, l3)),
p AS (SELECT *, sum(spend) OVER (PARTITION BY depth, CASE WHEN depth > 1 THEN l1 END, CASE WHEN depth > 2 THEN l2 END) AS parent, (SELECT spend FROM t WHERE depth = 0) AS total FROM t)
SELECT l1, l2, l3, depth, {dbl('spend')} AS total_spend, {pct('spend', 'parent')} AS pct_of_parent, {pct('spend', 'total')} AS pct_of_total FROM p""",
)

# Panels ------------------------------------------------------------------------------------
_BALANCE = "customer"
_SIGNED = "SELECT {k} {pos} AS positive, {neg} AS negative, {net} AS net, count(*) AS rows FROM customer {g}"
_PARTS = {"pos": dbl("sum(CASE WHEN c_acctbal > 0 THEN c_acctbal::DECIMAL(18,2) END)"), "neg": dbl("sum(CASE WHEN c_acctbal < 0 THEN c_acctbal::DECIMAL(18,2) END)"), "net": dbl("sum(c_acctbal::DECIMAL(18,2))")}
_balance = lambda spark, sf: table(spark, sf, _BALANCE).withColumn("balance", S.money("c_acctbal"))
_add("spend_bifurcation", lambda spark, sf: panels.bifurcation(_balance(spark, sf), "balance"), _SIGNED.format(k="", g="", **_PARTS))
_add("spend_bifurcation_by_unit", lambda spark, sf: panels.bifurcation(_balance(spark, sf), "balance", "c_mktsegment"), _SIGNED.format(k="c_mktsegment AS key,", g="GROUP BY c_mktsegment", **_PARTS))
_add("date_period", _on_spend()(lambda b: panels.date_period(b, "invoice_date")), BASE + "SELECT min(invoice_date)::DATE AS first_date, max(invoice_date)::DATE AS last_date, count(DISTINCT year(invoice_date) * 12 + month(invoice_date)) AS months FROM b")
_add(
    "ltm_spend", _on_spend()(lambda b: panels.ltm(b, "invoice_date", "total_spend")),
    _MONTHS + f", x AS (SELECT max(year * 12 + month) AS hi FROM mo) SELECT {dbl('sum(spend)')} AS ltm_spend, max(hi) - 12 AS from_month, max(hi) - 1 AS to_month FROM mo, x WHERE year * 12 + month BETWEEN hi - 12 AND hi - 1",
)
_add(
    "fy_yoy", _on_spend()(lambda b: panels.fiscal_years(b, "invoice_date", "total_spend")),
    _MONTHS + f""", y AS (SELECT year AS fy, sum(spend) AS s, count(*) AS months FROM mo GROUP BY year)
SELECT a.fy, a.months, {dbl('a.s')} AS total_spend, round((a.s::DOUBLE - p.s::DOUBLE) / nullif(p.s::DOUBLE, 0) * 100, 2) AS yoy_pct FROM y a LEFT JOIN y p ON p.fy + 1 = a.fy""",
)
_add("latest_full_year", _on_spend()(lambda b: panels.latest_full_year(b, "invoice_date", "total_spend")), _MONTHS + f"SELECT year, {dbl('sum(spend)')} AS total_spend FROM mo GROUP BY year HAVING count(*) = 12 ORDER BY year DESC LIMIT 1")
_add("top80_vendor_cohort", _on_spend("supplier")(lambda b: panels.cohort(b, "supplier", "total_spend").select("supplier", "rank", F.round(F.col("spend").cast("double"), 2).alias("total_spend"))), BASE + _RANKED + f"SELECT supplier, rank, {dbl('spend')} AS total_spend FROM r {_CUT.format(80)}")
_add(
    "supplier_breakdown", _on_spend("supplier")(lambda b: panels.supplier_breakdown(b, "supplier", "total_spend")),
    BASE + _RANKED + f"""SELECT count(*) AS suppliers, (SELECT count(*) FROM r {_CUT.format(80)}) AS reach_80, 0::BIGINT AS case_variants, {pct('sum(CASE WHEN rank <= 10 THEN spend END)', 'sum(spend)')} AS top10_pct FROM r""",
)
_add(
    "duplicate_name_variants", lambda spark, sf: panels.name_variants(table(spark, sf, "supplier").withColumn("name", F.when(F.col("s_suppkey") % 3 == 0, F.upper(F.concat(F.lit("vendor "), (F.col("s_suppkey") % 4).cast("string")))).otherwise(F.concat(F.lit("Vendor "), (F.col("s_suppkey") % 4).cast("string")))), "name"),
    """WITH n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper('vendor ' || (s_suppkey % 4)) ELSE 'Vendor ' || (s_suppkey % 4) END AS name FROM supplier)
SELECT lower(trim(name)) AS key, count(DISTINCT name) AS spellings, count(*) AS rows FROM n GROUP BY 1 HAVING count(DISTINCT name) > 1""",
)
_MONTH_SUMS = ", ".join(f"{dbl(f'sum(CASE WHEN month = {m} THEN spend END)')} AS m{m:02d}" for m in range(1, 13))
_add("date_spend_pivot", _on_spend()(lambda b: panels.date_pivot(b, "invoice_date", "total_spend")), _MONTHS + f"SELECT year, {_MONTH_SUMS} FROM mo GROUP BY year")
_CODE_SUMS = ", ".join(f"{dbl(f'sum(CASE WHEN currency = {chr(39)}{c}{chr(39)} THEN local_spend END)')} AS {c.lower()}" for c in S.CURRENCIES)
_add("currency_crosstab", _on_spend("supplier")(lambda b: panels.currency_crosstab(b, "invoice_date", "local_spend", "currency", S.CURRENCIES)), BASE + f"SELECT year(invoice_date)::INT AS year, month(invoice_date)::INT AS month, {_CODE_SUMS} FROM b GROUP BY ALL")
_TOP = """, p AS (SELECT {k} AS key, sum({a}) AS s, count(*) AS n FROM b {w} GROUP BY ALL), q AS (SELECT CASE WHEN row_number() OVER (ORDER BY s DESC, key) <= {n} THEN key ELSE 'Others' END AS key, s, n FROM p)
SELECT key, sum(n)::BIGINT AS rows, {t} AS total_spend FROM q GROUP BY key"""
_add("top_countries_and_others", _on_spend("supplier")(lambda b: panels.top_and_others(b, "vendor_country", "total_spend", 5)), BASE + _TOP.format(k="vendor_country", a="total_spend", w="", n=5, t=dbl("sum(s)")))
_add("non_procurable_by_currency", _on_spend("supplier", "part")(lambda b: panels.non_procurable(b, "description", "total_spend", "currency", ["gear", "bolt", "widget"], 2)), BASE + _TOP.format(k="currency", a="total_spend", w="WHERE regexp_matches(lower(description), 'gear|bolt|widget')", n=2, t=dbl("sum(s)")))
_add(
    "payment_terms_panel", _on_spend("orders")(lambda b: panels.terms_panel(b, "term", "total_spend")),
    BASE + f"SELECT term, count(*) AS rows, {dbl('sum(total_spend)')} AS total_spend, {pct('sum(total_spend)', 'sum(sum(total_spend)) OVER ()')} AS spend_pct, {pct('count(*)', 'sum(count(*)) OVER ()')} AS rows_pct FROM b GROUP BY term",
)
_add("keyword_spend_search", _on_spend("supplier", "part")(lambda b: panels.keyword_spend(b, ["description", "supplier", "vendor_country"], "Widget", "total_spend")), BASE + f"SELECT count(*) AS rows, {dbl('sum(total_spend)')} AS total_spend FROM b WHERE instr(lower(description), 'widget') > 0 OR instr(lower(supplier), 'widget') > 0 OR instr(lower(vendor_country), 'widget') > 0")
_WORDS = "CASE WHEN v = '' THEN 0 ELSE len(regexp_split_to_array(v, '\\s+')) END"
_add(
    "description_stats", lambda spark, sf: panels.description_stats(table(spark, sf, "part"), "p_name"),
    f"""WITH p AS (SELECT trim(p_name) AS v FROM part WHERE trim(p_name) <> '')
SELECT count(*) AS rows, count(DISTINCT v) AS unique_values, count(*) FILTER (WHERE {_WORDS} = 1) AS one_word, count(*) FILTER (WHERE {_WORDS} > 1) AS multi_word, count(*) FILTER (WHERE lower(v) IN ('na', 'n/a', 'none', 'null', 'nan', '-', 'unknown', 'tbd', 'misc', 'other', 'general', '.', '0')) AS proxies,
  count(*) FILTER (WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')) AS alphanumeric, round(sum(length(v)) / greatest(count(*), 1), 2) AS avg_chars FROM p""",
)
_add("top_descriptions", _on_spend("part")(lambda b: panels.top_descriptions(b, "description", "total_spend")), BASE + f"SELECT description, count(*) AS rows, {dbl('sum(total_spend)')} AS total_spend FROM b GROUP BY description ORDER BY rows DESC, description LIMIT 100")
_add(
    "categorization_effort", _on_spend("supplier", "part")(lambda b: panels.categorization_effort(b, "supplier", "description")),
    BASE + """, p AS (SELECT supplier, description AS v, count(*) AS n FROM b GROUP BY ALL)
SELECT sum(n)::BIGINT AS rows, count(*) AS pairs, round(sum(length(v) * n) / sum(n), 2) AS avg_chars, round(sum(len(regexp_split_to_array(v, '\\s+')) * n) / sum(n), 2) AS avg_words,
  round(sum(length(v)) / 4 * 2.5 / 1e6 + count(*) * 20 * 10.0 / 1e6, 4) AS cost_usd, CASE WHEN sum(n) > 400000 THEN 'large' ELSE 'small' END AS method FROM p""",
)
_add("cohort_descriptions", _on_spend("supplier", "part")(lambda b: panels.cohort_descriptions(b, "supplier", "description", "total_spend")), BASE + _RANKED + f"SELECT description FROM (SELECT DISTINCT trim(description) AS description FROM b WHERE supplier IN (SELECT supplier FROM r {_CUT.format(80)})) ORDER BY md5('7:' || description), description LIMIT 1000")
_add("sample_descriptions", _on_spend("part")(lambda b: panels.sample_descriptions(b, "description", 20)), BASE + "SELECT description FROM (SELECT DISTINCT trim(description) AS description FROM b) ORDER BY md5('7:' || description), description LIMIT 20")
_add("diverse_date_samples", lambda spark, sf: panels.diverse_samples(messy(spark, sf), "date_text"), MESSY + """, s AS (SELECT DISTINCT regexp_replace(regexp_replace(trim(date_text), '[0-9]', '9', 'g'), '[A-Za-z]', 'a', 'g') AS shape, trim(date_text) AS value FROM m)
SELECT shape, value FROM s QUALIFY row_number() OVER (PARTITION BY shape ORDER BY value) <= 2""")

# Profiles ----------------------------------------------------------------------------------
_PROFILED = ["c_name", "c_mktsegment", "c_acctbal", "blanky"]
_holes = lambda spark, sf: table(spark, sf, "customer").withColumn("blanky", F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 == 1, " N/A ").when(F.col("c_custkey") % 5 == 2, F.lit(None)).otherwise(F.col("c_mktsegment")))
_HOLES = """WITH h AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN ' N/A ' WHEN c_custkey % 5 = 2 THEN NULL ELSE c_mktsegment END AS blanky FROM customer)
"""
_STAT = "SELECT '{c}' AS \"column\", count(*) AS total_rows, count(*) FILTER (WHERE coalesce(trim({c}::VARCHAR), '') <> '') AS filled, " + pct("count(*) FILTER (WHERE coalesce(trim({c}::VARCHAR), '') <> '')", "count(*)") + " AS fill_pct, count(DISTINCT nullif(trim({c}::VARCHAR), '')) AS distinct_values FROM h"
_add("column_stats", lambda spark, sf: profile.column_stats(_holes(spark, sf), _PROFILED), _HOLES + " UNION ALL ".join(_STAT.format(c=c) for c in _PROFILED))
_REAL = "coalesce(trim({c}::VARCHAR), '') <> '' AND lower(trim({c}::VARCHAR)) NOT IN ('na', '#na', 'n/a', '#n/a', 'none', 'null', 'nan', '-', 'unknown', 'not applicable', 'tbd', 'misc', 'miscellaneous', 'other', 'general', 'unclassified', '.')"
_FILL = "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE " + _REAL + ") AS filled, " + pct("count(*) FILTER (WHERE " + _REAL + ")", "count(*)") + " AS fill_pct, " + pct("coalesce(sum(c_acctbal::DECIMAL(18,2)) FILTER (WHERE " + _REAL + "), 0)", "sum(c_acctbal::DECIMAL(18,2))") + " AS spend_pct FROM h"
_add("fill_rate_spend_coverage", lambda spark, sf: profile.fill_rates(_holes(spark, sf), ["c_name", "blanky"], S.money("c_acctbal")), _HOLES + " UNION ALL ".join(_FILL.format(c=c) for c in ("c_name", "blanky")))
_add("null_proxy_profile", lambda spark, sf: profile.null_proxies(_holes(spark, sf), ["blanky"]), _HOLES + f"SELECT 'blanky' AS \"column\", count(*) AS total_rows, count(*) FILTER (WHERE lower(trim(blanky)) = 'n/a') AS proxies, count(*) FILTER (WHERE coalesce(trim(blanky), '') = '') AS blank, {pct(chr(32).join(['count(*) FILTER (WHERE lower(trim(blanky)) =', chr(39) + 'n/a' + chr(39) + ')']), 'count(*)')} AS proxy_pct FROM h")
_add(
    "deep_column_stats", lambda spark, sf: profile.deep_stats(_holes(spark, sf), ["blanky"]).select("column", "total_rows", "blank", "distinct_values", "numeric", "min_len", "max_len", "with_digit", "with_special", "fill_pct", "unique_pct", "numeric_pct", "avg_len"),
    _HOLES + f""", v AS (SELECT nullif(trim(blanky), '') AS v FROM h)
SELECT 'blanky' AS "column", count(*) AS total_rows, count(*) - count(v) AS blank, count(DISTINCT v) AS distinct_values, 0::BIGINT AS numeric, min(length(v))::INT AS min_len, max(length(v))::INT AS max_len,
  count(*) FILTER (WHERE regexp_matches(v, '[0-9]')) AS with_digit, count(*) FILTER (WHERE regexp_matches(v, '[^A-Za-z0-9 ]')) AS with_special, {pct('count(v)', 'count(*)')} AS fill_pct,
  {pct('count(DISTINCT v)', 'count(v)')} AS unique_pct, 0.0::DOUBLE AS numeric_pct, round(sum(length(v)) / greatest(count(v), 1), 2) AS avg_len FROM v""",
)
_add("topk_values", lambda spark, sf: profile.top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], 3), " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 3)" for c in ("o_orderpriority", "o_orderstatus")))
_add("numeric_median_upper", lambda spark, sf: profile.upper_median(table(spark, sf, "orders"), "o_totalprice"), "WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL) SELECT x AS median_value, n FROM r WHERE i = n // 2")
_add("duplicate_row_estimate", lambda spark, sf: profile.duplicate_estimate(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderdate"]), "SELECT count(*) AS total_rows, count(*) - count(DISTINCT (o_orderstatus, o_orderpriority, o_orderdate)) AS duplicates FROM orders")
for _how, _agg in (("sum", "sum(local_spend)"), ("avg", "avg(local_spend::DOUBLE)"), ("distinct", "count(DISTINCT supplier)"), ("count", "count(*)")):
    _measure = {"sum": F.col, "avg": lambda c: F.col(c).cast("double"), "distinct": lambda _: F.col("supplier"), "count": lambda _: None}[_how]
    _add(f"slice_{_how}", lambda spark, sf, h=_how, m=_measure: profile.slice_by(S.spend(spark, sf, "supplier"), "vendor_country", m("local_spend"), h), BASE + f"SELECT vendor_country AS dimension, round(({_agg})::DOUBLE, 2) AS value FROM b GROUP BY 1 ORDER BY value DESC, dimension LIMIT 15")

# Cleaning ----------------------------------------------------------------------------------
_add("drop_blank_rows", lambda spark, sf: clean.drop_blank_rows(_holes(spark, sf), ["blanky"]).select("c_custkey", "blanky"), _HOLES + "SELECT c_custkey, blanky FROM h WHERE coalesce(trim(blanky), '') <> ''")
_add("clean_case_trim", lambda spark, sf: clean.case_trim(_holes(spark, sf).select("c_custkey", "c_name", "blanky"), ["c_name", "blanky"]), _HOLES + "SELECT c_custkey, nullif(upper(trim(c_name)), '') AS c_name, nullif(upper(trim(blanky)), '') AS blanky FROM h")
_add("dedup_keep_first", lambda spark, sf: clean.dedup_keep_first(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"], "o_orderkey"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
_add("dedup_preview", lambda spark, sf: clean.dedup_preview(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]), "SELECT count(*) AS total_rows, count(DISTINCT (o_custkey, o_orderstatus)) AS unique_rows, count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS duplicate_rows FROM orders")
_add("standardize_pad", lambda spark, sf: table(spark, sf, "customer").select("c_custkey", C.pad("c_custkey", 3).alias("padded")), "SELECT c_custkey, right('000' || c_custkey, 3) AS padded FROM customer")
_add("standardize_strip", lambda spark, sf: messy(spark, sf).select("id", C.strip_zeros("key_text").alias("stripped")), MESSY + "SELECT id, CASE WHEN regexp_matches(key_text, '^[0-9]+$') THEN coalesce(nullif(ltrim(key_text, '0'), ''), '0') ELSE key_text END AS stripped FROM m")
_add("concat_columns", lambda spark, sf: clean.concat_columns(_holes(spark, sf).select("c_custkey", "c_mktsegment", "blanky"), ["c_mktsegment", "blanky"]), _HOLES + "SELECT c_custkey, c_mktsegment, blanky, coalesce(c_mktsegment, '') || coalesce(blanky, '') AS Concat_c_mktsegment_blanky FROM h")
_add(
    "column_format_analysis", lambda spark, sf: clean.column_format(messy(spark, sf), ["key_text"]),
    MESSY + f"""SELECT 'key_text' AS "column", count(*) AS total, {pct("count(*) FILTER (WHERE regexp_matches(key_text, '^0[0-9]+$'))", 'count(*)')} AS leading_zero_pct, {pct("count(*) FILTER (WHERE regexp_matches(key_text, '^[0-9]+$'))", 'count(*)')} AS numeric_pct,
  min(length(key_text))::INT AS min_len, max(length(key_text))::INT AS max_len, (SELECT length(key_text)::INT AS l FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_len, 'none' AS advice FROM m""",
)
_add("delete_rows", lambda spark, sf: clean.delete_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), table(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    rest, gone = clean.remove_columns(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey")
    return clean.restore_columns(rest, gone, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


_add("restore_columns", _restored, "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_add("best_rows_preview", lambda spark, sf: clean.best_rows(_holes(spark, sf).select("c_custkey", "c_name", "blanky"), 10, "c_custkey"), _HOLES + "SELECT c_custkey, c_name, blanky, (1 + (coalesce(trim(blanky), '') <> '')::INT)::INT AS filled FROM (SELECT * FROM h ORDER BY c_custkey LIMIT 1000) ORDER BY filled DESC, c_custkey LIMIT 10")

# Joins, sets, merge ------------------------------------------------------------------------
_MERGE = [("o_custkey", "c_custkey")]
_half = lambda spark, sf: table(spark, sf, "customer").where("c_custkey % 2 = 0")
_add(
    "simulate_join", lambda spark, sf: matching.simulate(table(spark, sf, "orders"), _half(spark, sf), _MERGE),
    f"""WITH a AS (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS b FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), f AS (SELECT * FROM a FULL JOIN c USING (k)),
s AS (SELECT sum(a)::BIGINT AS base_rows, coalesce(sum(a) FILTER (WHERE b IS NOT NULL), 0)::BIGINT AS matched_rows, coalesce(sum(a * b), 0)::BIGINT AS joined_rows, coalesce(sum(a) FILTER (WHERE b IS NULL), 0)::BIGINT AS unmatched_base,
  count(*) FILTER (WHERE a IS NULL) AS unmatched_source_keys, count(*) FILTER (WHERE b > 1) AS duplicate_source_keys FROM f)
SELECT *, {pct('matched_rows', 'base_rows')} AS match_pct, round(joined_rows / greatest(matched_rows, 1), 4) AS explosion FROM s""",
)
_add(
    "merge_left_dedup", lambda spark, sf: matching.merge(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), _half(spark, sf).union(_half(spark, sf)), _MERGE, ["c_name", "c_mktsegment"], "c_custkey"),
    "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey",
)
_add("merge_validation_anti_base", lambda spark, sf: matching.unmatched(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], _half(spark, sf), ["c_custkey"]), "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey = o_custkey)")
_add("merge_validation_anti_source", lambda spark, sf: matching.unmatched(_half(spark, sf).select("c_custkey"), ["c_custkey"], table(spark, sf, "orders"), ["o_custkey"]), "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("semi_match_rate", lambda spark, sf: matching.match_rate(table(spark, sf, "orders"), ["o_custkey"], _half(spark, sf), ["c_custkey"]), f"WITH m AS (SELECT o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS hit FROM orders) SELECT count(*) AS rows, count(*) FILTER (WHERE hit) AS matched, count(DISTINCT CASE WHEN hit THEN o_custkey END) AS matched_keys, {pct('count(*) FILTER (WHERE hit)', 'count(*)')} AS match_pct FROM m")
_add("dim_uniqueness", lambda spark, sf: matching.uniqueness(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]), "SELECT count(*) AS rows, count(DISTINCT (o_custkey, o_orderstatus)) AS distinct_keys FROM orders")


def _finalized(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    step = lambda cols: matching.merge(base, table(spark, sf, "customer"), _MERGE, cols, "c_custkey")
    return matching.finalize(base, [step(["c_name"]), step(["c_mktsegment"])], "o_orderkey")


_add("finalize_chain", _finalized, "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_add("unmatched_except", lambda spark, sf: table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").select("o_custkey")), "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
_add(
    "value_overlap_intersect", lambda spark, sf: profile.overlap(messy(spark, sf), "key_text", table(spark, sf, "customer"), "c_custkey"),
    MESSY + f""", a AS (SELECT DISTINCT try_cast(key_text AS DOUBLE) AS k FROM m), c AS (SELECT DISTINCT c_custkey::DOUBLE AS k FROM customer), n AS (SELECT (SELECT count(*) FROM a) AS left_distinct, (SELECT count(*) FROM c) AS right_distinct, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM c)) AS shared)
SELECT *, {pct('shared', 'left_distinct')} AS of_left_pct, {pct('shared', 'least(left_distinct, right_distinct)')} AS of_smaller_pct FROM n""",
)
_add("key_normalization", lambda spark, sf: messy(spark, sf).groupBy(C.match_key("key_text").alias("k")).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("keys")), MESSY + "SELECT rows, count(*) AS keys FROM (SELECT try_cast(key_text AS DOUBLE) AS k, count(*) AS rows FROM m GROUP BY 1) GROUP BY rows")


def _appended(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"customers": table(spark, sf, "customer"), "suppliers": table(spark, sf, "supplier")}
    return matching.append(tables, {"customers": {"c_name": "NAME", "c_mktsegment": "SEGMENT"}, "suppliers": {"s_name": "NAME"}}, ["NAME", "SEGMENT"])


_UNION = "SELECT c_name AS NAME, c_mktsegment AS SEGMENT, 'customers' AS _source_table FROM customer UNION ALL SELECT s_name, NULL, 'suppliers' FROM supplier"
_add("append_union_mapped", _appended, _UNION)
_add("append_integrity", lambda spark, sf: _appended(spark, sf).groupBy("_source_table").agg(F.count("*").alias("rows"), F.count("SEGMENT").alias("with_segment")), f"SELECT _source_table, count(*) AS rows, count(SEGMENT) AS with_segment FROM ({_UNION}) GROUP BY 1")
_add("outer_union_by_name", lambda spark, sf: table(spark, sf, "nation").select("n_name").unionByName(table(spark, sf, "region").select("r_name"), allowMissingColumns=True), "SELECT n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, r_name FROM region")
_add("find_join_keys", lambda spark, sf: matching.find_keys(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf, "region").select("r_regionkey")), """WITH f AS (SELECT DISTINCT 'n_nationkey' AS fact_column, n_nationkey AS v FROM nation UNION SELECT DISTINCT 'n_regionkey', n_regionkey FROM nation)
SELECT fact_column, 'r_regionkey' AS dim_column, count(r_regionkey) AS shared, round(count(r_regionkey)::DOUBLE / count(*)::DOUBLE * 100, 2) AS overlap_pct FROM f LEFT JOIN region ON v = r_regionkey GROUP BY 1 HAVING overlap_pct >= 30""")

# Dates and normalisers ---------------------------------------------------------------------
_FORM = "CASE id % 7 WHEN 0 THEN 'YYYY-MM-DD' WHEN 1 THEN 'DD/MM/YYYY' WHEN 2 THEN 'DD.MM.YYYY' WHEN 3 THEN 'YYYYMMDD' WHEN 4 THEN 'DD-Mon-YYYY' ELSE 'other' END"
_add("date_format_detection", lambda spark, sf: normalise.format_mix(messy(spark, sf), "date_text", "file"), MESSY + f"SELECT file, {_FORM} AS format, count(*) AS rows FROM m GROUP BY ALL")
_add(
    "dmy_mdy_vote", lambda spark, sf: normalise.dmy_votes(messy(spark, sf), "date_text", "file"),
    MESSY + """, v AS (SELECT file, CASE WHEN id % 7 = 0 THEN 1 WHEN id % 7 IN (1, 2) THEN (day(d) > 12)::INT WHEN id % 7 = 4 THEN (day(d) > 12)::INT + 1 ELSE 0 END AS a FROM m)
SELECT file, sum(a)::BIGINT AS dmy, 0::BIGINT AS mdy, 'DMY' AS date_order FROM v GROUP BY file""",
)
_add("date_parse_multi_gate", lambda spark, sf: normalise.dates_by_file(messy(spark, sf), "date_text", "file", "parsed").select("id", "parsed"), MESSY + "SELECT id, CASE WHEN id % 7 <> 6 THEN d END AS parsed FROM m")
_add("excel_serial_dates", lambda spark, sf: messy(spark, sf).where("id % 7 = 5").select("id", dates.parse("date_text").alias("parsed")), MESSY + "SELECT id, DATE '1899-12-30' + date_text::INT AS parsed FROM m WHERE id % 7 = 5")
_add("year_month_extract", lambda spark, sf: messy(spark, sf).select(dates.parse("date_text").alias("p")).groupBy(F.year("p").alias("year"), F.month("p").alias("month")).agg(F.count("*").alias("rows")), MESSY + "SELECT CASE WHEN id % 7 <> 6 THEN year(d) END::INT AS year, CASE WHEN id % 7 <> 6 THEN month(d) END::INT AS month, count(*) AS rows FROM m GROUP BY ALL")
_add("supplier_suffix_clean", lambda spark, sf: messy(spark, sf).groupBy("supplier", C.supplier_name("supplier").alias("cleaned")).agg(F.count("*").alias("rows")), MESSY + """, n(raw, cleaned) AS (VALUES ('Acme Tools Inc.', 'Acme Tools'), ('Globex Corporation', 'Globex'), ('Initech  Holdings, LLC', 'Initech'), ('umbrella.com', 'umbrella'), ('Stark Industries Group Ltd', 'Stark Industries'), ('Wayne Co.', 'Wayne'), ('Hooli', 'Hooli'))
SELECT supplier, cleaned, count(*) AS rows FROM m JOIN n ON raw = supplier GROUP BY ALL""")
_COUNTRY = "n(raw, c) AS (VALUES ('us', 'United States'), ('U.S.A.', 'United States'), ('DEU', 'Germany'), ('Germany', 'Germany'), ('gb', 'United Kingdom'), ('jp', 'Japan'))"
_add("country_iso_lookup", lambda spark, sf: normalise.countries(messy(spark, sf).withColumnRenamed("country", "raw"), "raw").groupBy("raw", "country", "normalized_via").agg(F.count("*").alias("rows")), MESSY + f", {_COUNTRY} SELECT country AS raw, c AS country, CASE WHEN c IS NULL THEN '' ELSE 'ISO Lookup' END AS normalized_via, count(*) AS rows FROM m LEFT JOIN n ON raw = country GROUP BY ALL")
_add("region_from_country", lambda spark, sf: normalise.regions(normalise.countries(messy(spark, sf).withColumnRenamed("country", "raw"), "raw"), "country").groupBy("region_norm").agg(F.count("*").alias("rows")), MESSY + f", {_COUNTRY} SELECT CASE c WHEN 'United States' THEN 'NA' WHEN 'Japan' THEN 'APAC' WHEN 'Germany' THEN 'EMEA' WHEN 'United Kingdom' THEN 'EMEA' END AS region_norm, count(*) AS rows FROM m LEFT JOIN n ON raw = country GROUP BY ALL")
_add("plant_cleanup", lambda spark, sf: messy(spark, sf).groupBy("plant", C.plant_name("plant").alias("cleaned")).agg(F.count("*").alias("rows")), MESSY + """, n(raw, cleaned) AS (VALUES ('Plant A-001', 'Plant A'), ('Site  B (old)', 'Site B'), ('Lyon_1234', 'Lyon'), ('Main Works', 'Main Works'), ('Depot C (x)-567', 'Depot C'))
SELECT plant, cleaned, count(*) AS rows FROM m JOIN n ON raw = plant GROUP BY ALL""")
_add("payment_term_parse", lambda spark, sf: normalise.payment_terms(messy(spark, sf), "term").groupBy("term", "term_days", "term_discount", "term_doubt").agg(F.count("*").alias("rows")), MESSY + """, n(raw, days, discount) AS (VALUES ('Net 30', '30', ''), ('N45', '45', ''), ('60 days', '60', ''), ('COD', '0', ''), ('2%10 Net 30', '30', '2% discount if paid within 10 days'), ('CIA', '0', 'Cash in advance'), ('due on receipt', '0', ''), ('90', '90', ''))
SELECT term, days AS term_days, coalesce(discount, '') AS term_discount, days IS NULL AND term <> '' AS term_doubt, count(*) AS rows FROM m LEFT JOIN n ON raw = term GROUP BY ALL""")
_add("fuzzy_supplier_dedup", lambda spark, sf: normalise.supplier_clusters(typed_names(spark, sf), "supplier"))

_AMOUNTS = "a(raw, x) AS (VALUES ('1,234.50', 1234.5), ('$99', 99), ('(250.00)', -250), ('1e3', 1000), ('-7', -7), ('00042', 42))"
_FX = MESSY + f", {_AMOUNTS}, r AS ({RATE_SQL}), l AS (SELECT currency, max_by(rate, year * 12 + month) AS latest FROM r GROUP BY 1), y AS (SELECT currency, avg(rate) AS mean FROM r WHERE year = 1998 GROUP BY 1), x AS (SELECT id, d, a.x::DOUBLE AS x, nullif(upper(trim(ccy)), '') AS c FROM m LEFT JOIN a ON raw = amount)"
_STATUS = "CASE WHEN x IS NULL THEN 'spend_invalid' WHEN c IS NULL THEN 'currency_missing' WHEN rate IS NULL THEN 'unsupported_currency' WHEN fell THEN 'fallback' ELSE 'converted' END"
_MONTHLY = ", j AS (SELECT x.*, CASE WHEN c = 'USD' THEN 1.0 ELSE coalesce(r.rate, latest) END::DOUBLE AS rate, coalesce(c <> 'USD' AND r.rate IS NULL AND latest IS NOT NULL, false) AS fell FROM x LEFT JOIN r ON r.currency = c AND r.year = year(d) AND r.month = month(d) LEFT JOIN l ON l.currency = c)"
_YEAR = ", j AS (SELECT x.*, CASE WHEN c = 'USD' THEN 1.0 ELSE mean END::DOUBLE AS rate, false AS fell FROM x LEFT JOIN y ON y.currency = c)"
_LATEST = ", j AS (SELECT x.*, CASE WHEN c = 'USD' THEN 1.0 ELSE latest END::DOUBLE AS rate, false AS fell FROM x LEFT JOIN l ON l.currency = c)"


def _converted(mode: str, target: str = "USD"):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        out = normalise.convert(messy(spark, sf), "amount", "ccy", "d", rates(spark), mode, 1998, target)
        return out.select("id", "status", F.round("converted", 4).alias("converted"))

    return query


for _name, _mode, _sql in (("fx_convert_monthly", "monthly", _MONTHLY), ("fx_convert_scope_year", "scope_year", _YEAR), ("fx_convert_latest", "latest", _LATEST)):
    _add(_name, _converted(_mode), _FX + _sql + f" SELECT id, {_STATUS} AS status, CASE WHEN {_STATUS} IN ('converted', 'fallback') THEN round(x / rate, 4) END AS converted FROM j")
_add("fx_cross_rate", _converted("latest", "EUR"), _FX + _LATEST + f", k AS (SELECT id, x, c, CASE WHEN c = 'EUR' THEN 1.0 ELSE rate / (SELECT latest FROM l WHERE currency = 'EUR') END AS rate, fell FROM j) SELECT id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'converted' THEN round(x / rate, 4) END AS converted FROM k")
_add("fx_status_counts", lambda spark, sf: _converted("monthly")(spark, sf).groupBy("status").agg(F.count("*").alias("rows")), _FX + _MONTHLY + f" SELECT {_STATUS} AS status, count(*) AS rows FROM j GROUP BY 1")
_add("unsupported_currencies", lambda spark, sf: messy(spark, sf).where(C.non_blank("ccy")).groupBy(F.upper(F.trim("ccy")).alias("currency")).agg(F.count("*").alias("rows")).join(rates(spark).select("currency").distinct(), "currency", "left_anti").where("currency <> 'USD'"), _FX + " SELECT c AS currency, count(*) AS rows FROM x WHERE c IS NOT NULL AND c <> 'USD' AND c NOT IN (SELECT currency FROM l) GROUP BY 1")

# Typed table -------------------------------------------------------------------------------
_MAPPING = {"amount": "total_spend", "date_text": "invoice_date", "supplier": "supplier"}
_add("typed_cast_report", lambda spark, sf: typed.report(messy(spark, sf), _MAPPING), MESSY + f""", s AS (SELECT 'total_spend' AS field, count(*) FILTER (WHERE trim(amount) <> '') AS given, count(*) FILTER (WHERE amount IN ('1,234.50', '$99', '1e3', '-7', '12 000', '00042')) AS valid FROM m
UNION ALL SELECT 'invoice_date', count(*), count(*) FILTER (WHERE id % 7 <> 6) FROM m UNION ALL SELECT 'supplier', count(*), count(*) FROM m)
SELECT field, given, valid, given - valid AS failed, {pct('valid', 'given')} AS valid_pct FROM s""")
_add("typed_cast_failures", lambda spark, sf: typed.failures(messy(spark, sf), _MAPPING), MESSY + """, f AS (SELECT 'total_spend' AS "column", amount AS value, count(*) AS count FROM m WHERE amount IN ('(250.00)', 'abc', '2024-01-15') GROUP BY ALL UNION ALL SELECT 'invoice_date', 'n/a', count(*) FROM m WHERE id % 7 = 6)
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INT AS rank FROM f""")
_add("null_audit", lambda spark, sf: typed.null_rows(typed.build(messy(spark, sf), _MAPPING)).groupBy("supplier").agg(F.count("*").alias("rows")), MESSY + "SELECT supplier, count(*) AS rows FROM m WHERE id % 7 = 6 OR amount NOT IN ('1,234.50', '$99', '1e3', '-7', '12 000', '00042') GROUP BY 1")
_add("running_balance", lambda spark, sf: running.running(_balance(spark, sf).where("balance > 0").select("c_custkey", "balance"), "balance", "c_custkey").select("c_custkey", "rank", F.col("cumulative").cast("double").alias("cumulative")), "SELECT c_custkey, row_number() OVER w AS rank, (sum(c_acctbal::DECIMAL(18,2)) OVER (w ROWS UNBOUNDED PRECEDING))::DOUBLE AS cumulative FROM customer WHERE c_acctbal > 0 WINDOW w AS (ORDER BY c_acctbal DESC, c_custkey)")

# Assessments --------------------------------------------------------------------------------
_FILLED = "count(*) FILTER (WHERE {0} IS NOT NULL AND trim({0}) <> '')"
_add(
    "populated_columns", lambda spark, sf: assess.populated(messy(spark, sf), ["amount", "supplier"]),
    MESSY + ", s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_FILLED.format(c)} AS populated, count(*) AS total FROM m" for c in ("amount", "supplier"))
    + ') SELECT "column", populated, total, round(populated * 100.0::DOUBLE / total, 1) AS pct_populated, populated * 100.0::DOUBLE / total < 60 AS warn FROM s',
)
_add(
    "spend_metrics", lambda spark, sf: assess.spend_metrics(messy(spark, sf), "amount"),
    MESSY + """, n AS (SELECT amount, regexp_replace(trim(amount), '[, ]', '', 'g') AS v FROM m),
c AS (SELECT coalesce(trim(amount), '') <> '' AS given, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN v::DOUBLE END AS x FROM n)
SELECT count(*) AS rows, round(sum(coalesce(x, 0)), 0) AS total_spend, count(*) FILTER (WHERE given AND x IS NOT NULL) AS numeric, count(*) FILTER (WHERE given AND x IS NULL) AS non_numeric FROM c""",
)
_add(
    "currency_quality", _on_spend("supplier")(lambda b: assess.currency_quality(b, "currency", "local_spend", "total_spend", 2)),
    BASE + f""", per AS (SELECT currency, count(*) AS n, sum(local_spend) AS l, sum(total_spend) AS r FROM b GROUP BY currency),
k AS (SELECT *, row_number() OVER (ORDER BY r DESC, n DESC, currency) AS place, sum(n) OVER () AS whole FROM per)
SELECT CASE WHEN place <= 2 THEN currency ELSE 'Others' END AS code, sum(n)::BIGINT AS rows, {pct('sum(n)', 'any_value(whole)')} AS rows_pct, round(sum(l)::DOUBLE, 0) AS local_spend, round(sum(r)::DOUBLE, 0) AS reporting_spend FROM k GROUP BY 1""",
)
_add(
    "alphanumeric_spend", _on_spend("supplier", "part")(lambda b: assess.alphanumeric_spend(b, "description", "total_spend", "currency")),
    BASE + f"SELECT currency, count(*) AS rows, {dbl('sum(total_spend)')} AS total_spend FROM b WHERE regexp_matches(description, '[A-Za-z0-9]') GROUP BY currency",
)
_add(
    "spend_over_time_metrics", _on_spend()(lambda b: assess.time_metrics(b, "invoice_date", "total_spend")),
    _MONTHS + f""", p AS (SELECT (year * 100 + month)::INT AS month, spend FROM mo)
SELECT {dbl('sum(spend)')} AS total_spend, (min(month) // 100)::INT AS first_year, (max(month) // 100)::INT AS last_year, round(sum(spend)::DOUBLE / count(*), 2) AS avg_month,
first(month ORDER BY spend DESC, month) AS highest_month, {dbl('max(spend)')} AS highest_spend, first(month ORDER BY spend, month) AS lowest_month, {dbl('min(spend)')} AS lowest_spend FROM p""",
)


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"customer": ("c_custkey", "c_nationkey"), "orders": ("o_custkey", "o_orderstatus"), "supplier": ("s_suppkey", "s_nationkey")}
    named = {t: table(spark, sf, t).select(F.col(k).alias("Key"), F.col(x).alias("status" if t == "orders" else "nation")) for t, (k, x) in columns.items()}
    return assess.table_overlap(named)


_add(
    "table_overlap", _overlap,
    """WITH v AS (SELECT DISTINCT 'customer' AS t, 'key' AS c, c_custkey AS v FROM customer UNION ALL SELECT DISTINCT 'customer', 'nation', c_nationkey FROM customer
UNION ALL SELECT DISTINCT 'orders', 'key', o_custkey FROM orders UNION ALL SELECT DISTINCT 'supplier', 'key', s_suppkey FROM supplier UNION ALL SELECT DISTINCT 'supplier', 'nation', s_nationkey FROM supplier),
n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT a.t AS a, b.t AS b, a.c, count(*) AS shared FROM v a JOIN v b ON a.c = b.c AND a.v = b.v AND a.t < b.t GROUP BY ALL)
SELECT p.t AS a, q.t AS b, count(*)::INT AS shared_headers, round(count(*) / 2::DOUBLE, 4) AS header_overlap, round(avg(coalesce(shared, 0)::DOUBLE / least(p.n, q.n)), 4) AS value_overlap
FROM n p JOIN n q ON p.c = q.c AND p.t < q.t LEFT JOIN x ON x.a = p.t AND x.b = q.t AND x.c = p.c GROUP BY ALL""",
)

# Insights -----------------------------------------------------------------------------------
_TOPS = """, p AS (SELECT {key} AS k, sum(total_spend) AS s FROM b GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, k) AS i, sum(s) OVER () AS t FROM p)
SELECT count(*) AS members, max(k) FILTER (WHERE i = 1) AS leader, {one} AS leader_pct, {tops}, CASE WHEN count(*) > 1 THEN round(100 - {one}, 1) ELSE 0 END::DOUBLE AS others_pct FROM r"""


def _top_sql(key: str, *tops: int) -> str:
    share = lambda k: pct(f"sum(s) FILTER (WHERE i <= {k})", "any_value(t)", 1)
    return BASE + _TOPS.format(key=key, one=share(1), tops=", ".join(f"{share(k)} AS top{k}_pct" for k in tops))


_add("supplier_ranking_metrics", _on_spend("supplier")(lambda b: insights.concentration(b, "supplier", "total_spend", (5, 10))), _top_sql("supplier", 5, 10))
_add("country_spend_metrics", _on_spend("supplier")(lambda b: insights.concentration(b, "vendor_country", "total_spend")), _top_sql("vendor_country", 3))
_add("currency_spend_metrics", _on_spend("supplier")(lambda b: insights.concentration(b, "currency", "total_spend")), _top_sql("currency", 3))
_add("l1_spend_metrics", _on_spend("part")(lambda b: insights.concentration(b, "l1", "total_spend")), _top_sql("l1", 3))
_add(
    "pareto_metrics", _on_spend("supplier")(lambda b: insights.long_tail(b, "supplier", "total_spend")),
    BASE + f""", p AS (SELECT supplier, sum(total_spend) AS s FROM b GROUP BY 1), r AS (SELECT *, sum(s) OVER (ORDER BY s DESC, supplier ROWS UNBOUNDED PRECEDING) - s AS before, sum(s) OVER () AS t FROM p)
SELECT count(*) FILTER (WHERE before::DOUBLE < t::DOUBLE * 0.8) AS leading, count(*) FILTER (WHERE before::DOUBLE >= t::DOUBLE * 0.8) AS long_tail, {pct("sum(s) FILTER (WHERE before::DOUBLE >= t::DOUBLE * 0.8)", "any_value(t)", 1)} AS long_tail_pct FROM r""",
)
for _name, _a, _b in (("l1_vs_l2_metrics", "l1", "l2"), ("l2_vs_l3_metrics", "l2", "l3")):
    _add(
        _name, (lambda a, b: _on_spend("part")(lambda df: insights.segment_leaders(df, a, b, "total_spend")))(_a, _b),
        BASE + f""", p AS (SELECT {_a} AS c, {_b} AS g, sum(total_spend) AS s FROM b GROUP BY ALL), k AS (SELECT c, sum(s) AS s FROM p GROUP BY 1), lead AS (SELECT first(c ORDER BY s DESC, c DESC) AS c FROM k),
scoped AS (SELECT 'all' AS scope, * FROM p UNION ALL SELECT 'leading column', p.* FROM p WHERE c = (SELECT c FROM lead)), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, c, g) AS i FROM scoped)
SELECT scope, c AS "column", g AS segment, {dbl("s")} AS total_spend, {pct("s", "(SELECT sum(s) FROM p)", 1)} AS pct_of_total FROM r WHERE i <= 3""",
    )
_add(
    "distinct_values_by_column", lambda spark, sf: insights.distinct_values(messy(spark, sf), ["supplier", "plant", "amount", "key_text"], 20),
    MESSY + ", c AS (" + " UNION ".join(f"SELECT '{c}' AS \"column\", trim({c}) AS value FROM m WHERE trim({c}) <> ''" for c in ("supplier", "plant", "amount", "key_text"))
    + '), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 20',
)
_add("currency_codes", lambda spark, sf: insights.currency_codes(messy(spark, sf), "ccy"), MESSY + "SELECT upper(trim(ccy)) AS code, count(*) AS rows FROM m WHERE trim(ccy) <> '' GROUP BY 1 ORDER BY rows DESC, code LIMIT 200")
_add(
    "text_years", lambda spark, sf: messy(spark, sf).groupBy(insights.year_of("date_text").alias("year")).agg(F.count("*").alias("rows")),
    MESSY + "SELECT nullif(regexp_extract(date_text, '((?:19|20)\\d\\d)', 1), '')::INT AS year, count(*) AS rows FROM m GROUP BY 1",
)
_add(
    "month_labels", lambda spark, sf: table(spark, sf, "orders").groupBy(insights.month_label(F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("label")).agg(F.count("*").alias("rows")),
    "SELECT strftime(o_orderdate, '%b %Y') AS label, count(*) AS rows FROM orders GROUP BY 1",
)
_add(
    "column_kinds", lambda spark, sf: insights.column_kinds({"a": messy(spark, sf).select("key_text", "supplier", F.col("d").cast("string").alias("d")), "b": table(spark, sf, "customer").select(F.col("c_custkey").alias("key_text"), F.col("c_name").alias("supplier"))}),
    MESSY + """, k AS (SELECT key_text AS v FROM m UNION ALL SELECT c_custkey::VARCHAR FROM customer)
SELECT 'key_text' AS "column", count(*) AS rows, 0::BIGINT AS blank, (SELECT greatest((SELECT count(DISTINCT key_text) FROM m), (SELECT count(*) FROM customer))) AS most_distinct, 'number' AS kind FROM k
UNION ALL SELECT 'supplier', (SELECT count(*) FROM m) + (SELECT count(*) FROM customer), 0, greatest((SELECT count(DISTINCT supplier) FROM m), (SELECT count(DISTINCT c_name) FROM customer)), 'text'
UNION ALL SELECT 'd', count(*), 0, count(DISTINCT d), 'date' FROM m""",
)
_add(
    "merge_priorities", lambda spark, sf: insights.merge_priorities(_overlap(spark, sf), "customer"),
    "WITH o AS (" + _SQL["table_overlap"] + """), s AS (SELECT CASE WHEN a = 'customer' THEN b ELSE a END AS "table", coalesce(value_overlap, 0) * 0.65::DOUBLE + header_overlap * 0.35::DOUBLE AS p FROM o WHERE 'customer' IN (a, b))
SELECT "table", round(p, 4) AS priority, CASE WHEN p >= 0.65 THEN 'high' WHEN p >= 0.4 THEN 'medium' WHEN p >= 0.2 THEN 'low' ELSE 'none' END AS label FROM s""",
)
_guarded = lambda spark, sf: matching.guarded_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("c_name")), _half(spark, sf).select("c_custkey", "c_name", "c_mktsegment"), _MERGE, "dim")
_add("guarded_left_join", lambda spark, sf: _guarded(spark, sf)[0], "SELECT o_orderkey, o_custkey, 1::INT AS c_name, c.c_name AS c_name_dim, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey")
_add(
    "guarded_join_report", lambda spark, sf: _guarded(spark, sf)[1],
    f"""WITH m AS (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS hit FROM orders), s AS (SELECT count(*) AS rows, count(*) FILTER (WHERE hit) AS matched FROM m)
SELECT 'dim' AS dimension, rows, rows AS rows_after, matched, {pct("matched", "rows")} AS match_pct, 2::INT AS columns_added, CASE WHEN {pct("matched", "rows")} < 30 THEN 'low match' ELSE 'merged' END AS status FROM s""",
)
_coded = lambda spark, sf: table(spark, sf, "customer").select(F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("code"))
_add(
    "key_format_prefix", lambda spark, sf: matching.formatted_overlap(_coded(spark, sf), "code", table(spark, sf, "orders"), "o_custkey"),
    """WITH c AS (SELECT count(DISTINCT c_custkey) AS n FROM customer), o AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), s AS (SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT 'as written' AS keys, c.n AS left_distinct, o.n AS right_distinct, 0::BIGINT AS shared, 'prefix' AS format FROM c, o UNION ALL SELECT 'made equal', c.n, o.n, s.n, 'prefix' FROM c, o, s""",
)
_dashed = lambda spark, sf, sign: table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(sign), F.length("p_brand").cast("string")).alias("code"))
_add(
    "key_format_separator", lambda spark, sf: matching.formatted_overlap(_dashed(spark, sf, "-"), "code", _dashed(spark, sf, "_"), "code"),
    "WITH n AS (SELECT count(DISTINCT p_partkey::VARCHAR || length(p_brand)) AS made, count(DISTINCT p_partkey::VARCHAR || '-' || length(p_brand)) AS n FROM part) SELECT 'as written' AS keys, n AS left_distinct, n AS right_distinct, 0::BIGINT AS shared, 'separator' AS format FROM n UNION ALL SELECT 'made equal', made, made, made, 'separator' FROM n",
)
_add(
    "sample_of_leaders", lambda spark, sf: insights.sample_of_leaders(S.spend(spark, sf, "part"), "description", "total_spend"),
    BASE + _RANKED.replace("supplier", "description") + f"SELECT description FROM r {_CUT.format(80)} ORDER BY md5('7:' || description), description LIMIT 100",
)
_add("derived_column_placed", lambda spark, sf: clean.place_after(messy(spark, sf), "supplier", "supplier_norm", C.supplier_name("supplier")).select("id", "supplier_norm").groupBy("supplier_norm").agg(F.count("*").alias("rows")), MESSY + """, n(raw, cleaned) AS (VALUES ('Acme Tools Inc.', 'Acme Tools'), ('Globex Corporation', 'Globex'), ('Initech  Holdings, LLC', 'Initech'), ('umbrella.com', 'umbrella'), ('Stark Industries Group Ltd', 'Stark Industries'), ('Wayne Co.', 'Wayne'), ('Hooli', 'Hooli'))
SELECT cleaned AS supplier_norm, count(*) AS rows FROM m JOIN n ON raw = supplier GROUP BY ALL""")


def _overridden(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.createDataFrame([("eur ", 1998, None, 2.0), ("GBP", None, None, 0.5)], "currency string, year int, month int, rate double")
    doubled = rates(spark).union(rates(spark))  # repeated rates must not repeat rows
    out = normalise.convert(messy(spark, sf), "amount", "ccy", "d", normalise.override_rates(doubled, own))
    return out.select("id", "status", F.round("converted", 4).alias("converted"))


_add(
    "fx_overrides", _overridden,
    _FX + f""", j AS (SELECT x.*, CASE c WHEN 'USD' THEN 1.0 WHEN 'GBP' THEN 0.5 WHEN 'EUR' THEN CASE WHEN year(d) = 1998 THEN 2.0 ELSE r.rate END END::DOUBLE AS rate, coalesce(c = 'GBP' AND r.rate IS NULL, false) AS fell
  FROM x LEFT JOIN r ON r.currency = c AND r.year = year(d) AND r.month = month(d))
SELECT id, {_STATUS} AS status, CASE WHEN {_STATUS} IN ('converted', 'fallback') THEN round(x / rate, 4) END AS converted FROM j""",
)
_add(
    "number_stats", lambda spark, sf: profile.deep_stats(table(spark, sf, "customer").select(F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("balance"), F.col("c_mktsegment").alias("segment")), ["balance", "segment"]).select("column", "numeric", "min_number", "max_number", F.round("mean", 2).alias("mean"), F.round("stddev", 2).alias("stddev"), "all_upper", "all_lower"),
    """SELECT 'balance' AS "column", count(*) AS numeric, min(c_acctbal)::DOUBLE AS min_number, max(c_acctbal)::DOUBLE AS max_number, round(avg(c_acctbal)::DOUBLE, 2) AS mean, round(stddev_pop(c_acctbal::DOUBLE), 2) AS stddev, true AS all_upper, true AS all_lower FROM customer
UNION ALL SELECT 'segment', 0, NULL, NULL, NULL, NULL, bool_and(c_mktsegment = upper(c_mktsegment)), bool_and(c_mktsegment = lower(c_mktsegment)) FROM customer""",
)

_add(
    "column_suggestions", lambda spark, sf: suggest.suggest_columns(messy(spark, sf).select("id", "supplier", "date_text", "amount", "ccy"), "id"),
    MESSY + """, f AS (SELECT * FROM m ORDER BY id LIMIT 100), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE id % 7 <> 6) AS dates, count(*) FILTER (WHERE trim(ccy) <> '') AS codes,
  count(*) FILTER (WHERE amount IN ('1,234.50', '$99', '(250.00)', '1e3', '-7', '12 000', '00042')) AS numbers, count(*) FILTER (WHERE amount IN ('1,234.50', '$99', '1e3', '12 000', '00042')) AS positive, count(*) FILTER (WHERE amount <> '') AS amounts FROM f)
SELECT 'date' AS role, 'date_text' AS "column", round(dates / n, 3) AS score FROM c WHERE dates / n >= 0.6 UNION ALL SELECT 'currency', 'ccy', round(0.85 * codes / n, 3) FROM c
UNION ALL SELECT 'spend', 'amount', round(0.9::DOUBLE * (numbers / n) * amounts / n * CASE WHEN 2 * positive >= numbers THEN 1.2 ELSE 1 END, 3) FROM c WHERE numbers / n >= 0.7""",
)
_add(
    "executive_summary", _on_spend("supplier")(lambda b: panels.executive_summary(b, "invoice_date", "total_spend", "supplier").select("months", "total_spend", "suppliers", "reach_80")),
    BASE + f""", p AS (SELECT supplier, sum(total_spend) AS s FROM b GROUP BY 1), r AS (SELECT *, sum(s) OVER (ORDER BY s DESC, supplier ROWS UNBOUNDED PRECEDING) - s AS before, sum(s) OVER () AS t FROM p)
SELECT (SELECT count(DISTINCT date_trunc('month', invoice_date)) FROM b) AS months, (SELECT {dbl("sum(total_spend)")} FROM b) AS total_spend, count(*) AS suppliers, count(*) FILTER (WHERE before::DOUBLE < t::DOUBLE * 0.8) AS reach_80 FROM r""",
)


def _uploads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bills = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("po"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amt"))
    return typed.build_all({"messy": (messy(spark, sf), _MAPPING), "bills": (bills, {"amt": "total_spend", "po": "po_number"})})


_add(
    "typed_union", lambda spark, sf: _uploads(spark, sf)[0].groupBy("_source_table").agg(F.count("*").alias("rows"), F.count("total_spend").alias("spends"), F.count("invoice_date").alias("dates"), F.count("po_number").alias("orders")),
    MESSY + "SELECT 'messy' AS _source_table, count(*) AS rows, count(*) FILTER (WHERE amount IN ('1,234.50', '$99', '1e3', '-7', '12 000', '00042')) AS spends, count(*) FILTER (WHERE id % 7 <> 6) AS dates, 0::BIGINT AS orders FROM m UNION ALL SELECT 'bills', count(*), count(o_totalprice), 0, count(*) FROM orders",
)
_add(
    "typed_null_rows", lambda spark, sf: _uploads(spark, sf)[1].groupBy("_source_table").agg(F.count("*").alias("rows")),
    MESSY + "SELECT 'messy' AS _source_table, count(*) AS rows FROM m WHERE id % 7 = 6 OR amount NOT IN ('1,234.50', '$99', '1e3', '-7', '12 000', '00042') UNION ALL SELECT 'bills', count(*) FROM orders",
)
_DECIDED = [{"source_col": "supplier", "action": "AUTO", "mapped_to": "supplier_name"}, {"source_col": "plant", "action": "KEEP"}, {"source_col": "ccy", "action": "REVIEW", "mapped_to": "currency", "user_edited": True}, {"source_col": "term", "action": "DROP"}]
_add(
    "header_decisions", lambda spark, sf: headers.apply_decisions(messy(spark, sf), _DECIDED)[0].groupBy("supplier_name", "plant", "currency").agg(F.count("*").alias("rows")),
    MESSY + "SELECT supplier AS supplier_name, plant, ccy AS currency, count(*) AS rows FROM m GROUP BY ALL",
)

# Schema-level operators: a few strings on the driver -----------------------------------------
#: No cell of these tables is blank, so a view that can be built can be built on all rows.
_ALL_HELD = " AND ".join(f"trim({c}::VARCHAR) <> ''" for c in ("total_spend", "local_spend", "invoice_date", "supplier", "vendor_country", "region", "currency", "l1", "l2", "l3", "description", "po_document_date"))
_ENTRIES = ", ".join("(" + ", ".join(f"'{x}'" for x in (view, title, f, fields.FIELD_NAMES[f])) + f", {i})" for view, (title, needs) in (fields.DASHBOARDS | fields.LEVERS).items() for i, f in enumerate(needs))
_add(
    "procurement_views", lambda spark, sf: views.procurement_views(S.spend(spark, sf, "supplier", "part", "orders")).select("view", "title", "available", F.array_join("missing", ",").alias("missing")).join(views.usable_rows(S.filled(spark, sf, "supplier", "part", "orders"), {v: needs for v, (_, needs) in (fields.DASHBOARDS | fields.LEVERS).items()}).select("view", "rows"), "view"),
    BASE + f""", has AS (SELECT column_name FROM (DESCRIBE ({BASE} SELECT * FROM b))), e("view", title, field, shown, place) AS (VALUES {_ENTRIES}), held AS (SELECT count(*) AS n FROM b WHERE {_ALL_HELD})
SELECT "view", title, bool_and(column_name IS NOT NULL) AS available, coalesce(string_agg(shown, ',' ORDER BY place) FILTER (WHERE column_name IS NULL), '') AS missing, CASE WHEN bool_and(column_name IS NOT NULL) THEN any_value(n) ELSE 0 END AS rows
FROM e LEFT JOIN has ON column_name = field, held GROUP BY "view", title""",
)
_tagged = lambda spark, sf: messy(spark, sf).select(
    "supplier", "ccy", "country", "key_text", F.year("d").alias("made"), F.when(F.col("id") % 2 == 0, "H").when(F.col("id") % 7 == 1, " s ").alias("side"),
    S.pick("id", ["EA", "kg", "zz"]).alias("unit"), S.pick("id", ["DE", "FR", "12345-6789", "n/a"]).alias("place"), F.lit(" ").alias("empty"),
)
_TAGGED = {
    "supplier": "supplier", "ccy": "ccy", "country": "country", "key_text": "key_text", "made": "year(d)::VARCHAR", "side": "CASE WHEN id % 2 = 0 THEN 'H' WHEN id % 7 = 1 THEN ' s ' END",
    "unit": "['EA', 'kg', 'zz'][id % 3 + 1]", "place": "['DE', 'FR', '12345-6789', 'n/a'][id % 4 + 1]", "empty": "' '",
}
_within = lambda words: "lower(v) IN (" + ", ".join(f"'{w}'" for w in words) + ")"
_TAGS = {
    "currency_code": ("regexp_full_match(v, '[A-Z]{3}')", 30), "country_iso2": ("regexp_full_match(v, '[A-Z]{2}')", 30), "country_name": (_within(fields.COUNTRY_WORDS), 20),
    "year": ("regexp_full_match(v, '(19|20)[0-9]{2}')", 30), "uom": (_within(fields.UNIT_WORDS), 20), "postal_code": ("regexp_full_match(v, '[0-9]{4,6}(-[0-9]{4})?')", 30),
    "debit_credit": (_within(fields.DEBIT_CREDIT_WORDS), 30),
}
_add(
    "semantic_tags", lambda spark, sf: insights.semantic_tags(_tagged(spark, sf), [*_TAGGED]).select("column", F.array_join("tags", ",").alias("tags")),
    MESSY + ", c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, trim({v}) AS v FROM m" for k, v in _TAGGED.items()) + ") SELECT name AS \"column\", concat_ws(',', "
    + ", ".join(f"CASE WHEN 100 * count(*) FILTER (WHERE v <> '' AND {cond}) >= {least} * count(*) FILTER (WHERE v <> '') AND count(*) FILTER (WHERE v <> '') > 0 THEN '{tag}' END" for tag, (cond, least) in _TAGS.items())
    + ") AS tags FROM c GROUP BY name",
)
_add(
    "dates_rewritten", lambda spark, sf: normalise.rewritten_dates(messy(spark, sf), "date_text", "dd/MM/yyyy").select("id", "date_text", "date_text_norm"),
    MESSY + "SELECT id, date_text, CASE WHEN id % 7 <> 6 THEN strftime(d, '%d/%m/%Y') ELSE '' END AS date_text_norm FROM m",
)
_add(
    "decision_sheet_round_trip", lambda spark, sf: headers.apply_decisions(messy(spark, sf), headers.sheet_decisions(headers.decision_sheet(messy(spark, sf), _DECIDED)))[0].groupBy("supplier_name", "plant", "currency").agg(F.count("*").alias("rows")),
    MESSY + "SELECT supplier AS supplier_name, plant, ccy AS currency, count(*) AS rows FROM m GROUP BY ALL",
)

# Intake --------------------------------------------------------------------------------------
for _name, (_query, _sql) in intake.QUERIES.items():
    _add(_name, _query, _sql)
