"""Queries of intake: columns that belong together, workbooks, regions and dates by file; and the SQL that says the same."""

from __future__ import annotations

import io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.functions import fields
from spendloom.operators import assess, headers, matching, normalise, pairing, panels, shipping, typed, views
from spendloom.plans.messy import MESSY, messy
from spendloom.plans.spend import BASE, filled, pick, spend, table
from spendloom.sources import workbooks

_TABLES = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


def _cells(name: str) -> str:
    """(column, position, text) of every cell of a table."""
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {i} AS pos, {c}::VARCHAR AS v FROM {name}" for i, c in enumerate(_TABLES[name]))


_RENAMED = {"c_acctbal": "O Totalprice", "c_name": "o_orderpriorit"}


def common_columns(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.find_common(table(spark, sf, "customer").withColumnsRenamed(_RENAMED), table(spark, sf, "orders"))


COMMON_SQL = f"""WITH RECURSIVE a AS (SELECT DISTINCT * FROM ({_cells('customer')}) WHERE trim(v) <> ''), b AS (SELECT DISTINCT * FROM ({_cells('orders')}) WHERE trim(v) <> ''),
sizes AS (SELECT col, pos, count(*) AS n FROM a GROUP BY ALL),
shares AS (
  SELECT s.col AS base, s.pos AS base_pos, o.col AS other, o.pos AS other_pos, count(b.v)::DOUBLE / any_value(n) AS share
  FROM sizes s CROSS JOIN (SELECT DISTINCT col, pos FROM b) o JOIN a ON a.col = s.col LEFT JOIN b ON b.col = o.col AND b.v = a.v GROUP BY ALL),
named(base, other, kind, strong) AS (VALUES ('c_acctbal', 'o_totalprice', 'header_exact', true), ('c_name', 'o_orderpriority', 'header_fuzzy', false), ('c_custkey', 'o_custkey', 'header_fuzzy', false)),
open_base AS (SELECT base, row_number() OVER (ORDER BY min(base_pos)) AS k, list(struct_pack(s := share, p := -other_pos, o := other)) AS offers FROM shares WHERE base NOT IN (SELECT base FROM named) GROUP BY base),
walk(k, used, base, other, share) AS (
  SELECT 0::BIGINT, (SELECT list(other) FROM named), NULL::VARCHAR, NULL::VARCHAR, 0::DOUBLE
  UNION ALL
  SELECT k, CASE WHEN best.s > 0.3 THEN list_append(used, best.o) ELSE used END, base, best.o, best.s
  FROM (SELECT o.k, used, o.base, list_max(list_filter(offers, lambda x: NOT list_contains(used, x.o))) AS best FROM walk w JOIN open_base o ON o.k = w.k + 1)),
found AS (
  SELECT named.base, named.other, kind, share, strong FROM named JOIN shares ON shares.base = named.base AND shares.other = named.other
  UNION ALL SELECT base, other, 'value_overlap', share, share >= 0.85 FROM walk WHERE share > 0.3)
SELECT CASE base WHEN 'c_acctbal' THEN 'O Totalprice' WHEN 'c_name' THEN 'o_orderpriorit' ELSE base END AS base_col, other AS source_col, kind AS match_type, round(share * 100, 1) AS overlap_pct, strong AS is_strong FROM found"""


def ranked_keys(spark: SparkSession, sf: str) -> DataFrame:
    found = pairing.match_keys(table(spark, sf, "orders"), table(spark, sf, "customer"))
    return found.withColumns({c: F.round(c, 6) for c in ("match_rate_distinct", "cardinality_diff_abs")})


_KEYED = "SELECT DISTINCT col, CASE WHEN regexp_matches(trim(v), '[0-9]') AND regexp_matches(trim(v), '^[0-9eE.+-]+$') THEN coalesce(try_cast(trim(v) AS DOUBLE)::VARCHAR, lower(trim(v))) ELSE lower(trim(v)) END AS v FROM ({}) WHERE trim(v) <> ''"
_RATIO = "SELECT col, (count(*) FILTER (WHERE regexp_matches(trim(v), '[0-9]') AND regexp_matches(trim(v), '^[0-9eE.+-]+$')))::DOUBLE / count(*) AS r FROM ({}) WHERE trim(v) <> '' GROUP BY col"
_TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ('id', 'key', 'code', 'num', 'no', 'number'))"
KEYS_SQL = f"""WITH a AS ({_KEYED.format(_cells('orders'))}), b AS ({_KEYED.format(_cells('customer'))}),
na AS (SELECT col, count(*) AS n, r FROM a JOIN ({_RATIO.format(_cells('orders'))}) USING (col) GROUP BY col, r), nb AS (SELECT col, count(*) AS n, r FROM b JOIN ({_RATIO.format(_cells('customer'))}) USING (col) GROUP BY col, r),
pairs AS (
  SELECT na.col AS f, nb.col AS d, na.n AS nf, nb.n AS nd, greatest(na.n, nb.n)::DOUBLE / least(na.n, nb.n) AS ratio, len(list_intersect({_TOKENS.format('na.col')}, {_TOKENS.format('nb.col')})) > 0 AS shared,
    regexp_matches(na.col, 'id|key|code|num|_no') <> regexp_matches(nb.col, 'id|key|code|num|_no') AS mixed
  FROM na, nb WHERE na.n >= 3 AND nb.n >= 3 AND NOT ((na.r >= 0.8 AND nb.r < 0.2) OR (nb.r >= 0.8 AND na.r < 0.2))),
met AS (SELECT a.col AS f, b.col AS d, count(*) AS k FROM a JOIN b USING (v) GROUP BY ALL)
SELECT f AS main_column, d AS dimension_column, nf AS main_distinct, nd AS dim_distinct, k AS distinct_matches, round(k::DOUBLE / nf, 6) AS match_rate_distinct, round(abs(nd::DOUBLE / nf - 1), 6) AS cardinality_diff_abs,
  row_number() OVER (ORDER BY nd DESC, k DESC, k::DOUBLE / nf DESC, abs(nd::DOUBLE / nf - 1), d, f)::INT AS rank
FROM pairs JOIN met USING (f, d) WHERE shared OR NOT (ratio > 10 OR (mixed AND ratio > 6))"""

_REGIONS = ["EMEA", "north zone", "", "apac", "Germany", "south", "None"]


def _with_regions(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).withColumn("region", pick("id", _REGIONS))


def regions_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.inferred_regions(_with_regions(spark, sf), "region", "country").groupBy("region", "country", "region_norm", "region_via").agg(F.count("*").alias("rows"))


REGIONS_SQL = MESSY + f""", g AS (SELECT *, {_REGIONS!r}[id % {len(_REGIONS)} + 1] AS region FROM m),
n(raw, r) AS (VALUES ('us', 'NA'), ('U.S.A.', 'NA'), ('DEU', 'EMEA'), ('Germany', 'EMEA'), ('gb', 'EMEA'), ('jp', 'APAC')),
x AS (SELECT g.country, g.region, n.r AS of_country, region IN ('', 'None') AS blank, CASE region WHEN 'EMEA' THEN 'EMEA' WHEN 'apac' THEN 'APAC' WHEN 'Germany' THEN 'EMEA' END AS told FROM g LEFT JOIN n ON n.raw = g.country),
c AS (SELECT region, of_country AS inferred FROM x WHERE NOT blank AND told IS NULL AND of_country IS NOT NULL GROUP BY region, of_country QUALIFY row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, of_country) = 1)
SELECT region, country, CASE WHEN blank THEN of_country ELSE coalesce(told, inferred, region) END AS region_norm,
  CASE WHEN blank THEN CASE WHEN of_country IS NULL THEN 'unresolved' ELSE 'country' END WHEN told IS NOT NULL THEN 'lookup' WHEN inferred IS NOT NULL THEN 'inferred' ELSE 'unresolved' END AS region_via, count(*) AS rows
FROM x LEFT JOIN c USING (region) GROUP BY ALL"""


def date_metrics_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.date_metrics(messy(spark, sf), "date_text", "file")


_FORM = "CASE id % 7 WHEN 0 THEN 'YYYY-MM-DD' WHEN 1 THEN 'DD/MM/YYYY' WHEN 2 THEN 'DD.MM.YYYY' WHEN 3 THEN 'YYYYMMDD' WHEN 4 THEN 'DD-Mon-YYYY' ELSE 'other' END"
DATES_SQL = MESSY + f""", c AS (SELECT file, {_FORM} AS format, count(*) AS rows, min(date_text) AS example FROM m GROUP BY ALL),
y AS (SELECT min(y) AS min_year, max(y) AS max_year FROM (SELECT nullif(regexp_extract(date_text, '((?:19|20)\\d\\d)', 1), '')::INT AS y FROM m))
SELECT file, format, rows, round_even(rows * 100.0 / sum(rows) OVER (PARTITION BY file), 0)::INT AS pct, example, row_number() OVER (PARTITION BY file ORDER BY rows DESC, format) = 1 AS dominant,
  count(*) OVER (PARTITION BY file) = 1 AS consistent, 'DMY' AS date_order, min_year, max_year FROM c, y"""


def fx_workbook_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Each month's highest order by status, laid out as an exchange-rate sheet, written as a workbook and read back."""
    months = F.array(*map(F.lit, workbooks.MONTHS))
    by_month = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("Years"), F.month("o_orderdate").alias("m")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    # As many rows as there are months.
    sheet = by_month.orderBy("Years", "m").select("Years", F.element_at(months, F.col("m")).alias("Months"), "F", "O", "P")
    data = io.BytesIO()
    workbooks.write_tables({"Rates": sheet}, data)
    path = shipping.put(spark, f"{shipping.shared_dir(spark)}/rates-{uuid.uuid4().hex}/fx.xlsx", data.getvalue())
    return workbooks.fx_rates(workbooks.read_workbooks(spark, path))


FX_SQL = "SELECT o_orderstatus AS currency, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, max(o_totalprice) AS rate FROM orders GROUP BY ALL"

_SCORED = ["amount", "supplier", "country", "term", "key_text", "date_text"]


def analysis_scores(spark: SparkSession, sf: str) -> DataFrame:
    return assess.analysis_scores(messy(spark, sf), _SCORED)


SCORES_SQL = MESSY + f""", cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM m" for c in _SCORED)}),
k AS (SELECT col, nullif(trim(v), '') AS v, regexp_matches(trim(v), '[0-9]') AND regexp_matches(trim(v), '^[0-9eE.+-]+$') AS num FROM cells),
s AS (SELECT col, count(*) AS rows, count(v) AS non_null, count(DISTINCT CASE WHEN num THEN coalesce(try_cast(v AS DOUBLE)::VARCHAR, lower(v)) ELSE lower(v) END) AS d, count(*) FILTER (WHERE num AND v IS NOT NULL) AS nums FROM k GROUP BY col),
r AS (SELECT *, non_null::DOUBLE / rows AS fill, d::DOUBLE / non_null AS u, nums::DOUBLE / non_null AS num FROM s),
q AS (SELECT *, round_even((0.7::DOUBLE * fill + 0.3::DOUBLE * least(u, 1.0::DOUBLE)) * 100, 0)::INT AS quality, round_even((0.6::DOUBLE * fill + 0.4::DOUBLE * (1.0::DOUBLE - abs(0.5::DOUBLE - num))) * 100, 0)::INT AS consistency FROM r)
SELECT col AS "column", rows, non_null, d AS distinct_values, round(fill, 4) AS fill, round(num, 4) AS numeric_ratio, quality, consistency, round_even(0.55::DOUBLE * quality + 0.45::DOUBLE * consistency, 0)::INT AS usability,
  CASE WHEN num >= 0.8 THEN 'numeric' ELSE 'text' END AS inferred_type, CASE WHEN num >= 0.8 THEN 'mostly_numeric' WHEN num <= 0.2 THEN 'mostly_text' ELSE 'mixed_numeric_text' END || CASE WHEN fill >= 0.95 THEN ',high_fill' ELSE '' END AS patterns,
  'filter,group' || CASE WHEN num >= 0.8 THEN ',sum,avg' ELSE '' END AS analyses, round_even((SELECT avg(fill) FROM q) * 100, 0)::INT AS overall FROM q"""


def append_written(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"customers": table(spark, sf, "customer"), "suppliers": table(spark, sf, "supplier"), "parts": table(spark, sf, "part")}
    mappings = {"customers": {"c_name": "NAME", "c_mktsegment": "KIND"}, "suppliers": {"s_name": "NAME"}, "parts": {"p_name": "NAME", "p_type": "KIND"}}
    return matching.append_written(tables, mappings, ["NAME", "KIND"], f"{shipping.shared_dir(spark)}/appended-{uuid.uuid4().hex}")


APPEND_SQL = """SELECT 'customers' AS "table", count(*) AS rows, count(*) AS written, count(*) FILTER (WHERE trim(c_name) <> '') + count(*) FILTER (WHERE trim(c_mktsegment) <> '') AS filled, true AS intact FROM customer
UNION ALL SELECT 'suppliers', count(*), count(*), count(*) FILTER (WHERE trim(s_name) <> ''), true FROM supplier
UNION ALL SELECT 'parts', count(*), count(*), count(*) FILTER (WHERE trim(p_name) <> '') + count(*) FILTER (WHERE trim(p_type) <> ''), true FROM part"""

#: Headers as uploads have them, over columns of messy().
_UPLOADED = {"id": "EBELN", "d": "Inv Dt", "supplier": "VendorName", "country": "Land1", "term": "Payment Trms", "plant": "Plnt", "amount": "inv amt", "ccy": "WAERS", "date_text": "zzz", "key_text": "Unnamed: 3", "file": "File"}


def header_match_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return headers.match_table(messy(spark, sf).withColumnsRenamed(_UPLOADED))


_FILLED = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) FILTER (WHERE trim({c}::VARCHAR) <> '') AS filled FROM m" for c in _UPLOADED)
TIERS_SQL = MESSY + f""", t(header, field, tier, score, col) AS (VALUES ('EBELN', 'po_number', 'alias', 1.0::DOUBLE, 'id'), ('Inv Dt', 'invoice_date', 'abbreviation', 1.0, 'd'), ('File', NULL, 'pending', 0.425, 'file'), ('VendorName', 'supplier', 'camel', 1.0, 'supplier'),
  ('Land1', 'vendor_country', 'alias', 1.0, 'country'), ('Payment Trms', 'payment_terms', 'fuzzy', 0.7792, 'term'), ('Plnt', 'plant', 'fuzzy', 0.6667, 'plant'), ('inv amt', 'total_spend', 'abbreviation', 1.0, 'amount'), ('WAERS', 'currency', 'alias', 1.0, 'ccy'),
  ('zzz', NULL, 'pending', 0.1312, 'date_text'), ('Unnamed: 3', NULL, 'drop', 1.0, 'key_text'))
SELECT header, field, tier, score, filled FROM t JOIN ({_FILLED}) USING (col)"""


def view_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    return views.usable_rows(filled(spark, sf, "supplier"), views.VIEW_FIELDS).withColumn("missing", F.array_join("missing", ","))


FEASIBLE_SQL = BASE + """, n AS (SELECT count(*) AS n FROM b WHERE total_spend IS NOT NULL AND local_spend IS NOT NULL AND invoice_date IS NOT NULL AND trim(supplier) <> '' AND trim(currency) <> '' AND trim(vendor_country) <> '')
SELECT "view", available, missing, CASE WHEN available THEN n ELSE 0 END AS rows FROM n, (VALUES ('spend_over_time', true, ''), ('supplier_ranking', true, ''), ('pareto', true, ''), ('currency_spend', true, ''), ('country_spend', true, ''), ('l1_spend', false, 'l1'),
  ('l1_vs_l2', false, 'l1,l2'), ('l2_vs_l3', false, 'l1,l2,l3'), ('category_drilldown', false, 'l1')) t("view", available, missing)"""


def feasibility_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Views on an upload as it was cast: a row counts where all that a view needs could be read."""
    cast = typed.build(messy(spark, sf), {"amount": "total_spend", "date_text": "invoice_date", "supplier": "supplier", "country": "vendor_country"})
    return views.usable_rows(cast, views.VIEW_FIELDS).withColumn("missing", F.array_join("missing", ","))


REGISTRY_SQL = MESSY + """, x AS (SELECT amount IN ('1,234.50', '$99', '1e3', '-7', '12 000', '00042') AS a, id % 7 <> 6 AS d, trim(country) <> '' AS c FROM m), n AS (SELECT count(*) FILTER (WHERE a AND d) AS ad, count(*) FILTER (WHERE a) AS s, count(*) FILTER (WHERE a AND c) AS ac FROM x)
SELECT "view", available, missing, CASE k WHEN 1 THEN ad WHEN 2 THEN s WHEN 3 THEN ac ELSE 0 END AS rows FROM n, (VALUES ('spend_over_time', true, '', 1), ('supplier_ranking', true, '', 2), ('pareto', true, '', 2), ('currency_spend', false, 'currency,local_spend', 0), ('country_spend', true, '', 3),
  ('l1_spend', false, 'l1', 0), ('l1_vs_l2', false, 'l1,l2', 0), ('l2_vs_l3', false, 'l1,l2,l3', 0), ('category_drilldown', false, 'l1', 0)) t("view", available, missing, k)"""


def header_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Like headers of two tables, and in how many rows each holds a value."""
    base, source = table(spark, sf, "customer"), table(spark, sf, "supplier").withColumnRenamed("s_name", "cname")
    pairs = spark.createDataFrame(matching.header_pairs(base.columns, source.columns), "base string, source string, score double")
    filled = lambda df, c, n: assess.populated(df, df.columns).select(F.col("column").alias(c), F.col("populated").alias(n))
    return pairs.join(filled(base, "base", "base_filled"), "base").join(filled(source, "source", "source_filled"), "source")


JACCARD_SQL = """SELECT base, source, score, n AS base_filled, k AS source_filled FROM (VALUES ('c_name', 'cname', 0.9091::DOUBLE), ('c_nationkey', 's_nationkey', 0.9091::DOUBLE), ('c_acctbal', 's_acctbal', 0.8889::DOUBLE)) t(base, source, score),
(SELECT count(*) FILTER (WHERE trim(c_name) <> '' AND c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL) AS n FROM customer), (SELECT count(*) FILTER (WHERE trim(s_name) <> '' AND s_nationkey IS NOT NULL AND s_acctbal IS NOT NULL) AS k FROM supplier)"""

_SUMMED = ["invoice_date", "supplier", "description", "total_spend"]


def executive_figures(spark: SparkSession, sf: str) -> DataFrame:
    return panels.executive_figures(spend(spark, sf, "supplier", "part").select(*_SUMMED), "invoice_date", "total_spend", "supplier", "description")


def _figures(panel: str, source: str, *figures: str, prefix: str = "") -> str:
    """One row a figure: `name` or `name: expression` over a source."""
    each = [f.partition(": ") for f in figures]
    return " UNION ALL ".join(f"SELECT '{panel}' AS panel, {prefix}'{name}' AS figure, ({x or name})::DOUBLE AS value FROM {source}" for name, _, x in each)


_CENTS = "round(coalesce({}, 0)::DOUBLE, 2)"
FIGURES_SQL = BASE + f""", mo AS (SELECT year(invoice_date) AS y, month(invoice_date) AS m, sum(total_spend) AS s FROM b GROUP BY ALL), las AS (SELECT max(y * 12 + m) AS i FROM mo),
sp AS (SELECT supplier, sum(total_spend) AS s FROM b GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY s DESC, supplier) AS k, sum(s) OVER (ORDER BY s DESC, supplier ROWS UNBOUNDED PRECEDING) AS cum, sum(s) OVER () AS t FROM sp),
pr AS (SELECT supplier, description AS d, count(*) AS n, sum(total_spend) AS s FROM b GROUP BY ALL), tx AS (SELECT d AS v, sum(n) AS n FROM pr GROUP BY 1),
ps AS (SELECT supplier, sum(s) AS s, sum(n) AS n, count(d) AS pairs FROM pr GROUP BY 1), pk AS (SELECT *, sum(s) OVER w - s AS before, sum(s) OVER () AS t FROM ps WINDOW w AS (ORDER BY s DESC, supplier ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT p, count(*) AS suppliers, {_CENTS.format('sum(s)')} AS total_spend, sum(n) AS transactions, sum(pairs) AS pairs FROM pk, (VALUES (80), (85), (90), (95)) c(p) WHERE before::DOUBLE < t::DOUBLE * (p / 100.0::DOUBLE) GROUP BY p),
ef AS (SELECT sum(n) AS rows, count(*) AS pairs, sum(length(d) * n) AS chars, sum(len(string_split_regex(d, '\\s+')) * n) AS words, sum(length(d)) AS pc FROM pr)
{_figures('date_period', '(SELECT min(invoice_date)::DATE AS lo, max(invoice_date)::DATE AS hi FROM b), (SELECT count(*) AS n FROM mo)', "first_date: date_diff('day', DATE '1970-01-01', lo)", "last_date: date_diff('day', DATE '1970-01-01', hi)", 'months: n')}
UNION ALL SELECT 'spend_breakdown', 'last twelve months', {_CENTS.format('sum(s)')} FROM mo, las WHERE y * 12 + m BETWEEN i - 12 AND i - 1
UNION ALL SELECT 'spend_breakdown', 'fy ' || y, {_CENTS.format('sum(s)')} FROM mo GROUP BY y
UNION ALL (SELECT 'spend_breakdown', 'latest full year', {_CENTS.format('sum(s)')} FROM mo GROUP BY y HAVING count(*) = 12 ORDER BY y DESC LIMIT 1)
UNION ALL {_figures('supplier_breakdown', '(SELECT count(*) AS n, min(k) FILTER (WHERE cum::DOUBLE >= t::DOUBLE * (80 / 100.0::DOUBLE)) AS r, round(sum(s) FILTER (WHERE k <= 10)::DOUBLE / sum(s)::DOUBLE * 100, 2) AS top FROM rk)', 'suppliers: n', 'reach_80: r', 'case_variants: 0', 'top10_pct: top')}
UNION ALL {_figures('categorization_effort', 'ef', 'rows', 'pairs', 'avg_chars: round(chars::DOUBLE / rows, 2)', 'avg_words: round(words::DOUBLE / rows, 2)', 'cost_usd: round(pc / 4.0::DOUBLE * 2.5 / 1e6 + pairs * 20 * 10.0::DOUBLE / 1e6, 4)', prefix="CASE WHEN rows > 400000 THEN 'large ' ELSE 'small ' END || ")}
UNION ALL {" UNION ALL ".join(_figures('column_fill_rate', f"(SELECT count(*) AS n, count(*) FILTER (WHERE trim({c}::VARCHAR) <> '') AS f, sum(total_spend) AS t, sum(total_spend) FILTER (WHERE trim({c}::VARCHAR) <> '') AS s FROM b)", f'{c} filled: f', f'{c} fill_pct: round(f::DOUBLE / n * 100, 2)', f'{c} spend_pct: round(s::DOUBLE / t::DOUBLE * 100, 2)') for c in _SUMMED)}
UNION ALL SELECT 'date_pivot', y || ' m' || lpad(k::VARCHAR, 2, '0'), {_CENTS.format('sum(s) FILTER (WHERE m = k)')} FROM mo, range(1, 13) x(k) GROUP BY y, k
UNION ALL {_figures('bifurcation', 'b', *(f"{n}: {_CENTS.format(f'sum(total_spend) FILTER (WHERE {w})')}" for n, w in (('positive', 'total_spend > 0'), ('negative', 'total_spend < 0'), ('net', 'true'))), 'rows: count(*)')}
UNION ALL {_figures('pareto', 'pa', ' suppliers: suppliers', ' total_spend: total_spend', ' transactions: transactions', ' pairs: pairs', prefix='p || ')}
UNION ALL {_figures('description_quality', 'tx', 'rows: sum(n)', 'unique_values: count(*)', "one_word: coalesce(sum(n) FILTER (WHERE v NOT LIKE '% %'), 0)", "multi_word: coalesce(sum(n) FILTER (WHERE v LIKE '% %'), 0)", 'proxies: 0 * count(*)', "alphanumeric: coalesce(sum(n) FILTER (WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')), 0)", 'avg_chars: round(sum(length(v) * n)::DOUBLE / sum(n), 2)')}"""


def original_fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    bills = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("term"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amt"))
    return typed.original_fill({"messy": (messy(spark, sf), {"amount": "total_spend"}), "bills": (bills, {"amt": "total_spend"})}, {"ccy": "Currency Code"})


_MESSY = ["id", "d", "file", "supplier", "country", "term", "plant", "amount", "ccy", "date_text", "key_text"]
ORIGINAL_SQL = MESSY + f""", a(raw, x) AS (VALUES ('1,234.50', 1234.5), ('$99', 99), ('1e3', 1000), ('-7', -7), ('12 000', 12000), ('00042', 42)), k AS (SELECT m.*, coalesce(x, 0)::DOUBLE AS s FROM m LEFT JOIN a ON raw = amount),
e AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, {i} AS place, count(*) FILTER (WHERE trim({c}::VARCHAR) <> '') AS f, sum(s) FILTER (WHERE trim({c}::VARCHAR) <> '') AS cov FROM k" for i, c in enumerate(_MESSY))}
  UNION ALL SELECT 'term', 5, count(*), sum(o_totalprice) FROM orders UNION ALL SELECT 'amt', 11, count(*), sum(o_totalprice) FROM orders),
w AS (SELECT (SELECT count(*) FROM m) + (SELECT count(*) FROM orders) AS n, (SELECT sum(s) FROM k) + (SELECT sum(o_totalprice) FROM orders) AS t)
SELECT CASE col WHEN 'ccy' THEN 'Currency Code' ELSE col END AS column_name, col AS source_column, place::INT AS place, round(sum(f)::DOUBLE / any_value(n) * 100, 1) AS fill_rate, round(sum(cov) / any_value(t) * 100, 1) AS spend_coverage FROM e, w GROUP BY col, place"""

def suppliers_joined(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.suppliers(messy(spark, sf), "supplier").groupBy("supplier", "supplier_norm").agg(F.count("*").alias("rows"))


SUPPLIERS_SQL = MESSY + """, n(raw, cleaned) AS (VALUES ('Acme Tools Inc.', 'Acme Tools'), ('Globex Corporation', 'Globex'), ('Initech  Holdings, LLC', 'Initech'), ('umbrella.com', 'umbrella'), ('Stark Industries Group Ltd', 'Stark Industries'), ('Wayne Co.', 'Wayne'), ('Hooli', 'Hooli'))
SELECT supplier, cleaned AS supplier_norm, count(*) AS rows FROM m JOIN n ON raw = supplier GROUP BY ALL"""


def all_date_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = messy(spark, sf).select("id", "file", "date_text", F.date_format("d", "MM/dd/yyyy").alias("PO Date"), "plant")
    return normalise.all_dates(df, "file")


ALL_DATES_SQL = MESSY + """SELECT id, file, date_text, CASE WHEN id % 7 <> 6 THEN d END AS date_text_norm, strftime(d, '%m/%d/%Y') AS "PO Date", d AS "PO Date_norm", plant FROM m"""


def searchable_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = spend(spark, sf, "supplier", "part")
    return panels.searchable(df, "not procurable").withColumn("search", F.lit("not procurable")).union(panels.searchable(df, "intercompany").withColumn("search", F.lit("intercompany")))


SEARCHABLE_SQL = BASE + """SELECT field, shown, place, n AS filled, "search" FROM (SELECT count(*) AS n FROM b), (VALUES ('description', 'Description', 1, 'not procurable'), ('l1', 'Spend Classification L1', 2, 'not procurable'), ('l2', 'Spend Classification L2', 3, 'not procurable'),
  ('l3', 'Spend Classification L3', 4, 'not procurable'), ('supplier', 'Vendor Name', 5, 'not procurable'), ('supplier', 'Vendor Name', 1, 'intercompany'), ('vendor_country', 'Vendor Country', 2, 'intercompany')) t(field, shown, place, "search")"""


def intercompany_search(spark: SparkSession, sf: str) -> DataFrame:
    return panels.search_spend(spend(spark, sf, "supplier"), "intercompany", ["supplier", "vendor_country"], ["united", "Supplier#00000000", "%", " GERM "])


INTERCOMPANY_SQL = BASE + """SELECT k AS keyword, count(*) FILTER (WHERE hit) AS rows, round(coalesce(sum(total_spend) FILTER (WHERE hit), 0)::DOUBLE, 0) AS total_spend
FROM (SELECT k, total_spend, contains(lower(supplier), lower(k)) OR contains(lower(vendor_country), lower(k)) AS hit FROM b, (VALUES ('united'), ('Supplier#00000000'), ('%'), ('GERM')) w(k)) GROUP BY k"""


def terms_by_currency(spark: SparkSession, sf: str) -> DataFrame:
    return panels.terms_by_currency(spend(spark, sf, "supplier", "orders"), "term", "local_spend", "currency")


TERMS_SQL = BASE + """, p AS (SELECT term, currency, count(*) AS rows, sum(local_spend) AS s FROM b GROUP BY ALL)
SELECT term, currency, rows, round(s::DOUBLE, 2) AS spend, round((sum(s) OVER t)::DOUBLE, 2) AS term_spend, round((sum(s) OVER t)::DOUBLE / (sum(s) OVER ())::DOUBLE * 100, 2) AS spend_pct, round((sum(rows) OVER t)::DOUBLE / (sum(rows) OVER ())::DOUBLE * 100, 2) AS rows_pct FROM p WINDOW t AS (PARTITION BY term)"""


def currency_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return panels.currency_calendar(spend(spark, sf, "supplier"), "invoice_date", "local_spend", "currency")


CALENDAR_SQL = BASE + """, p AS (SELECT year(invoice_date) AS y, month(invoice_date) AS m, currency, sum(local_spend) AS s FROM b GROUP BY ALL)
SELECT f.y::INT AS year, f.k::INT AS month, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][f.k] || ' ' || f.y AS label, f.c AS currency, round(coalesce(s, 0)::DOUBLE, 0) AS spend
FROM (SELECT y, k, c FROM (SELECT DISTINCT y FROM p), range(1, 13) r(k), (SELECT DISTINCT currency AS c FROM p)) f LEFT JOIN p ON p.y = f.y AND p.m = f.k AND p.currency = f.c"""

_STANDARD = {"id": "PO #", "d": "inv date", "supplier": "SUPPLIER NAME", "country": " vendor nation", "term": "Pay Terms", "plant": "Site Name", "amount": "Total Spend (USD)", "ccy": "Currency Code", "date_text": "Currency", "key_text": "Material Code"}


def standard_fields(spark: SparkSession, sf: str) -> DataFrame:
    return headers.standard_table(messy(spark, sf).withColumnsRenamed(_STANDARD))


_HELD = {"invoice_po_number": "id", "invoice_date": "d", "supplier": "supplier", "vendor_country": "country", "payment_terms": "term", "plant_name": "plant", "total_spend": "amount", "currency": "ccy", "po_material_number": "key_text"}
STANDARD_SQL = MESSY + " UNION ALL ".join(
    f"SELECT '{f}' AS field, '{shown}' AS shown, '{_STANDARD[_HELD[f]]}' AS \"column\", count(*) FILTER (WHERE trim({_HELD[f]}::VARCHAR) <> '') AS filled FROM m" if f in _HELD else f"SELECT '{f}', '{shown}', NULL, 0" for f, shown in sorted(fields.FIELD_NAMES.items(), key=lambda x: x[0] not in _HELD)
)

QUERIES = {
    "common_columns": (common_columns, COMMON_SQL), "match_keys_ranked": (ranked_keys, KEYS_SQL), "regions_inferred": (regions_inferred, REGIONS_SQL),
    "date_metrics_by_file": (date_metrics_by_file, DATES_SQL), "fx_workbook_rates": (fx_workbook_rates, FX_SQL),
    "analysis_scores": (analysis_scores, SCORES_SQL), "append_written": (append_written, APPEND_SQL), "header_match_tiers": (header_match_tiers, TIERS_SQL), "view_feasibility": (view_feasibility, FEASIBLE_SQL),
    "suppliers_joined": (suppliers_joined, SUPPLIERS_SQL), "all_date_columns": (all_date_columns, ALL_DATES_SQL), "searchable_fields": (searchable_fields, SEARCHABLE_SQL), "intercompany_search": (intercompany_search, INTERCOMPANY_SQL),
    "terms_by_currency": (terms_by_currency, TERMS_SQL), "currency_calendar": (currency_calendar, CALENDAR_SQL),
    "standard_fields": (standard_fields, STANDARD_SQL),
    "executive_figures": (executive_figures, FIGURES_SQL), "original_fill_rates": (original_fill_rates, ORIGINAL_SQL),
    "feasibility_registry": (feasibility_registry, REGISTRY_SQL), "header_jaccard": (header_jaccard, JACCARD_SQL),
}
