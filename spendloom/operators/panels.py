"""Executive and data-quality panels over typed spend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import constants as K
from spendloom.operators import views
from spendloom.operators.running import leading, running, settled


def _sum(c: Column) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0)).cast("double"), 2)


def bifurcation(df: DataFrame, spend: str, by: str | None = None) -> DataFrame:
    """Positive, negative and net spend, of all or by a key."""
    s = F.col(spend)
    aggregates = [_sum(F.when(s > 0, s)).alias("positive"), _sum(F.when(s < 0, s)).alias("negative"), _sum(s).alias("net"), F.count("*").alias("rows")]
    return df.groupBy(F.col(by).alias("key")).agg(*aggregates) if by else df.agg(*aggregates)


def _months(df: DataFrame, date: str, spend: str) -> DataFrame:
    return views.by_month(df, date, spend).withColumn("index", F.col("year") * 12 + F.col("month"))


def date_period(df: DataFrame, date: str) -> DataFrame:
    months = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("y"), F.month(date).alias("m")).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return months.agg(F.min("lo").cast("date").alias("first_date"), F.max("hi").cast("date").alias("last_date"), F.count("*").alias("months"))


def ltm(df: DataFrame, date: str, spend: str) -> DataFrame:
    """The twelve months that end before the latest month."""
    months = _months(df, date, spend)
    last = months.agg(F.max("index").alias("last"))
    inside = months.join(F.broadcast(last), F.col("index").between(F.col("last") - 12, F.col("last") - 1), "right")
    return inside.groupBy("last").agg(_sum(F.col("spend")).alias("ltm_spend")).select("ltm_spend", (F.col("last") - 12).alias("from_month"), (F.col("last") - 1).alias("to_month"))


def fiscal_years(df: DataFrame, date: str, spend: str, start_month: int = 1) -> DataFrame:
    """Spend by fiscal year with the change to the year before."""
    months = _months(df, date, spend).withColumn("fy", F.floor((F.col("index") - start_month) / 12).cast("int"))
    per = months.groupBy("fy").agg(F.sum("spend").alias("spend"), F.count("*").alias("months"))
    before = per.select((F.col("fy") + 1).alias("fy"), F.col("spend").alias("last"))
    joined = per.join(before, "fy", "left")
    change = F.round((F.col("spend").cast("double") - F.col("last").cast("double")) / F.nullif(F.col("last").cast("double"), F.lit(0.0)) * 100, 2)
    return joined.select("fy", "months", F.round(F.col("spend").cast("double"), 2).alias("total_spend"), change.alias("yoy_pct"))


def latest_full_year(df: DataFrame, date: str, spend: str) -> DataFrame:
    full = _months(df, date, spend).groupBy("year").agg(F.sum("spend").alias("spend"), F.count("*").alias("n")).where("n = 12")
    return full.orderBy(F.desc("year")).limit(1).select("year", F.round(F.col("spend").cast("double"), 2).alias("total_spend"))


def cohort(df: DataFrame, supplier: str, spend: str, percent: float = 80) -> DataFrame:
    """Trimmed names of the suppliers that reach percent of net spend."""
    named = df.where(C.non_blank(supplier)).groupBy(F.trim(supplier).alias("supplier")).agg(F.sum(spend).alias("spend"))
    return leading(named, "spend", "supplier", percent)


def supplier_breakdown(df: DataFrame, supplier: str, spend: str) -> DataFrame:
    """Suppliers, how many reach 80 %, the share of the top ten, spellings that differ in case."""
    named = settled(df.where(C.non_blank(supplier)).groupBy(F.trim(supplier).alias("supplier")).agg(F.sum(spend).alias("spend")))
    reach = leading(named, "spend", "supplier", 80).agg(F.count("*").alias("reach_80"))
    top = named.orderBy(F.desc("spend"), "supplier").limit(10).agg(F.sum("spend").alias("top"))
    variants = named.groupBy(F.lower("supplier").alias("k")).agg(F.count("*").alias("n"), F.sum("spend").alias("spend"))
    all_ = variants.agg(F.sum("n").cast("long").alias("suppliers"), F.sum("spend").alias("total"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("case_variants"))
    return all_.join(F.broadcast(reach)).join(F.broadcast(top)).select("suppliers", "reach_80", "case_variants", C.percent(F.col("top"), F.col("total")).alias("top10_pct"))


def name_variants(df: DataFrame, name: str) -> DataFrame:
    """Spellings of one name that differ in case or spaces only."""
    per = df.where(C.non_blank(name)).groupBy(F.lower(F.trim(name)).alias("key"), F.col(name).alias("spelling")).agg(F.count("*").alias("n"))
    return per.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("n").cast("long").alias("rows")).where("spellings > 1")


def pareto_thresholds(df: DataFrame, supplier: str, spend: str, description: str, percents: tuple[int, ...] = (80, 85, 90, 95)) -> DataFrame:
    """Suppliers, spend, transactions and supplier-description pairs up to each share of positive spend.

    Rows are reduced to suppliers once; the cuts are then read off one running total.
    """
    rows = df.where(F.col(spend) > 0).groupBy(F.col(supplier).alias("supplier"), F.col(description).alias("d")).agg(F.sum(spend).alias("spend"), F.count("*").alias("n"))
    return _pareto_of(rows, percents)


def _pareto_of(rows: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    """pareto_thresholds of rows (supplier, d, spend, n), one a supplier and description."""
    per = rows.groupBy("supplier").agg(F.sum("spend").alias("spend"), F.sum("n").alias("n"), F.count("d").alias("pairs"))
    ranked = running(per, "spend", "supplier")
    part = ranked.cumulative.cast("double") - ranked.spend.cast("double")
    each = ranked.select("spend", "n", "pairs", F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), (part < ranked.total.cast("double") * (p / 100)).alias("inside")) for p in percents))).alias("x")).where("x.inside")
    return each.groupBy("x.percent").agg(F.count("*").alias("suppliers"), _sum(F.col("spend")).alias("total_spend"), F.sum("n").cast("long").alias("transactions"), F.sum("pairs").cast("long").alias("pairs"))


def date_pivot(df: DataFrame, date: str, spend: str) -> DataFrame:
    """Year by month, months without spend 0."""
    months = views.by_month(df, date, spend).where(F.col("year").between(1900, 2100))
    return months.groupBy("year").agg(*(_sum(F.when(F.col("month") == m, F.col("spend"))).alias(f"m{m:02d}") for m in range(1, 13)))


def currency_crosstab(df: DataFrame, date: str, spend: str, currency: str, codes: list[str]) -> DataFrame:
    """Month by currency; the codes are named, so no job has to find them."""
    per = df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year"), F.month(date).alias("month"))
    return per.agg(*(_sum(F.when(F.col(currency) == c, F.col(spend))).alias(c.lower()) for c in codes))


def top_and_others(df: DataFrame, key: str, spend: str, k: int = 5, rest: str = "Others") -> DataFrame:
    """Rows and spend of the k largest keys; all others together."""
    per = df.groupBy(F.col(key).alias("key")).agg(F.sum(spend).alias("spend"), F.count("*").alias("n"))
    top = per.orderBy(F.desc("spend"), "key").limit(k).select("key", F.lit(True).alias("top"))
    named = per.join(F.broadcast(top), "key", "left").withColumn("name", F.when(F.col("top"), F.col("key")).otherwise(F.lit(rest)))
    return named.groupBy(F.col("name").alias("key")).agg(F.sum("n").cast("long").alias("rows"), _sum(F.col("spend")).alias("total_spend"))


def terms_panel(df: DataFrame, term: str, spend: str) -> DataFrame:
    per = df.where(C.non_blank(term)).groupBy(F.trim(term).alias("term")).agg(F.sum(spend).alias("spend"), F.count("*").alias("rows"))
    total = per.agg(F.sum("spend").alias("total"), F.sum("rows").alias("all"))
    return per.join(F.broadcast(total)).select("term", "rows", F.round(F.col("spend").cast("double"), 2).alias("total_spend"), C.percent(F.col("spend"), F.col("total")).alias("spend_pct"), C.percent(F.col("rows"), F.col("all")).alias("rows_pct"))


def keyword_spend(df: DataFrame, columns: list[str], keyword: str, spend: str) -> DataFrame:
    """Rows with the keyword in any of the columns, and their spend."""
    hit = df.where(C.contains(columns, keyword))
    return hit.agg(F.count("*").alias("rows"), _sum(F.col(spend)).alias("total_spend"))


#: Fields that a keyword is looked for in, by the search that offers them, in the order they are shown, with their names.
SEARCHABLE = {
    "not procurable": {
        "description": "Description", "po_material_description": "PO Material Description", "l1": "Spend Classification L1", "l2": "Spend Classification L2", "l3": "Spend Classification L3",
        "l4": "Spend Classification L4", "supplier": "Vendor Name", "business_unit": "Business Unit", "plant_name": "Plant Name",
    },
    "intercompany": {"supplier": "Vendor Name", "vendor_country": "Vendor Country"},
}


def searchable(df: DataFrame, search: str) -> DataFrame:
    """(field, shown, place, filled): the fields of a table that a search offers, and how many rows have a value there."""
    offered = [f for f in SEARCHABLE[search] if f in df.columns]
    counts = df.agg(*(F.count(F.when(C.non_blank(f), 1)).alias(f"n{i}") for i, f in enumerate(offered)), F.lit(1).alias("one"))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(SEARCHABLE[search][f]).alias("shown"), F.lit(i + 1).alias("place"), F.col(f"n{i}").alias("filled")) for i, f in enumerate(offered)))
    return counts.select(F.explode(each).alias("x")).select("x.*")


def search_spend(df: DataFrame, search: str, columns: list[str], keywords: list[str], spend: str = "total_spend") -> DataFrame:
    """(keyword, rows, total_spend) for each keyword found in any of the columns, without regard to case; one scan for all.

    The keyword is taken as it is, whatever signs it holds. Blank keywords, no columns and columns
    that the search does not offer are refused.
    """
    words = [k.strip() for k in keywords]
    if not words or not all(words):
        raise ValueError("a keyword must not be empty")
    if not columns or (bad := [c for c in columns if c not in SEARCHABLE[search]]):
        raise ValueError("no column is given" if not columns else f"columns that this search does not offer: {bad}")
    hit = lambda k: C.contains(columns, k)
    cells = [x for i, k in enumerate(words) for x in (F.count(F.when(hit(k), 1)).alias(f"n{i}"), F.sum(F.when(hit(k), F.col(spend))).alias(f"s{i}"))]
    each = F.array(*(F.struct(F.lit(k).alias("keyword"), F.col(f"n{i}").alias("rows"), F.round(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("double"), 0).alias("total_spend")) for i, k in enumerate(words)))
    return df.agg(*cells).select(F.explode(each).alias("x")).select("x.*")


def terms_by_currency(df: DataFrame, term: str, spend: str, currency: str) -> DataFrame:
    """(term, currency, rows, spend, term_spend, spend_pct, rows_pct): payment terms with the spend of each currency.

    A term's own shares are of the spend of all terms and of all rows, also those without a
    term; rows without a currency count in the term alone, under a null currency.
    """
    code = F.when(C.non_blank(currency), F.upper(F.trim(C.text(currency))))
    name = F.when(C.non_blank(term), F.trim(C.text(term)))
    per = df.groupBy(name.alias("term"), code.alias("currency")).agg(F.count("*").alias("rows"), F.sum(spend).alias("spend"))
    of_term, whole = Window.partitionBy("term"), Window.partitionBy()
    # Terms times currencies, counted already.
    per = per.withColumns({"_all": F.sum("rows").over(whole), "_spend": F.sum(F.when(F.col("term").isNotNull(), F.col("spend"))).over(whole), "_rows": F.sum("rows").over(of_term), "_term": F.sum("spend").over(of_term)})
    two = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)).cast("double"), 2)
    return per.where("term IS NOT NULL").select("term", "currency", "rows", two("spend").alias("spend"), two("_term").alias("term_spend"), C.percent(F.col("_term"), F.col("_spend")).alias("spend_pct"), C.percent(F.col("_rows"), F.col("_all")).alias("rows_pct"))


def currency_calendar(df: DataFrame, date: str, spend: str, currency: str) -> DataFrame:
    """(year, month, label, currency, spend): every month of the years that occur by every currency that occurs, 0 where nothing was spent."""
    code = F.upper(F.trim(C.text(currency)))
    per = df.where(F.col(date).isNotNull() & C.non_blank(currency)).groupBy(F.year(date).alias("year"), F.month(date).alias("month"), code.alias("currency")).agg(F.sum(spend).alias("spend"))
    per = per.where(F.col("year").between(1900, 2100))
    # One row of at most 201 years and as many currencies as there are.
    frame = per.agg(F.collect_set("year").alias("years"), F.collect_set("currency").alias("codes"))
    frame = frame.select(F.explode("years").alias("year"), "codes").select("year", F.explode("codes").alias("currency")).select("year", "currency", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    label = F.concat(F.get(F.array(*map(F.lit, K.MONTHS)), F.col("month") - 1), F.lit(" "), F.col("year").cast("string"))
    return frame.join(per, ["year", "month", "currency"], "left").select("year", "month", label.alias("label"), "currency", F.round(F.coalesce(F.col("spend"), F.lit(0)).cast("double"), 0).alias("spend"))


def non_procurable(df: DataFrame, description: str, spend: str, currency: str, keywords: list[str] = K.NON_PROCURABLE, k: int = 5) -> DataFrame:
    """Spend on rows whose description names taxes, duties and the like, by currency."""
    pattern = "(?i)(" + "|".join(keywords) + ")"
    return top_and_others(df.where(F.coalesce(F.col(description).rlike(pattern), F.lit(False))), currency, spend, k)


def description_stats(df: DataFrame, column: str) -> DataFrame:
    """Words, lengths, proxies and digits of a description column; values are counted first."""
    return _description_of(df.groupBy(F.trim(C.text(column)).alias("v")).agg(F.count("*").alias("n")).where(C.non_blank("v")))


def _description_of(per: DataFrame) -> DataFrame:
    """description_stats of distinct values v with their rows n."""
    words, n = C.word_count("v"), F.col("n")
    on = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    out = per.agg(F.sum("n").cast("long").alias("rows"), F.count("*").alias("unique_values"), on(words == 1).alias("one_word"), on(words > 1).alias("multi_word"), on(C.null_proxy("v", K.DESCRIPTION_PROXIES)).alias("proxies"), on(F.col("v").rlike("[A-Za-z]") & F.col("v").rlike("[0-9]")).alias("alphanumeric"), F.sum(F.length("v") * n).alias("chars"))
    return out.select("rows", "unique_values", "one_word", "multi_word", "proxies", "alphanumeric", F.round(F.col("chars") / F.greatest(F.col("rows"), F.lit(1)), 2).alias("avg_chars"))


def top_descriptions(df: DataFrame, column: str, spend: str, k: int = 100) -> DataFrame:
    per = df.where(C.non_blank(column)).groupBy(F.trim(column).alias("description")).agg(F.count("*").alias("rows"), _sum(F.col(spend)).alias("total_spend"))
    return per.orderBy(F.desc("rows"), "description").limit(k)


#: Fixed values of the cost model: dollars a million tokens in and out, characters a token, tokens out a row.
COST_IN, COST_OUT, CHARS_A_TOKEN, TOKENS_OUT = 2.5, 10.0, 4, 20
LARGE_ROWS = 400_000


def categorization_effort(df: DataFrame, supplier: str, description: str) -> DataFrame:
    """Supplier-description pairs to categorise, their mean size, the cost and the method for the size."""
    return _effort_of(df.where(C.non_blank(description)).groupBy(F.trim(supplier).alias("s"), F.trim(description).alias("d")).agg(F.count("*").alias("n")))


def _effort_of(pairs: DataFrame) -> DataFrame:
    """categorization_effort of distinct pairs (s, d) with their rows n."""
    out = pairs.agg(F.sum("n").cast("long").alias("rows"), F.count("*").alias("pairs"), F.sum(F.length("d") * F.col("n")).alias("chars"), F.sum(C.word_count("d") * F.col("n")).alias("words"), F.sum(F.length("d")).alias("pair_chars"))
    cost = F.col("pair_chars") / CHARS_A_TOKEN * COST_IN / 1e6 + F.col("pairs") * TOKENS_OUT * COST_OUT / 1e6
    return out.select("rows", "pairs", F.round(F.col("chars") / F.col("rows"), 2).alias("avg_chars"), F.round(F.col("words") / F.col("rows"), 2).alias("avg_words"), F.round(cost, 4).alias("cost_usd"), F.when(F.col("rows") > LARGE_ROWS, "large").otherwise("small").alias("method"))


def seeded(c: str, seed: int) -> Column:
    """What puts values in a seeded random order, the same for any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c)))


def sample_descriptions(df: DataFrame, description: str, n: int, seed: int = 7) -> DataFrame:
    """n distinct descriptions in a seeded random order that does not hang on partitions; a sampling operator."""
    distinct = df.where(C.non_blank(description)).select(F.trim(description).alias("description")).distinct()
    return distinct.orderBy(seeded("description", seed), "description").limit(n)


def cohort_descriptions(df: DataFrame, supplier: str, description: str, spend: str, n: int = 1000, percent: float = 80, seed: int = 7) -> DataFrame:
    """n distinct descriptions of the suppliers that reach percent of spend, the least by a seeded hash; a sampling operator.

    The hash alone orders them, so the sample does not hang on partitions; every task keeps its
    own n least before they meet.
    """
    leaders = cohort(df, supplier, spend, percent).select(F.col("supplier").alias("_leader"))
    told = df.where(C.non_blank(description)).select(F.trim(C.text(supplier)).alias("_supplier"), F.trim(C.text(description)).alias("description"))
    mine = told.join(leaders, F.col("_supplier") == F.col("_leader"), "left_semi").select("description").distinct()
    return mine.orderBy(seeded("description", seed), "description").limit(n)


def diverse_samples(df: DataFrame, column: str, per_shape: int = 2) -> DataFrame:
    """Values of every shape (digits and letters only), at most per_shape each."""
    shape = F.regexp_replace(F.regexp_replace(F.trim(C.text(column)), "[0-9]", "9"), "[A-Za-z]", "a")
    counted = df.where(C.non_blank(column)).groupBy(shape.alias("shape"), F.trim(C.text(column)).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("shape").orderBy("value"))).where(F.col("k") <= per_shape).drop("k", "n")


def quality_panels(df: DataFrame) -> dict[str, DataFrame]:
    """All panels that the fields of a typed table allow, by name; each is a plan of its own."""
    there = {*df.columns}
    make = {
        "date_period": (["invoice_date"], lambda: date_period(df, "invoice_date")), "date_pivot": (["invoice_date", "total_spend"], lambda: date_pivot(df, "invoice_date", "total_spend")),
        "bifurcation": (["total_spend"], lambda: bifurcation(df, "total_spend")), "bifurcation_by_currency": (["total_spend", "currency"], lambda: bifurcation(df, "total_spend", "currency")),
        "currency": (["currency", "total_spend"], lambda: top_and_others(df, "currency", "total_spend")), "country": (["vendor_country", "total_spend"], lambda: top_and_others(df, "vendor_country", "total_spend")),
        "region": (["region", "total_spend"], lambda: top_and_others(df, "region", "total_spend")), "terms": (["payment_terms", "total_spend"], lambda: terms_panel(df, "payment_terms", "total_spend")),
        "supplier": (["supplier", "total_spend"], lambda: supplier_breakdown(df, "supplier", "total_spend")), "description": (["description"], lambda: description_stats(df, "description")),
        "non_procurable": (["description", "total_spend", "currency"], lambda: non_procurable(df, "description", "total_spend", "currency")),
        "effort": (["supplier", "description"], lambda: categorization_effort(df, "supplier", "description")),
    }
    return {name: plan() for name, (fields, plan) in make.items() if {*fields} <= there}


def executive_summary(df: DataFrame, date: str, spend: str, supplier: str) -> DataFrame:
    """One row: the period, months with spend, total, the last twelve months, suppliers and how many reach 80 %."""
    period, net, year, vendors = date_period(df, date), bifurcation(df, spend), ltm(df, date, spend), supplier_breakdown(df, supplier, spend)
    # Each side is one row.
    joined = period.join(F.broadcast(net)).join(F.broadcast(year)).join(F.broadcast(vendors))
    return joined.select("first_date", "last_date", "months", F.col("net").alias("total_spend"), "ltm_spend", "suppliers", "reach_80", "top10_pct")


def summary_cube(df: DataFrame, date: str, spend: str, supplier: str, description: str) -> DataFrame:
    """All that the executive panels need, from one scan: rows by month, by supplier and description, and of the whole.

    `of` says which: month, pair, all. Rows of a pair meet in one task, or in a few where they are
    very many, and are counted there before they meet for good: the pairs that a task holds are
    bounded by its rows, and a hot supplier moves on as one row a task.
    """
    s, kinds = F.col(spend), dict(df.dtypes)
    # What is filled is told once a row: a date or a whole or decimal number is no blank and no word.
    plain = lambda c: kinds[c].startswith(("date", "timestamp", "decimal", "tinyint", "smallint", "int", "bigint"))
    flags = [(C.column(c).isNotNull() if plain(c) else C.effective(c)).alias(f"_f{i}") for i, c in enumerate(df.columns)]
    keyed = df.select(s.alias("_v"), F.col(date).alias("_t"), F.year(date).alias("_y"), F.month(date).alias("_m"), F.col(supplier).alias("_s"), F.col(description).alias("_d"), *flags)
    # A task that met rows of any pair would hold most pairs; one that meets those of a few holds these.
    keyed, s = keyed.hint("rebalance", F.col("_s"), F.col("_d")), F.col("_v")
    filled = F.struct(*(F.count(F.when(F.col(f"_f{i}"), 1)).alias(f"n{i}") for i in range(len(flags))), *(F.sum(F.when(F.col(f"_f{i}"), s)).alias(f"s{i}") for i in range(len(flags))))
    sets = keyed.groupingSets([["_y", "_m"], ["_s", "_d"], []], "_y", "_m", "_s", "_d")
    out = sets.agg(
        F.grouping_id("_y", "_m", "_s", "_d").alias("_id"), F.count("*").alias("rows"), F.sum(s).alias("spend"), F.sum(F.when(s > 0, s)).alias("positive"), F.sum(F.when(s < 0, s)).alias("negative"),
        F.count(F.when(s > 0, 1)).alias("positive_rows"), F.min("_t").alias("lo"), F.max("_t").alias("hi"), filled.alias("filled"),
    )
    return out.select(F.when(F.col("_id") == 3, "month").when(F.col("_id") == 12, "pair").otherwise("all").alias("of"), F.col("_y").alias("year"), F.col("_m").alias("month"), F.col("_s").alias("supplier"), F.col("_d").alias("description"), "rows", "spend", "positive", "negative", "positive_rows", "lo", "hi", F.when(F.col("_id") == 15, F.col("filled")).alias("filled"))


def executive_panels(df: DataFrame, date: str, spend: str, supplier: str, description: str) -> dict[str, DataFrame]:
    """The nine panels of the executive summary by name, all read from one summary_cube: the table is scanned once."""
    cube = settled(summary_cube(df, date, spend, supplier, description))
    months = cube.where("of = 'month' AND year IS NOT NULL").select(F.make_date("year", "month", F.lit(1)).alias("day"), "spend", "lo", "hi")
    pairs = cube.where("of = 'pair'").select("supplier", "description", "rows", "spend", "positive", "positive_rows")
    whole = cube.where("of = 'all'")
    days = months.select(F.explode(F.array("lo", "hi")).alias("day"))
    years = fiscal_years(months, "day", "spend").select(F.concat(F.lit("fy "), F.col("fy")).alias("figure"), F.col("total_spend").alias("value"))
    full = latest_full_year(months, "day", "spend").select(F.lit("latest full year").alias("figure"), F.col("total_spend").alias("value"))
    breakdown = ltm(months, "day", "spend").select(F.lit("last twelve months").alias("figure"), F.col("ltm_spend").alias("value")).union(years).union(full)
    named = pairs.where(C.non_blank("description"))
    texts = named.groupBy(F.trim(C.text("description")).alias("v")).agg(F.sum("rows").alias("n"))
    effort = named.groupBy(F.trim("supplier").alias("s"), F.trim("description").alias("d")).agg(F.sum("rows").alias("n"))
    bought = pairs.where("positive_rows > 0").select("supplier", F.col("description").alias("d"), F.col("positive").alias("spend"), F.col("positive_rows").alias("n"))
    zero = F.lit(0)
    fills = whole.select("rows", "spend", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"filled.n{i}").alias("filled"), F.col(f"filled.s{i}").alias("covered")) for i, c in enumerate(df.columns)))).alias("x"))
    two = lambda c: F.round(F.coalesce(F.col(c), zero).cast("double"), 2).alias(c)
    return {
        "date_period": date_period(days, "day"), "spend_breakdown": breakdown, "supplier_breakdown": supplier_breakdown(pairs, "supplier", "spend"), "categorization_effort": _effort_of(effort),
        "column_fill_rate": fills.select("x.column", "x.filled", C.percent(F.col("x.filled"), F.col("rows")).alias("fill_pct"), C.percent(F.coalesce("x.covered", zero), F.col("spend")).alias("spend_pct")),
        "date_pivot": date_pivot(months, "day", "spend"), "bifurcation": whole.select(two("positive"), two("negative"), two("spend").alias("net"), "rows"), "pareto": _pareto_of(bought, (80, 85, 90, 95)), "description_quality": _description_of(texts),
    }


def executive_figures(df: DataFrame, date: str, spend: str, supplier: str, description: str) -> DataFrame:
    """(panel, figure, value): all figures of the nine panels as one table; dates as days since 1970."""
    parts = []
    for name, panel in executive_panels(df, date, spend, supplier, description).items():
        keys = [c for c, kind in panel.dtypes if kind == "string" or c in ("year", "percent")]
        label = lambda c, keys=tuple(keys): F.concat_ws(" ", *(F.col(k).cast("string") for k in keys), F.lit(None if c == "value" else c))
        as_number = lambda c, kind: (F.unix_date(F.col(c)) if kind == "date" else F.col(c)).cast("double")
        cells = F.array(*(F.struct(label(c).alias("figure"), as_number(c, kind).alias("value")) for c, kind in panel.dtypes if c not in keys))
        parts.append(panel.select(F.lit(name).alias("panel"), F.explode(cells).alias("x")).select("panel", "x.figure", "x.value"))
    return reduce(lambda a, b: a.union(b), parts)
