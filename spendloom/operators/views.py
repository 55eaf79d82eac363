"""Analytic views over typed spend: time, suppliers, currencies, countries, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendloom.functions import columns as C
from spendloom.functions import fields
from spendloom.operators.running import leading, running


def _double(c: str, digits: int = 2) -> Column:
    return F.round(F.col(c).cast("double"), digits)


def by_month(df: DataFrame, date: str, spend: str) -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.sum(spend).alias("spend"))


def spend_over_time(df: DataFrame, date: str, spend: str, grain: str) -> DataFrame:
    """monthly, yearly, or last12: the twelve months that end with the latest one."""
    months = by_month(df, date, spend)
    if grain == "yearly":
        return months.groupBy("year").agg(F.round(F.sum("spend").cast("double"), 2).alias("total_spend"))
    if grain == "last12":
        last = months.agg(F.max(F.col("year") * 12 + F.col("month")).alias("last"))
        months = months.join(F.broadcast(last), F.col("year") * 12 + F.col("month") > F.col("last") - 12)
    return months.select("year", "month", _double("spend").alias("total_spend"))


def share_by(df: DataFrame, key: str, spend: str) -> DataFrame:
    """Spend by a key and its share of all; totals are combined before the shuffle."""
    per = df.groupBy(F.col(key).alias("key")).agg(F.sum(spend).alias("spend"))
    total = per.agg(F.sum("spend").alias("total"))
    return per.join(F.broadcast(total)).select("key", _double("spend").alias("total_spend"), C.percent(F.col("spend"), F.col("total")).alias("pct_of_total"))


def supplier_ranking(df: DataFrame, supplier: str, spend: str) -> DataFrame:
    per = df.groupBy(F.col(supplier).alias("supplier")).agg(F.sum(spend).alias("spend"))
    return running(per, "spend", "supplier").select("rank", "supplier", _double("spend").alias("total_spend"), C.percent(F.col("spend"), F.col("total")).alias("pct_of_total"))


def pareto(df: DataFrame, supplier: str, spend: str, percent: float = 80, positive: bool = False) -> DataFrame:
    """The largest suppliers that together reach percent of spend, the reaching one included."""
    df = df.where(F.col(spend) > 0) if positive else df
    per = df.groupBy(F.col(supplier).alias("supplier")).agg(F.sum(spend).alias("spend"))
    found = leading(per, "spend", "supplier", percent)
    return found.select("rank", "supplier", _double("spend").alias("total_spend"), C.percent(F.col("cumulative"), F.col("total"), 4).alias("cumulative_pct"))


def mekko(df: DataFrame, column: str, segment: str, spend: str) -> DataFrame:
    """Width: a column's share of all; height: a segment's share of its column."""
    per = df.groupBy(F.col(column).alias("column"), F.col(segment).alias("segment")).agg(F.sum(spend).alias("spend"))
    sums = per.groupBy("column").agg(F.sum("spend").alias("of_column"))
    total = sums.agg(F.sum("of_column").alias("total"))
    joined = per.join(sums, "column").join(F.broadcast(total))
    return joined.select("column", "segment", _double("spend").alias("total_spend"), C.percent(F.col("of_column"), F.col("total")).alias("width_pct"), C.percent(F.col("spend"), F.col("of_column")).alias("segment_pct"))


def drilldown(df: DataFrame, levels: list[str], spend: str) -> DataFrame:
    """A tree of the levels: spend, share of the parent and of all, for each node."""
    names = [f"l{i + 1}" for i in range(len(levels))]
    each = df.select(*(F.col(c).alias(n) for c, n in zip(levels, names, strict=True)), F.col(spend).alias("spend")).groupBy(*names).agg(F.sum("spend").alias("spend"))
    tree = each.rollup(*names).agg(F.sum("spend").alias("spend"), F.grouping_id().alias("gid"))
    depth = F.lit(len(names)) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))
    tree = tree.withColumn("depth", depth.cast("int"))
    parent = [F.when(F.col("depth") > i + 1, F.col(n)) for i, n in enumerate(names)]
    tree = tree.withColumn("_parent", F.concat_ws("\u0001", F.col("depth"), *(F.coalesce(p.cast("string"), F.lit("")) for p in parent)))
    of_parent = F.sum("spend").over(Window.partitionBy("_parent"))
    total = each.agg(F.sum("spend").alias("total"))
    shares = tree.withColumn("of_parent", of_parent).join(F.broadcast(total))
    return shares.select(*names, "depth", _double("spend").alias("total_spend"), C.percent(F.col("spend"), F.col("of_parent")).alias("pct_of_parent"), C.percent(F.col("spend"), F.col("total")).alias("pct_of_total"))


#: Fields that each view needs; a view is offered when all are mapped.
VIEW_FIELDS = {
    "spend_over_time": ["invoice_date", "total_spend"], "supplier_ranking": ["supplier", "total_spend"], "pareto": ["supplier", "total_spend"],
    "currency_spend": ["currency", "local_spend"], "country_spend": ["vendor_country", "total_spend"], "l1_spend": ["l1", "total_spend"],
    "l1_vs_l2": ["l1", "l2", "total_spend"], "l2_vs_l3": ["l1", "l2", "l3", "total_spend"], "category_drilldown": ["l1", "total_spend"],
}


def available_views(mapped: set[str]) -> list[str]:
    return [view for view, fields in VIEW_FIELDS.items() if {*fields} <= mapped]


def feasibility(registry: dict[str, list[str]], mapped: set[str]) -> list[tuple[str, bool, list[str]]]:
    """(name, can it be built, the fields it lacks) of every dashboard of a registry."""
    return [(name, not (lacks := [f for f in fields if f not in mapped]), lacks) for name, fields in registry.items()]


def procurement_views(df: DataFrame, registry: dict[str, tuple[str, list[str]]] = fields.DASHBOARDS | fields.LEVERS) -> DataFrame:
    """(view, title, available, missing) of dashboards and levers for a table under standard field names.

    missing holds the shown names of the fields it lacks, in the registry's order. A registry is a
    few dozen entries and only the schema of the table is looked at, so no data is read.
    """
    names = {view: needs for view, (_, needs) in registry.items()}
    shown = [(view, registry[view][0], ready, [fields.FIELD_NAMES.get(f, f) for f in lacks]) for view, ready, lacks in feasibility(names, {*df.columns})]
    return df.sparkSession.createDataFrame(shown, "view string, title string, available boolean, missing array<string>")


def usable_rows(df: DataFrame, registry: dict[str, list[str]]) -> DataFrame:
    """(view, available, missing, rows): can each view be built, what it lacks, and how many rows hold a value in all its fields.

    A field is there if its column holds a value in any row. One scan, one row of counts.
    """
    held = [f for f in dict.fromkeys(f for needs in registry.values() for f in needs) if f in df.columns]
    cells = [F.coalesce(F.bool_or(C.non_blank(f)), F.lit(False)).alias(f"f{i}") for i, f in enumerate(held)]
    full = [F.count(F.when(_all(needs, held), 1)).alias(f"v{i}") for i, needs in enumerate(registry.values())]
    row = df.agg(F.count("*").alias("all"), *cells, *full).first()
    there = {f for i, f in enumerate(held) if row[f"f{i}"]}
    out = [(view, ready, lacks, row[f"v{i}"] if ready else 0) for i, (view, ready, lacks) in enumerate(feasibility(registry, there))]
    return df.sparkSession.createDataFrame(out, "view string, available boolean, missing array<string>, rows long")


def _all(needs: list[str], held: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (C.non_blank(f) for f in needs if f in held), F.lit(True))


def compute_views(df: DataFrame, wanted: list[str]) -> dict[str, DataFrame | Exception]:
    """Views by name over a typed table; one that fails does not stop the others."""
    make = {
        "spend_over_time": lambda: spend_over_time(df, "invoice_date", "total_spend", "monthly"), "supplier_ranking": lambda: supplier_ranking(df, "supplier", "total_spend"),
        "pareto": lambda: pareto(df, "supplier", "total_spend"), "currency_spend": lambda: share_by(df, "currency", "local_spend"),
        "country_spend": lambda: share_by(df, "vendor_country", "total_spend"), "l1_spend": lambda: share_by(df, "l1", "total_spend"),
        "l1_vs_l2": lambda: mekko(df, "l1", "l2", "total_spend"), "l2_vs_l3": lambda: mekko(df, "l2", "l3", "total_spend"),
        "category_drilldown": lambda: drilldown(df, [c for c in ("l1", "l2", "l3") if c in df.columns], "total_spend"),
    }
    out: dict[str, DataFrame | Exception] = {}
    for name in wanted:
        try:
            out[name] = make[name]()
        except Exception as failed:  # noqa: BLE001
            out[name] = failed
    return out


def write_views(df: DataFrame, wanted: list[str], path: str) -> dict[str, str | Exception]:
    """Write each view as Parquet in a folder of its name: where it lies, or why it failed.

    A view that cannot be planned or that fails as it runs leaves the others alone.
    """
    out: dict[str, str | Exception] = {}
    for name, view in compute_views(df, wanted).items():
        try:
            if isinstance(view, Exception):
                raise view
            view.write.mode("overwrite").parquet(f"{path}/{name}")
            out[name] = f"{path}/{name}"
        except Exception as failed:  # noqa: BLE001
            out[name] = failed
    return out
