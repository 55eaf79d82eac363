"""Joining tables on normalised keys: simulation, merge, validation, chains, append."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spendloom.functions import columns as C


def _keys(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.groupBy(C.merge_key(columns).alias("key")).agg(F.count("*").alias("n"))


def simulate(base: DataFrame, source: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """What a join on the key pairs would do, from counts per key alone: no row pair is made."""
    a = _keys(base, [x for x, _ in pairs]).select("key", F.col("n").alias("a"))
    b = _keys(source, [y for _, y in pairs]).select("key", F.col("n").alias("b"))
    both = a.join(b, "key", "full")
    on = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("long")
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = both.agg(
        on(F.col("a").isNotNull(), F.col("a")).alias("base_rows"), on(there, F.col("a")).alias("matched_rows"), on(there, F.col("a") * F.col("b")).alias("joined_rows"),
        on(F.col("a").isNotNull() & F.col("b").isNull(), F.col("a")).alias("unmatched_base"), on(F.col("a").isNull() & F.col("b").isNotNull(), F.lit(1)).alias("unmatched_source_keys"),
        on(F.col("b") > 1, F.lit(1)).alias("duplicate_source_keys"),
    )
    explosion = F.round(F.col("joined_rows") / F.greatest(F.col("matched_rows"), F.lit(1)), 4)
    return out.withColumns({"match_pct": C.percent(F.col("matched_rows"), F.col("base_rows")), "explosion": explosion})


def merge(base: DataFrame, source: DataFrame, pairs: list[tuple[str, str]], pull: list[str], order: str, suffix: str = "_source") -> DataFrame:
    """LEFT JOIN of the first source row per normalised key; the base keeps its rows.

    The source is reduced by min_by before any shuffle. A pulled column that the base has too
    gets the suffix. Spark broadcasts the reduced side where it is small, and AQE splits hot
    base keys where it is not.
    """
    taken = [c if c not in base.columns else f"{c}{suffix}" for c in pull]
    key = C.merge_key(y for _, y in pairs)
    row = F.struct(*(F.col(c).alias(t) for c, t in zip(pull, taken, strict=True)))
    first = source.select(key.alias("_key"), row.alias("_row"), F.col(order).alias("_order")).where(F.coalesce(F.replace("_key", F.lit("|||"), F.lit("")) != "", F.lit(False)))
    first = first.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    joined = base.withColumn("_key", C.merge_key(x for x, _ in pairs)).join(first, "_key", "left")
    return joined.select(*base.columns, *(F.col(f"_row.`{t}`").alias(t) for t in taken))


def unmatched(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str]) -> DataFrame:
    """Rows of the left side without a partner."""
    keys = right.select(C.merge_key(right_keys).alias("_key")).distinct()
    return left.withColumn("_key", C.merge_key(left_keys)).join(keys, "_key", "left_anti").drop("_key")


def match_rate(fact: DataFrame, fact_keys: list[str], dim: DataFrame, dim_keys: list[str]) -> DataFrame:
    """Semi-join match rate and how many distinct keys match."""
    a, b = _keys(fact, fact_keys), _keys(dim, dim_keys).select("key", F.lit(True).alias("there"))
    both = a.join(b, "key", "left")
    out = both.agg(F.sum("n").cast("long").alias("rows"), F.coalesce(F.sum(F.when(F.col("there"), F.col("n"))), F.lit(0)).cast("long").alias("matched"), F.count("there").alias("matched_keys"))
    return out.withColumn("match_pct", C.percent(F.col("matched"), F.col("rows")))


def uniqueness(dim: DataFrame, keys: list[str]) -> DataFrame:
    return _keys(dim, keys).agg(F.sum("n").cast("long").alias("rows"), F.count("*").alias("distinct_keys"))


def finalize(base: DataFrame, steps: list[DataFrame], row_id: str) -> DataFrame:
    """Add the columns of approved steps by row id, so repeated keys multiply nothing."""
    for step in steps:
        new = [c for c in step.columns if c not in base.columns]
        base = base.join(step.select(row_id, *new), row_id, "left")
    return base


def append(tables: dict[str, DataFrame], mappings: dict[str, dict[str, str]], columns: list[str]) -> DataFrame:
    """UNION ALL in canonical columns; a column that a table lacks is null; _source_table says whose row it is."""
    parts = []
    for name, df in tables.items():
        of = {canonical: own for own, canonical in mappings.get(name, {}).items()}
        cells = [(C.text(of[c]) if c in of else F.lit(None).cast("string")).alias(c) for c in columns]
        parts.append(df.select(*cells, F.lit(name).alias("_source_table")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def append_written(tables: dict[str, DataFrame], mappings: dict[str, dict[str, str]], columns: list[str], path: str) -> DataFrame:
    """Write the union as Parquet; (table, rows, written, filled, intact): counted while the rows pass, without another scan.

    rows are those read of a table, written those of it that reach the file, filled its cells
    with a value in the canonical columns.
    """
    read = {name: Observation() for name in tables}
    written = Observation()
    union = append({name: df.observe(read[name], F.count(F.lit(1)).alias("rows")) for name, df in tables.items()}, mappings, columns)
    cells = sum((C.non_blank(c).cast("int") for c in columns), F.lit(0))
    of = lambda name, x: F.coalesce(F.sum(F.when(F.col("_source_table") == name, x)), F.lit(0)).cast("long")
    counts = [x for i, name in enumerate(tables) for x in (of(name, 1).alias(f"n{i}"), of(name, cells).alias(f"c{i}"))]
    union.observe(written, *counts).write.mode("overwrite").parquet(path)
    found = written.get
    rows = [(name, read[name].get["rows"], found[f"n{i}"], found[f"c{i}"], read[name].get["rows"] == found[f"n{i}"]) for i, name in enumerate(tables)]
    return union.sparkSession.createDataFrame(rows, "table string, rows long, written long, filled long, intact boolean")


def plan_append(schemas: dict[str, list[str]], least: float = 0.5) -> list[list[str]]:
    """Groups of tables whose headers overlap by Jaccard similarity; largest tables lead."""
    groups: list[list[str]] = []
    for name in sorted(schemas, key=lambda n: (-len(schemas[n]), n)):
        mine = {c.lower() for c in schemas[name]}
        home = next((g for g in groups if len(mine & (lead := {c.lower() for c in schemas[g[0]]})) >= least * len(mine | lead)), None)
        groups.append([name]) if home is None else home.append(name)
    return groups


def header_pairs(base: list[str], source: list[str], least: float = 0.8) -> list[tuple[str, str, float]]:
    """Pairs of equal or similar headers, best first, each header once."""
    plain = lambda c: " ".join(c.lower().replace("_", " ").replace("-", " ").split())
    scored = [(1.0 if plain(a) == plain(b) else difflib.SequenceMatcher(None, plain(a), plain(b)).ratio(), a, b) for a in base for b in source]
    out, used = [], set()
    for score, a, b in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
        if score >= least and ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, round(score, 4)))
    return out


def find_keys(fact: DataFrame, dim: DataFrame, least: float = 0.3) -> DataFrame:
    """All column pairs by the overlap of their distinct values: one distinct and one join for all pairs."""
    values = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias(name), C.match_key(c).alias("v")) for c in df.columns))).alias("x")).select("x.*").where(C.non_blank("v")).distinct()
    a, b = values(fact, "fact_column"), values(dim, "dim_column")
    size = a.groupBy("fact_column").agg(F.count("*").alias("distinct_values"))
    # A value names at most one row per column, so this join is bounded by columns x columns per value.
    shared = a.join(b, "v").groupBy("fact_column", "dim_column").agg(F.count("*").alias("shared"))
    share = C.percent(F.col("shared"), F.col("distinct_values"))
    return shared.join(F.broadcast(size), "fact_column").select("fact_column", "dim_column", "shared", share.alias("overlap_pct")).where(F.col("overlap_pct") >= least * 100)


def rank_base(sizes: dict[str, tuple[int, int]]) -> list[tuple[str, int]]:
    """Tables by rows x columns, the largest first, with a score up to 100."""
    most = max((r * c for r, c in sizes.values()), default=0) or 1
    return sorted(((n, round(100 * r * c / most)) for n, (r, c) in sizes.items()), key=lambda x: (-x[1], x[0]))


#: A merge that makes more rows a row of the base than this is refused; one that matches fewer rows is warned of.
MOST_ROWS, LEAST_MATCHED = 1.02, 30


def guarded_join(fact: DataFrame, dim: DataFrame, pairs: list[tuple[str, str]], name: str, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the joined table, one row of what the join did): a LEFT JOIN with one row of the dimension a normalised key.

    Columns that both have get the dimension's name as suffix. The dimension is deduplicated on
    the key that is joined, so rows cannot multiply; the row says so, and how many rows match.
    """
    theirs = [y for _, y in pairs]
    pull = [c for c in dim.columns if c not in theirs and (keep is None or c in keep)]
    joined = merge(fact, dim, pairs, pull, theirs[0], f"_{name}")
    rate = match_rate(fact, [x for x, _ in pairs], dim, theirs)
    status = F.when(F.col("rows_after") > F.col("rows") * MOST_ROWS, "rejected").when(F.col("match_pct") < LEAST_MATCHED, "low match").otherwise("merged")
    after = joined.agg(F.count("*").alias("rows_after"))
    return joined, rate.join(F.broadcast(after)).select(F.lit(name).alias("dimension"), "rows", "rows_after", "matched", "match_pct", F.lit(len(pull)).alias("columns_added"), status.alias("status"))


def _shape(df: DataFrame, column: str) -> DataFrame:
    """How the keys of a column are written, from one pass over all of them; their common prefix is that of the least and the greatest."""
    value = F.trim(C.text(column))
    return df.where(C.non_blank(column)).agg(
        F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.min(F.length(value)).alias("short"),
        F.coalesce(F.bool_or(value.rlike("^0[0-9]+$")), F.lit(False)).alias("zeros"), F.coalesce(F.bool_and(value.rlike("^[0-9]+$")), F.lit(False)).alias("digits"),
        F.coalesce(F.bool_or(F.contains(value, F.lit("-"))), F.lit(False)).alias("dash"), F.coalesce(F.bool_or(F.contains(value, F.lit("_"))), F.lit(False)).alias("under"),
    )


def _prefix(shape) -> str:
    """What all keys begin with, if it ends with a sign or holds no digit and is no whole key."""
    lo, hi = shape["lo"] or "", shape["hi"] or ""
    same = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
    prefix = lo[:same]
    good = shape["n"] >= 3 and prefix and len(prefix) < shape["short"] and (not prefix[-1].isalnum() or not any(c.isdigit() for c in prefix))
    return prefix if good else ""


def key_format(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[str, Column, Column]:
    """(kind, left expression, right expression) that make differently written keys equal.

    Kinds: prefix, zeros, separator, none. Each side sends one row to the driver.
    """
    a, b = _shape(left, left_key).first(), _shape(right, right_key).first()
    pa, pb = _prefix(a), _prefix(b)
    if pa != pb:
        strip = lambda c, p: C.match_key(F.regexp_replace(F.trim(C.text(c)), "^" + re.escape(p), "")) if p else C.match_key(c)
        return "prefix", strip(left_key, pa), strip(right_key, pb)
    if (a["zeros"] or b["zeros"]) and a["digits"] and b["digits"]:
        bare = lambda c: C.strip_zeros(c)
        return "zeros", bare(left_key), bare(right_key)
    if (a["dash"] and b["under"]) or (a["under"] and b["dash"]):
        plain = lambda c: F.lower(F.translate(F.trim(C.text(c)), "-_", ""))
        return "separator", plain(left_key), plain(right_key)
    return "none", C.match_key(left_key), C.match_key(right_key)


def formatted_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of both sides and shared ones, before and after their formats are made equal."""
    kind, x, y = key_format(left, left_key, right, right_key)
    side = lambda df, plain, made, mark: df.where(C.non_blank(plain)).select(F.explode(F.array(F.struct(F.lit("as written").alias("keys"), C.match_key(plain).alias("k")), F.struct(F.lit("made equal").alias("keys"), made.alias("k")))).alias("x"), F.lit(mark).alias("side"))
    both = side(left, left_key, x, 1).union(side(right, right_key, y, 2)).select("x.keys", "x.k", "side").distinct().groupBy("keys", "k").agg(F.sum("side").alias("s"))
    count = lambda *s: F.count(F.when(F.col("s").isin(*s), 1))
    return both.groupBy("keys").agg(count(1, 3).alias("left_distinct"), count(2, 3).alias("right_distinct"), count(3).alias("shared")).withColumn("format", F.lit(kind))
