"""URL filters by a sort-merge range join.

A host becomes a key of its labels in reverse, each followed by a dot, so a domain and all
its subdomains are one interval of keys. Keys are dealt into ranges by quantiles of a bounded
sample, and a rule goes to every range that its interval touches, so no range needs another
one's rules. In each range a sweep over rules and pages in key order keeps a stack of the
hosts whose intervals are open; a host's rules lie there by path, and a page asks for the
prefixes of its path that are as long as one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import tables

DEFAULT = "allow"
#: Sampled keys for each range of keys; they choose its bounds and nothing else.
SAMPLED = 32
#: Rules of the registered query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) AS best
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""


def parts(url: str) -> tuple:
    """Columns host and path of a url column; both empty without `://` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key(host: str):
    """Reversed labels, a dot behind each: `a.example.net` is `net.example.a.`."""
    return F.when(F.col(host) == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = DEFAULT) -> DataFrame:
    """Every page with host, path, the longest fitting rule and its verdict, or null and the default.

    rules: columns host, path, verdict. Null or malformed urls have an empty host and path and
    meet no rule; repeated pages are each judged; of equal rules the first verdict in order
    counts, of equally long ones that of the longer host; urls of any length are judged whole;
    empty tables on either side are fine; extra columns of pages are not read.
    """
    host, path = parts("url")
    spark, kind = pages.sparkSession, pages.schema[id_column].dataType.simpleString()
    asked = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")).select("id", host.alias("host"), path.alias("path"))
    # Pages of one host may be a third of all: behind its key they lie in the order of a hash.
    asked = asked.withColumn("key", key("host")).withColumn("place", F.concat("key", F.lit("\0"), F.hex(F.xxhash64("id", "path"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r["place"] for r in asked.select("place").orderBy(F.xxhash64("place"), "place").limit(SAMPLED * n).collect())
    bounds = np.array(sample[SAMPLED // 2 :: SAMPLED] if len(sample) == SAMPLED * n else sample[:: max(1, len(sample) // n)], object)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(part=np.searchsorted(bounds, batch.place.to_numpy(object), "right"))

    asked = asked.mapInPandas(deal, f"id {kind}, host string, path string, key string, place string, part long")
    known = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).where(F.col("host") != "").withColumn("key", key("host"))

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # All keys of a domain begin with its own; `/` is the sign next to the dot it ends with.
            lo, hi = (np.searchsorted(bounds, x.to_numpy(object), "right") for x in (batch.key, batch.key.str[:-1] + "/"))
            yield batch.assign(part=[range(a, b + 1) for a, b in zip(lo, hi, strict=True)]).explode("part").astype({"part": "int64"})

    known = known.select("host", "path", "key", "verdict").mapInPandas(touch, "host string, path string, key string, verdict string, part long")
    none = F.lit(None)
    lines = asked.select("part", "place", "id", "host", "path", "key", none.cast("string").alias("verdict"), F.lit(1).alias("kind"))
    lines = lines.union(known.select("part", "key", none.cast(pages.schema[id_column].dataType), "host", "path", "key", "verdict", F.lit(0)))
    lines = lines.repartition(n, "part").sortWithinPartitions("part", "place", "kind", "path").drop("place")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, stack = -1, []  # (key, host, path -> verdict, lengths of its paths)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.part != part:
                    part, stack = row.part, []
                # Keys only grow, so a host that no longer fits never fits again.
                while stack and not row.key.startswith(stack[-1][0]):
                    stack.pop()
                if row.kind == 0:
                    if not stack or stack[-1][0] != row.key:
                        stack.append((row.key, row.host, {}, []))
                    stack[-1][2][row.path] = row.verdict
                    if len(row.path) not in stack[-1][3]:
                        stack[-1][3].append(len(row.path))
                    continue
                fits = ((len(h) + k, len(h), h + row.path[:k], paths[row.path[:k]]) for _, h, paths, lengths in stack if row.key for k in lengths if k <= len(row.path) and row.path[:k] in paths)
                *_, rule, verdict = max(fits, default=(None, default))
                out.append((row.id, row.host, row.path, rule, verdict))
            yield pd.DataFrame(out, columns=[id_column, "host", "path", "rule", "verdict"])

    return lines.mapInPandas(sweep, f"`{id_column}` {kind}, host string, path string, rule string, verdict string")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tables.read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
