"""Source divergence audit: how far each source's use of words lies from others of its language.

Plain relational. Terms are counted per (lang, source, term), in blocks of texts first, and kept
where enough documents of the language have them. Groups crossed with the kept terms of their language give
every group a share for every term, also for those it lacks; these dense shares join with
themselves on language and term, and the differences are summed for each pair of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendloom.llm import tables
from spendloom.llm.textblock import blocks, tidy

#: Documents of a language that must hold a term.
LEAST_DOCS = 3
#: Ranks of the terms that are reported for a group.
TOP_TERMS = 200
#: Shares are whole numbers of this part of one.
UNIT = 1_000_000_000

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes after A-Z became a-z.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text that are counted together; a longer one is counted alone.
BLOCK = 1 << 22
#: Counts up to it are multiplied as whole numbers, larger ones as decimals.
LARGE = 9_000_000_000
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{_AZ[0]}', '{_AZ[1]}'), '{TERMS}')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, n, total FROM counts JOIN kept USING (lang, term)),
groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN found USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, 1 + ({UNIT} * (coalesce(f.n, 0)::HUGEINT + 1)) // (g.size + v) AS p,
    1 + ({UNIT} * (k.total::HUGEINT + 1)) // (l.total + v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


def _share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (size + terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    large = F.call_function("div", (wide(count) + 1) * F.lit(UNIT), wide(size) + wide(terms))
    return F.lit(1) + F.when(count < LARGE, F.call_function("div", (count + 1) * F.lit(UNIT).cast("long"), size + terms)).otherwise(large)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs that hold it) of docs (lang, source, text).

    Each block of documents is counted by itself before its rows meet those of other blocks: a
    term of a group leaves it as one row.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for block in blocks(batch.column(2), BLOCK):
                words = block.words(LETTERS, lower=True)
                if not len(words.starts):
                    continue
                ends = np.cumsum(words.ends - words.starts, dtype=np.int32)
                letters = pa.py_buffer(words.data[LETTERS[words.data]])
                terms = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.r_[np.int32(0), ends]), letters).dictionary_encode()
                # Occurrences in the order of group, term and document, which are one number.
                bits, many = block.n.bit_length(), len(terms.dictionary)
                owner, doc = np.unique(group[block.lo : block.lo + block.n], return_inverse=True)[0], words.docs()
                key = np.searchsorted(owner, group[block.lo + doc]) * many + terms.indices.to_numpy()
                key = np.sort((key << bits) | doc)
                first = np.r_[True, key[1:] != key[:-1]]
                key >>= bits
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                of, term = owner[key[start] // many], pa.array(key[start] % many)
                columns = [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))), terms.dictionary.take(term)]
                columns += [pa.array(np.diff(np.r_[start, len(key)])), pa.array(np.add.reduceat(first, start, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every group of lang and source.

    part `pair`: item is another source of the language, value their divergence. part `term`:
    item is a term that the group uses more than its language does, value by how much.
    Null texts, langs and sources read as empty; a group whose documents have no terms takes part
    with zeros, and a language without kept terms has pairs of value 0. Every row counts as a
    document, also repeated ones. Equal values rank by item. Texts are read whole; extra columns are
    not read, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    empty = F.lit("")
    docs = docs.select(F.coalesce(F.col(lang_column), empty).alias("lang"), F.coalesce(F.col(source_column), empty).alias("source"), F.coalesce(F.col(text_column), empty).alias("text"))
    of_term = Window.partitionBy("lang", "term")
    counts = _counts(docs).withColumns({"total": F.sum("n").over(of_term), "docs": F.sum("docs").over(of_term), "lead": F.min("source").over(of_term)})
    found = tables.bucketed(counts.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("lead") == F.col("source")).alias("lead")), "terms", "lang", "term")

    langs = found.where("lead").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = tables.stage(groups.fillna(0, ["size", "terms", "lang_size"]), "groups")

    # A few languages hold all terms: where the groups are too many to broadcast, their rows are
    # repeated over salts, and each term meets one copy.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = found.where("lead").select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(salts)).alias("salt"))
    crossed = lead.join(groups.select("lang", "source", "size", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")), ["lang", "salt"])
    dense = crossed.join(found.select("lang", "term", "source", "n").hint("shuffle_hash"), ["lang", "term", "source"], "left")
    dense = dense.select("lang", "term", "source", _share(F.coalesce("n", F.lit(0)), F.col("size"), F.col("terms")).alias("p"))
    # All of a term lies in one bucket already: neither the join nor the table moves a row.
    with tables.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        dense = tables.bucketed(dense, "dense", "lang", "term", dealt=True)
    # Two sources meet once and are measured both ways. A sum of distances stays under that of
    # all squared shares, so under (UNIT + terms)^2, which a long holds.
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    there, back = _distance(F.col("p"), F.col("q")), _distance(F.col("q"), F.col("p"))
    sums = dense.join(other.hint("shuffle_hash"), ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
    turned = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    sums = sums.select("lang", F.explode(turned).alias("x")).select("lang", "x.source", "x.item", "x.value")
    # With no kept term in a language there is nothing to join, and its pairs are zero.
    bare = groups.where("terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = sums.union(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q")
    )
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", _distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    return pairs.union(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(tables.read(spark, sf_dir, "documents"))
