"""Benchmark decontamination by winnowing.

Of every nine consecutive 5-word hashes the smallest is kept as a fingerprint, so any span
of 13 shared words shares at least one. Fingerprints of documents and benchmark items are
joined, and each hit is extended by the eight words on either side. A bitmap of fixed size
tells which fingerprints of documents can meet one at all; it filters, the join decides.
Items of fewer than 13 words are one n-gram each, looked up at every place of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import tables
from spendloom.llm.textblock import ALNUM, Words, blocks, gram_hashes, mix, tidy

WINDOW = 13
GRAM = 5
SIDE = WINDOW - GRAM
#: A document is contaminated when at least this share of its words is hit.
SHARE = 20
BITMAP_BITS = 20
_FOUND = "fp long, span int, at int, context binary"


def winnow(words: Words, hashes: np.ndarray) -> np.ndarray:
    """First words of the fingerprint grams of all documents of a block."""
    grams = gram_hashes(hashes, GRAM)
    per = WINDOW - GRAM + 1
    if len(grams) < per:
        return np.zeros(0, np.int64)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1) + np.arange(len(grams) - per + 1)
    return np.unique(chosen[words.inside(WINDOW)[: len(chosen)]])


def contexts(words: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Word hashes around each gram, SIDE + GRAM + SIDE of them; 0 beyond the document."""
    around = at[:, None] + np.arange(-SIDE, GRAM + SIDE)[None, :]
    doc = np.searchsorted(words.first, at, "right") - 1
    good = (around >= words.first[doc][:, None]) & (around < words.first[doc + 1][:, None])
    return np.where(good, hashes[np.clip(around, 0, max(len(hashes) - 1, 0))], np.uint64(0))


def fingerprints(words: Words, lengths: list[int], wanted) -> tuple[np.ndarray, ...]:
    """(first word, fingerprint, words in it, context or None rows) of what `wanted` lets through."""
    hashes = words.hashes()
    at = winnow(words, hashes)
    fps = mix(gram_hashes(hashes, GRAM)[at] ^ np.uint64(WINDOW))
    keep = wanted(fps)
    found = [(at[keep], fps[keep], np.full(int(keep.sum()), WINDOW))]
    for n in lengths:
        at = np.flatnonzero(words.inside(n))
        fps = mix(gram_hashes(hashes, n)[at] ^ np.uint64(n))
        keep = wanted(fps)
        found.append((at[keep], fps[keep], np.full(int(keep.sum()), n)))
    at, fps, span = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, fps, span, contexts(words, hashes, at)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype("<u8")], pa.binary())


def item_fingerprints(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Fingerprints of every item that has a word. Items of under WINDOW words give one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                words = block.words(ALNUM, lower=True)
                n = words.counts()
                lengths = sorted({*n[(n > 0) & (n < WINDOW)].tolist()})
                at, fps, span, context = fingerprints(words, lengths, lambda x: np.ones(len(x), bool))
                doc = np.searchsorted(words.first, at, "right") - 1
                whole = (span == WINDOW) | (span == n[doc])
                ids = batch.column(0).slice(block.lo, block.n).take(pa.array(doc[whole]))
                columns = [pa.array(fps[whole].view(np.int64)), pa.array(span[whole].astype(np.int32)), pa.array(at[whole].astype(np.int32)), _binary(context[whole])]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["item", "fp", "span", "at", "context"])

    return items.select(F.col(id_column).cast("string").alias("item"), text_column).mapInArrow(run, f"item string, {_FOUND}").drop("at")


def _search(docs: DataFrame, known: DataFrame) -> DataFrame:
    """A row (k1, k2, id, n_words) for each row of docs, its span -1, and one for each fingerprint that may meet one of `known`."""
    # At most 2^BITMAP_BITS numbers and WINDOW - 1 lengths, whatever the benchmark's size.
    marks = known.select(F.shiftrightunsigned("fp", 64 - BITMAP_BITS).cast("int").alias("bit")).distinct().toPandas()["bit"]
    lengths = sorted(r["span"] for r in known.where(F.col("span") < WINDOW).select("span").distinct().collect())
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[marks.to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for block in blocks(batch.column(3)):
                words = block.words(ALNUM, lower=True)
                at, fps, span, context = fingerprints(words, lengths, lambda x: bitmap[x >> np.uint64(64 - BITMAP_BITS)])
                doc = np.searchsorted(words.first, at, "right") - 1
                n, place = block.n, pa.array(np.r_[np.arange(block.n), doc])
                keys = [c.slice(block.lo, n).take(place) for c in batch.columns[:3]]
                columns = [
                    pa.array(np.r_[words.counts(), words.counts()[doc]].astype(np.int64)),
                    pa.array(np.r_[np.zeros(n, np.uint64), fps].view(np.int64)),
                    pa.array(np.r_[np.full(n, -1), span].astype(np.int32)),
                    pa.array(np.r_[np.zeros(n, np.int64), at - words.first[doc]].astype(np.int32)),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), _binary(context)]),
                ]
                yield pa.RecordBatch.from_arrays([*keys, *columns], ["k1", "k2", "id", "n_words", "fp", "span", "at", "context"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("k1", "k2", "id", "text").mapInArrow(search, f"k1 long, k2 long, id {kind}, n_words long, {_FOUND}")


def _extend(met: DataFrame) -> DataFrame:
    """(k1, k2, first, end, item): the hit words around every fingerprint of a document that met an item's."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = SIDE + GRAM + SIDE
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, width) for i in (4, 5))
            place, words = (batch.column(i).to_numpy() for i in (3, 2))
            same = (a == b) & (a != 0)
            left = np.cumprod(same[:, SIDE - 1 :: -1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, SIDE + GRAM :], axis=1).sum(axis=1)
            long = words == WINDOW
            good = np.flatnonzero(np.where(long, same[:, SIDE : SIDE + GRAM].all(axis=1) & (left + GRAM + right >= WINDOW), True))
            lo = np.where(long, place - left, place)[good]
            hi = np.where(long, place + GRAM + right, place + words)[good]
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *(pa.array(x.astype(np.int32)) for x in (lo, hi)), kept.column(6)], ["k1", "k2", "first", "end", "item"])

    return met.select("k1", "k2", "span", "at", "context", "item_context", "item").mapInArrow(run, "k1 long, k2 long, first int, end int, item string")


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = SHARE, keys: bool = False) -> DataFrame:
    """Per row of docs: n_words, n_hit, n_items, items_sha256, contaminated, items and hit spans.

    Null and empty texts have no words and are clean; null or wordless items match nothing.
    Every row is judged by its own text, whether its id is null or repeats; repeated rows are
    each returned. Items that repeat an id count once. Texts of any length are searched whole;
    other columns are not read. Documents of an empty table give no rows; without items all
    are clean. keys: also return k1 and k2, the hashes of id and text (tables.row_keys).
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumns(tables.row_keys("id", "text"))
    known = tables.stage(item_fingerprints(items, item_id, item_text), "item-fingerprints")
    searched = tables.stage(_search(docs, known), "searched")
    each = searched.where("span = -1").select("id", "k1", "k2", "n_words")
    # A fingerprint of a row that repeats is met once.
    asked = searched.where("span >= 0").select("k1", "k2", "fp", "span", "at", "context").distinct()
    found = _extend(asked.join(known.withColumnRenamed("context", "item_context"), ["fp", "span"]))
    per = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach"))
    union = F.aggregate(
        "spans", zero,
        lambda acc, s: F.struct((acc["hit"] + F.greatest(s["end"] - F.greatest(s["first"], acc["reach"]), F.lit(0))).alias("hit"), F.greatest(acc["reach"], s["end"]).alias("reach")),
        lambda acc: acc["hit"].cast("long"),
    )
    per = tables.stage(per.withColumn("n_hit", union), "hits")
    joined = each.join(per, ["k1", "k2"], "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_column), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), found.alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first: int, end: int>>")).alias("spans"), *(["k1", "k2"] if keys else []),
    )


#: The same by joining every window of every item with every window of every document.
ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, i FROM doc_window JOIN item_window USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark")
    return contamination(docs, items).drop("items", "spans")
