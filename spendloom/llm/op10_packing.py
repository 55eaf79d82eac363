"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Which lengths share a sequence is decided on the histogram of piece lengths, which has at
most `size` entries however many documents there are. Every piece then finds its place
from its rank among the pieces of its length, and ranks come from counts per salt, so no
length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendloom.llm import bpe, tables
from spendloom.llm.textblock import tidy

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
END_ID = 0
#: Pieces of one length that are ranked together.
RANKED = 1 << 18


def pieces(docs: DataFrame, path: str, size: int, id_column: str, text_column: str) -> DataFrame:
    """Token pieces of at most `size`: whole documents, or cuts of longer ones; `spread` counts a task's pieces."""

    @tidy(keeps=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end, done = bpe.load(path), np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                ids = (model.ids(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    of.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, range(done, done + len(of)))]
            done += len(of)
            yield pa.RecordBatch.from_arrays(columns, [id_column, "piece", "start", "length", "ids_crc32", "spread"])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, spread long"
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in each) that pack counts[n] pieces of every length n below len(counts).

    Fill greedily from the longest; then, while it fits tighter, give the sequence's shortest
    piece back for two unpacked ones. A pattern is used as often as its lengths last, so the
    plan has about as many patterns as there are lengths.
    """
    size = len(counts) - 1
    left, patterns = counts.astype(np.int64).copy(), []
    while (there := np.flatnonzero(left)).size:
        free, taken = size, np.zeros(size + 1, np.int64)
        lengths: list[int] = []

        def put(n: int, times: int) -> None:
            nonlocal free
            taken[n] += times
            lengths.extend([n] * times)
            free -= n * times

        while (fits := there[: np.searchsorted(there, free, "right")]).size:
            fits = fits[left[fits] > taken[fits]]
            if not fits.size:
                break
            n = int(fits[-1])
            put(n, int(min(left[n] - taken[n], free // n)))
        while free and len(lengths) > 1:
            short = min(lengths)
            room, rest = free + short, left - taken
            first = there[(rest[there] > 0) & (there < room)]
            if not first.size:
                break
            second = first[np.maximum(np.searchsorted(first, room - first, "right") - 1, 0)]
            sums = first + second
            good = (sums <= room) & (sums > short) & ((first != second) | (rest[first] > 1))
            if not good.any():
                break
            best = int(np.argmax(np.where(good, sums, -1)))
            lengths.remove(short)
            taken[short] -= 1
            free += short
            put(int(first[best]), 1)
            put(int(second[best]), 1)
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left[used] -= times * taken[used]
        patterns.append((times, sorted(lengths, reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[int]]], size: int) -> dict[int, np.ndarray]:
    """For every length: rows (first rank, first sequence, places in a sequence, offset of each...)."""
    rows: dict[int, list[tuple[int, int, list[int]]]] = {}
    ranks, sequence = np.zeros(size + 1, np.int64), 0
    for times, lengths in patterns:
        offsets = np.r_[0, np.cumsum(lengths)]
        for n in dict.fromkeys(lengths):
            places = [int(offsets[i]) for i, m in enumerate(lengths) if m == n]
            rows.setdefault(n, []).append((int(ranks[n]), sequence, places))
            ranks[n] += times * len(places)
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null text is an empty one and packs as its end token alone. Rows that repeat are packed
    once each, whether ids are null or repeat; texts of any length are cut into pieces; extra
    columns are not read; an empty table gives an empty result. Ties: which of equally long
    pieces lies where is free.
    """
    spark = docs.sparkSession
    cut = tables.stage(pieces(docs, path, size, id_column, text_column), "pieces")
    full, rest = cut.where(F.col("length") == size), cut.where(F.col("length") < size)
    # At most size - 1 counts, then as many and one for every RANKED pieces.
    parts = np.ones(size + 1, np.int64)
    for length, n in rest.groupBy("length").count().collect():
        parts[length] = -(-n // RANKED)
    salted = rest.withColumn("salt", F.pmod("spread", F.get(F.lit(parts.tolist()), F.col("length").cast("int"))).cast("int"))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"])
    counts = np.zeros(size + 1, np.int64)
    head = np.cumsum(parts) - parts
    before = np.zeros(parts.sum(), np.int64)
    for length, salt, n in zip(counted["length"], counted["salt"], counted["n"], strict=True):
        before[head[length] + salt] = counts[length]
        counts[length] += n
    shared = spark.sparkContext.broadcast((head, before, slots(plan(counts), size)))

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, before, by_length = shared.value
        starts = {n: np.array([r[0] for r in rows]) for n, rows in by_length.items()}
        for batch in batches:
            length, salt, rank = (batch.column(i).to_numpy() for i in (4, 5, 6))
            rank = before[head[length] + salt] + rank - 1
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for i, (n, r) in enumerate(zip(length.tolist(), rank.tolist(), strict=True)):
                first, base, places = by_length[n][int(np.searchsorted(starts[n], r, "right")) - 1]
                sequence[i] = base + (r - first) // len(places)
                offset[i] = places[(r - first) % len(places)]
            columns = [batch.column(i) for i in (0, 1, 2, 4, 3)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_column, "piece", "start", "ids_crc32")))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.select(id_column, "piece", "start", "ids_crc32", "length", "salt", F.col("rank").cast("long")).mapInArrow(place, schema)
    # Planned sequences count from 0 up, whole ones from -1 down.
    whole = full.select(id_column, "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(whole)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tables.read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
