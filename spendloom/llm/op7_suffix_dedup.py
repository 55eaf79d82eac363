"""Exact substring deduplication on a sparse suffix array with deep-shallow sorting.

Every 400-byte window picks its smallest 64-byte hash as an anchor, so equal windows pick
the same anchor at the same place, and only about one suffix in 170 needs sorting. Suffixes
at anchors whose hash occurs again are sorted group by group (deep_shallow), and common
stretches around them of 400 bytes or more are removed. Surroundings that are the same byte
for byte are counted before the shuffle and sorted once. A group with too many different
surroundings is cut into two by the windows' distance to the anchor, as often as it takes;
windows at one distance are equal or unrelated, so this ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import tables
from spendloom.llm.deep_shallow import recurring
from spendloom.llm.textblock import blocks, gram_hashes, merged, mix, span_hashes, text_buffers, tidy

LENGTH = 400
GRAM = 64
#: Different surroundings of one anchor that are sorted together.
GROUP = 2_000
#: Bytes of a longer text whose anchors are found together; under 2^_POSITION.
STRETCH = 1 << 22
_POSITION = 26

_U = np.uint64


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values, by prefix and suffix minima of chunks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~_U(0))
    padded[: len(values)] = values
    chunks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(chunks, axis=1).ravel()
    behind = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, its hash, first window, last window) for every run of windows with one anchor."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty.view(_U), empty, empty
    if len(data) >> _POSITION:
        raise ValueError("a stretch of 64 MB or more")
    hashes = gram_hashes(data, gram)
    low = _U((1 << _POSITION) - 1)
    least = _sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=_U), length - gram + 1)
    at = (least & low).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(at)]
    windows = np.flatnonzero(np.arange(len(at)) + length <= ends)
    if not len(windows):
        return empty, empty.view(_U), empty, empty
    chosen = at[windows]
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first, last = windows[new], windows[np.r_[new[1:] - 1, len(windows) - 1]]
    return chosen[new], hashes[chosen[new]], first, last


def _runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, its hash, hash of the surroundings, first window, last window) of all runs, in parts.

    A text over `stretch` is taken in stretches. The last run of one may go on beyond it, so the
    next stretch starts with that run's first window: the runs are those of the whole text.
    """

    def part(base: int, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        at, h, first, last = anchors(data, bounds, length, gram)
        around = mix(span_hashes(data, first, last + length) + (at - last).astype(_U))
        return at + base, h, around, first + base, last + base

    if len(data) <= stretch:
        yield part(0, data, bounds)
        return
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while hi - lo > stretch:
            found = part(lo, data[lo : lo + stretch], np.array([0, stretch]))
            yield tuple(x[:-1] for x in found)
            lo = int(found[3][-1])
        yield part(lo, data[lo:hi], np.array([0, hi - lo]))


def _find(docs: DataFrame, length: int) -> DataFrame:
    """Anchors of all documents: hash, hash of the surroundings, place, and distances of its windows."""
    kind = docs.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                for at, h, around, first, last in _runs(block.data, block.bounds, length):
                    doc = np.searchsorted(block.bounds, at, "right") - 1
                    where = pa.array(doc + block.lo)
                    columns = [batch.column(0).take(where), batch.column(1).take(where), pa.array(h.view(np.int64)), pa.array(around.view(np.int64))]
                    columns += [pa.array(x.astype(np.int32)) for x in (at - block.bounds[doc], at - last, at - first)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "version", "h", "around", "at", "near", "far"])

    return docs.select("id", "version", "text").mapInArrow(run, f"id {kind}, version long, h long, around long, at int, near int, far int")


_SURROUNDINGS = "key long, around long, near int, far int, n long, left binary, right binary"


def _surroundings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (id, version, places) with the bytes around each place: key, m, around, near, far, n, left, right."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            out, many = [], []
            for i, places in enumerate(batch.column(1).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for x in places:
                    at = x["at"]
                    out.append((x["h"], x["around"], x["near"], x["far"], x["n"], text[at - x["far"] : at][::-1], text[at : at + length - x["near"]]))
                    many.append(x["m"])
            rows = _rows(out)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(many, pa.int64())], [*rows.schema.names, "m"])

    same = docs["id"].eqNullSafe(wanted["id"]) & (docs["version"] == wanted["version"])
    return docs.join(wanted, same).select("text", "places").mapInArrow(run, f"{_SURROUNDINGS}, m long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["key", "around", "near", "far", "n", "left", "right"])


def _sort_groups(rows: DataFrame, length: int) -> DataFrame:
    """(key, around, spans): each surrounding's recurring stretches; groups are bounded."""
    span = pa.list_(pa.struct([("left", pa.int32()), ("right", pa.int32())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal held
            spans = recurring([r[5] for r in held], [r[6] for r in held], [r[4] for r in held], length)
            columns = [pa.array([r[i] for r in held], pa.int64()) for i in (0, 1)]
            columns.append(pa.array([[{"left": a, "right": b} for a, b in {*s}] for s in spans], span))
            held = []
            return pa.RecordBatch.from_arrays(columns, ["key", "around", "spans"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    yield close()
                if not held or row[1] != held[-1][1]:
                    held.append(row)
        if held:
            yield close()

    return rows.repartition("key").sortWithinPartitions("key", "around").mapInArrow(run, "key long, around long, spans array<struct<left: int, right: int>>")


def _halves(rows: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """Rows of too large groups, each cut at the middle of its block of distances.

    At level v the distances 0..length - gram fall into 2^v blocks; a block's windows all
    hold the bytes from its nearest distance left of the anchor to its farthest window's end,
    which join the key.
    """
    reach = length - gram + 1
    width = max(1, -(-reach // (1 << level)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, parents = [], []
            for key, around, near, far, n, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(near // width, far // width + 1):
                    lo, hi = max(near, b * width), min(far, b * width + width - 1)
                    inner = left[: b * width][::-1] + right[: max(length - (b * width + width - 1), 0)]
                    a, c = left[:hi], right[: length - lo]
                    own = lambda x, salt: int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=salt).digest(), signed=True)
                    mark = f"{key}|{b}".encode()
                    out.append((own(mark + b"|" + inner, b"core"), own(len(a).to_bytes(4) + lo.to_bytes(4) + a + c, b"around"), lo, hi, n, a, c))
                    parents.append((key, around))
            batch = _rows(out)
            columns = [pa.array([p[i] for p in parents], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "parent_key", "parent_around"])

    return rows.mapInArrow(run, f"{_SURROUNDINGS}, parent_key long, parent_around long")


def _resolve(rows: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """(key, around, spans) of all surroundings, in as many rounds as large groups need.

    m tells how many different surroundings a row's key has: too large a group is halved
    without ever being gathered.
    """
    columns = ["key", "around", "near", "far", "n", "left", "right"]
    levels, ups, level = [], [], 0
    while True:
        rows = tables.stage(rows, "surroundings")
        levels.append(tables.stage(_sort_groups(rows.where(F.col("m") <= group).select(columns), length), "sorted"))
        large = rows.where(F.col("m") > group)
        if large.isEmpty():
            break
        level += 1
        cut = tables.stage(_halves(large.select(columns), level, length, gram), "halves")
        ups.append(cut.select("parent_key", "parent_around", "key", "around"))
        counts = tables.stage(cut.select("key", "around").distinct().groupBy("key").agg(F.count("*").alias("m")), "counts")
        rows = cut.groupBy("key", "around").agg(*(F.first(c).alias(c) for c in columns[2:4]), F.sum("n").alias("n"), *(F.first(c).alias(c) for c in columns[5:])).join(counts, "key")
    found = levels.pop()
    while ups:
        raised = found.join(ups.pop(), ["key", "around"]).select(F.col("parent_key").alias("key"), F.col("parent_around").alias("around"), "spans")
        found = levels.pop().union(raised)
    return found


def _text(left: bytes, kind: pa.DataType) -> pa.Array:
    """One text of these bytes, U+FFFD where a character is cut, without a str of a long one."""
    try:
        return pa.array([left], pa.binary()).cast(kind)
    except pa.ArrowInvalid:
        return pa.array([left.decode(errors="replace")], kind)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, kept_sha256, repeated (was any removed?), the text that is left and the removed byte spans.

    Null and empty texts have no bytes and stay as they are. Spans may start or end inside a character;
    what is left of one reads U+FFFD in the text (not if texts are binary), kept_sha256 is of the bytes
    themselves. Rows that repeat an id are documents of their own;
    two with equal text repeat each other. Extra columns are not read, and an empty table
    gives an empty result. Texts of any length are read whole, over STRETCH in stretches.
    length is over 64.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("version", F.xxhash64("text"))
    long = docs.where(F.octet_length("text") >= length)
    found = tables.stage(_find(long, length), "anchors")
    # Tables are staged before they are joined on a hash: such joins stand between plain
    # exchanges, where AQE can split what a very common hash holds.
    again = tables.stage(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    found = tables.stage(found.join(again, "h"), "recurring")
    place = F.struct("id", "version", "at", "near", "far")
    around = tables.stage(found.groupBy("h", "around").agg(F.count("*").alias("n"), F.min(place).alias("place")), "around")
    several = tables.stage(around.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "several")
    # Most anchors that recur look the same everywhere: their windows all recur, unsorted.
    alike = around.join(several, "h", "left_anti").select(
        F.col("h").alias("key"), "around",
        F.array(F.struct(F.col("place.far").alias("left"), (length - F.col("place.near")).alias("right"))).alias("spans"),
    )
    wanted = around.join(several, "h").select("place.id", "place.version", F.struct("h", "around", "n", "m", "place.at", "place.near", "place.far").alias("x"))
    wanted = wanted.groupBy("id", "version").agg(F.collect_list("x").alias("places"))
    spans = alike.union(_resolve(_surroundings(long, wanted, length), length, GRAM, group)).withColumnRenamed("key", "h").where(F.size("spans") > 0)
    per = found.join(spans, ["h", "around"]).select("id", "version", F.explode(F.transform("spans", lambda s: F.struct((F.col("at") - s["left"]).alias("lo"), (F.col("at") + s["right"]).alias("hi")))).alias("span"))
    per = per.groupBy("id", "version").agg(F.collect_set("span").alias("spans"))
    kind, text_kind = (docs.schema[c].dataType.simpleString() for c in ("id", "text"))

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            data, offsets = text_buffers(column)
            sizes, removed, runs, digests, where = [], [], [], [], []
            new, done = [], 0
            for i, spans in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                lo, hi = merged(*(np.array([s[k] for s in spans or []], np.int64) for k in ("lo", "hi")))
                kept = [text[a:b] for a, b in zip(np.r_[0, hi], np.r_[lo, len(text)], strict=True)]
                digest = hashlib.sha256()
                for x in kept:
                    digest.update(x)
                if len(lo):
                    new += [column.slice(done, i - done), _text(b"".join(kept), column.type)]
                    done = i + 1
                sizes.append(len(text))
                removed.append(int((hi - lo).sum()))
                runs.append(len(lo))
                digests.append(digest.hexdigest())
                where.append([*zip(lo.tolist(), hi.tolist(), strict=True)])
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string()), pa.array([n > 0 for n in removed], pa.bool_())]
            columns.append(pa.chunked_array([*new, column.slice(done)], column.type).combine_chunks())
            columns.append(pa.array([[{"lo": a, "hi": b} for a, b in w] for w in where], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated", text_column, "removed"])

    same = docs["id"].eqNullSafe(per["id"]) & docs["version"].eqNullSafe(per["version"])
    joined = docs.join(per, same, "left").select(docs["id"], "text", "spans")
    return joined.mapInArrow(cut, f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean, `{text_column}` {text_kind}, removed array<struct<lo: long, hi: long>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(tables.read(spark, sf_dir, "documents")).drop("removed")
