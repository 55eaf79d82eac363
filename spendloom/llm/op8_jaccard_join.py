"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles. Sets of a size band are cut into m
blocks by hash, and each block is the XOR of its shingles: two sets of similarity 0.8 differ
in at most (|A| + |B|) / 9 shingles, so in at most that many blocks, and must agree in the
others. So each set offers only its |A| / 4 + 1 rarest non-empty blocks, and two linked sets
always meet in one (pigeonhole). How rare a shingle is comes from a counting table of fixed
size over all documents, so text that many documents share is offered last.

Sets that meet are compared by parity bit sketches, whose Hamming distance never exceeds
the symmetric difference, and what passes is verified on the shingles themselves. First each
set is verified against a few leaders, then sets that met and are still in different
components against each other, so copies are never expanded into all their pairs, and no
link that joins components is lost.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm import tables
from spendloom.llm.components import components
from spendloom.llm.textblock import SPACED, blocks, gram_hashes, mix, span_hashes, tidy

SHINGLE = 5
COUNTER_BITS = 20
COUNTER_ROWS = 32
FILTER_BITS = 23
#: Bits of one row of bitmap_construct_agg.
BITMAP_BITS = 1 << 15
SMALL_BAND = 5
#: Rounds in which every set is compared with one leader per key before the exact one.
TURNS = 2
#: Sets of one key that are compared in one piece.
PART = 4_096
#: Such pieces of a key are fewer than 2^PART_BITS.
PART_BITS = 20
#: Smallest keys of a set that tell under which one of them a pair is given.
FIRST_KEYS = 8
#: Sketches are this many times shorter where they are compared key by key.
BRIEF = 4

_U = np.uint64


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow column."""
    for block in blocks(column):
        words = block.words(SPACED, lower=True)
        hashes = words.hashes()
        grams = gram_hashes(hashes, SHINGLE)
        for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
            if hi - lo >= SHINGLE:
                own = np.sort(grams[lo : hi - SHINGLE + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            elif hi > lo:
                yield span_hashes(hashes, np.array([lo]), np.array([hi]))
            else:
                yield hashes[:0]


def set_hash(shingles: np.ndarray) -> int:
    """A set's node in the graph of links: a 64-bit hash of the set."""
    return int(np.bitwise_xor.reduce(mix(shingles ^ _U(0x5851F42D4C957F2D))).view(np.int64))


def offered(shingles: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Keys of the |A| / 4 + 1 rarest blocks, for the band of the set and the one below if it may have links there."""
    n = len(shingles)
    if not n:
        return np.zeros(0, _U)
    rare = counters[shingles >> _U(64 - COUNTER_BITS)]
    band, out = n.bit_length() - 1, []
    for b in (band, band - 1) if 4 * n < 5 << band and band else (band,):
        if b < SMALL_BAND:  # every shingle is a block of its own
            keys, rank = shingles, rare
        else:
            m = (1 << b) * (1 if b >= 7 else 4)
            at = ((shingles >> _U(32)) * _U(m)) >> _U(32)  # sets are sorted, so blocks are runs
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            keys, rank = np.bitwise_xor.reduceat(shingles, first) ^ (at[first] << _U(20)), np.minimum.reduceat(rare, first)
        keys = mix(keys ^ _U(b << 56))
        need = n // 4 + 1
        if need < len(keys):
            order = (rank.astype(_U) << _U(58)) | (keys >> _U(6))
            keys = keys[np.argpartition(order, need)[:need]]
        out.append(keys)
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits of shingle counts, about eight to sixteen bits a shingle; halves fold by XOR."""
    bits = max(64, 1 << (8 * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def brief(long: bytes) -> bytes:
    """The sketch folded BRIEF times by XOR, of 64 bits at least; its distances stay lower bounds."""
    words = np.frombuffer(long, _U)
    return np.bitwise_xor.reduce(words.reshape(min(BRIEF, len(words)), -1), axis=0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded: at most the symmetric difference."""
    a, b = (np.frombuffer(x, _U) for x in sorted((a, b), key=len))
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _measure(docs: DataFrame) -> DataFrame:
    """(id, row keys, n, node) of every document, and rows with part and counts of the shingle counters."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            n, nodes = [], []
            for own in shingle_sets(batch.column(3)):
                n.append(len(own))
                nodes.append(set_hash(own))
                np.add.at(counters, own >> _U(64 - COUNTER_BITS), np.uint32(1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(n), pa.binary())], names)
        if counters.any():
            parts = [p.tobytes() for p in counters.reshape(COUNTER_ROWS, -1)]
            gone = [pa.nulls(COUNTER_ROWS, c.type) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*gone, pa.array(range(COUNTER_ROWS), pa.int64()), pa.nulls(COUNTER_ROWS, pa.int64()), pa.array(parts, pa.binary())], names)

    names = ["id", "k1", "k2", "n", "node", "counts"]
    return docs.select("id", "k1", "k2", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, n long, node long, counts binary")


def _rarity(measured: DataFrame) -> np.ndarray:
    """Logarithms of the summed counters: 2^COUNTER_BITS small numbers, whatever the corpus."""

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total]), pa.array([np.minimum(np.log2(x + 1) , 63).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], ["part", "logs"])

    parts = measured.where("counts is not null").select(F.col("n").alias("part"), "counts")
    rows = parts.repartition(COUNTER_ROWS, "part").mapInArrow(add, "part long, logs binary").collect()
    logs = np.zeros((COUNTER_ROWS, (1 << COUNTER_BITS) // COUNTER_ROWS), np.uint8)
    for part, row in rows:
        logs[part] = np.frombuffer(row, np.uint8)
    return logs.ravel()


def _meetings(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(key, node, leader) of every block key that several different sets offer."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    @tidy
    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, seen = [], [], set()  # a batch's copies of one set offer once
            for own in shingle_sets(batch.column(0)):
                node = set_hash(own)
                if len(own) and node not in seen:
                    seen.add(node)
                    keys.append(offered(own, shared.value).view(np.int64))
                    nodes.append(np.full(len(keys[-1]), node))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; the last one waits for the next batch, so no key is ever gathered.
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        leader, met = None, False  # of the key of the waiting row; was a row of it given before?
        for batch in (*batches, None):
            if batch is not None and not batch.num_rows:
                continue
            key, node = held if batch is None else (np.r_[h, c.to_numpy()] for h, c in zip(held, batch.columns, strict=True))
            if not len(key):
                continue
            fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[fresh], node[fresh]
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            leaders = node[first]
            if leader is not None:
                leaders[0] = leader
            size = np.bincount(of)
            size[0] += met
            several = size[of] > 1
            last = len(key) if batch is None else len(key) - 1
            give = several[:last]
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:last][give]) for x in (key, node, leaders[of])], ["key", "node", "leader"])
            if batch is not None:
                held = (key[-1:], node[-1:])
                leader, met = leaders[-1], bool(size[of[-1]] > 1)

    keys = docs.select("text").mapInArrow(offer, "key long, node long")
    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "key long, node long, leader long")


def _active(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(node, n, sketch, brief, text) of the documents (k1, k2, node) that met another set.

    A bitmap of fixed size drops most others before the join moves any text.
    """
    slot = F.pmod("k1", F.lit(1 << FILTER_BITS)).cast("int")
    parts = active.select(slot.alias("slot")).distinct().groupBy((F.col("slot") / BITMAP_BITS).cast("int").alias("part"))
    bitmap = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    # One row of 4 kB for each of the 2^FILTER_BITS / BITMAP_BITS parts, whatever the corpus.
    for part, bits in parts.agg(F.bitmap_construct_agg((F.col("slot") % BITMAP_BITS).cast("long")).alias("bits")).collect():
        bitmap[part * BITMAP_BITS // 8 : (part + 1) * BITMAP_BITS // 8] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @tidy
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            keep = (shared.value[at >> 3] >> (at & 7)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select([0, 1, 2])

    texts = docs.select("k1", "k2", "text", slot.alias("slot")).mapInArrow(likely, "k1 long, k2 long, text string")
    # Rows that repeat id and text lie together after the join, so one is taken without another shuffle.
    texts = texts.join(active, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("node").alias("node"), F.first("text").alias("text"))

    @tidy
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*shingle_sets(batch.column(1))]
            sketches = [sketch(x) for x in sets]
            new = [pa.array([len(x) for x in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array([brief(x) for x in sketches], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new, batch.column(1)], ["node", "n", "sketch", "brief", "text"])

    return texts.select("node", "text").mapInArrow(draw, "node long, n long, sketch binary, brief binary, text string")


def _linked(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity: sketches first, shingles for what passes."""
    side = lambda x, *c: active.select(F.col("node").alias(x), *(F.col(k).alias(f"{k}_{x}") for k in c))

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                # |A & B| >= p/100 |A | B| bounds the sizes and the symmetric difference.
                fits = 100 * min(na, nb) >= percent * max(na, nb)
                keep.append(fits and differing(sa, sb) * (100 + percent) <= (na + nb) * (100 - percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    close = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    close = close.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(near, "a long, b long")

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def own(node: int, text: str) -> np.ndarray:
            if node not in known:
                known[node] = next(shingle_sets(pa.array([text])))
                if len(known) > 256 or sum(map(len, known.values())) > 2_000_000:
                    known.popitem(last=False)
                    return known.get(node) if node in known else next(shingle_sets(pa.array([text])))
            return known[node]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = own(a, ta), next(shingle_sets(pa.array([tb])))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    texts = close.join(side("b", "text"), "b").join(side("a", "text"), "a")
    return texts.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _labelled(meetings: DataFrame, labels: DataFrame) -> DataFrame:
    """Meetings with the component of each node; a node without links is one of its own."""
    return meetings.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _to_leaders(meetings: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Pairs of every node with one node of another component under each of its keys.

    Which one leads is the same order for all keys and another one each turn, so a node
    meets few leaders however many keys it has.
    """
    at = _labelled(meetings, labels)
    lead = at.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "component")).alias("lead"))
    pairs = at.join(lead, "key").where("component <> lead.component").select("node", F.col("lead.node").alias("leader"))
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _near_within(n: list[int], sketches: list[bytes], components: list[int], percent: int, across: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """Places of pairs of different components whose sizes and sketches fit.

    across: which of two parts each belongs to; then only pairs over both parts count.
    """
    size, part = np.array(n), np.array(components)
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(sketches):
        by_length.setdefault(len(x), []).append(i)
    stacks = {k: np.frombuffer(b"".join(sketches[i] for i in v), _U).reshape(len(v), -1) for k, v in by_length.items()}
    for short in by_length:
        for long in by_length:
            if long < short:
                continue
            folded = stacks[long].reshape(len(by_length[long]), long // short, -1)
            folded = np.bitwise_xor.reduce(folded, axis=1)
            others = np.array(by_length[long])
            for row, i in zip(stacks[short], by_length[short], strict=True):
                good = (part[others] != part[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))
                if long == short:
                    good &= others > i
                if across is not None:
                    good &= across[others] != across[i]
                at = np.flatnonzero(good)
                if len(at):
                    apart = np.bitwise_count(folded[at] ^ row).sum(axis=1, dtype=np.int64)
                    for j in others[at[apart * (100 + percent) <= (size[others[at]] + size[i]) * (100 - percent)]].tolist():
                        yield i, j


def _crossing(meetings: DataFrame, labels: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Pairs that met under a key, are in different components and are near by their sketches.

    A key of many nodes is dealt out as pairs of parts of about PART nodes. Every row has its
    node's smallest keys: a pair is left to the smallest key that both show, so one that
    shares many keys is given about once.
    """
    at = _labelled(meetings, labels)
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    rows = at.join(mixed.select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "key")
    smallest = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("keys"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Both parts and the own one in a number: rows of a pair of parts lie together in its order.
    deal = F.shiftleft(F.least("own", "other").cast("long"), 2 * PART_BITS) + F.shiftleft(F.greatest("own", "other").cast("long"), PART_BITS) + F.col("own")
    rows = rows.select("key", deal.alias("deal"), "node", "component")
    rows = rows.join(active.select("node", "n", "brief").join(smallest, "node"), "node").select("key", "deal", "node", "component", "n", "brief", "keys")
    rows = rows.repartition("key", F.shiftright("deal", PART_BITS)).sortWithinPartitions("key", "deal", "node")

    @tidy
    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in (*batches, None):
            rows = held + ([*zip(*(c.to_pylist() for c in batch.columns), strict=True)] if batch is not None else [])
            lo, found = 0, []
            for hi in range(1, len(rows) + 1):
                if hi == len(rows) and batch is not None or hi < len(rows) and rows[hi][0] == rows[lo][0] and rows[hi][1] >> PART_BITS == rows[lo][1] >> PART_BITS:
                    continue
                if hi - lo > 1:
                    key, deal, node, component, n, sketches, keys = zip(*rows[lo:hi], strict=True)
                    if min(component) != max(component):
                        own = np.array(deal)
                        near = _near_within(n, sketches, component, percent, own if own[0] != own[-1] else None)
                        found += [(node[x], node[y]) for x, y in near if min({*keys[x]} & {*keys[y]}, default=key[0]) >= key[0]]
                lo = hi
            held = rows[lo:]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found]), pa.array([max(x) for x in found])], ["a", "b"])

    return rows.mapInArrow(cross, "a long, b long").distinct()


def _lifted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, which only join those there are."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    lifted = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    upper = components(lifted)
    moved = labels.join(upper.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    new = upper.join(labels.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("top", "component").alias("component")).union(new.select("node", "component"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80) -> DataFrame:
    """Per row: id, k1 and k2 (two hashes of its id and text), n shingles, and its component's root and least id.

    percent is at least 80, which the offered share of blocks rests on. Rows are linked by
    their texts alone, whether ids are null or repeat. Null, empty and wordless texts have no
    shingles, no root, and are linked with nothing; their least id is their own.
    """
    if percent < 80:
        raise ValueError("the offered blocks prove links of similarity 0.8 or more only")
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    docs = docs.withColumns(tables.row_keys("id", "text"))
    measured = tables.stage(_measure(docs), "measured")
    rarity = _rarity(measured)
    each = measured.where("counts is null").select("id", "k1", "k2", "n", "node")
    met = tables.stage(_meetings(docs, rarity), "meetings")
    # One document stands for all with the same set.
    stands = each.where("n > 0").join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"))
    active = tables.bucketed(_active(docs, stands.select("k.k1", "k.k2", "node")), "active", "node")

    votes = met.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    # One leader each: the one met under most keys.
    first = votes.groupBy("node").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))
    links = tables.stage(_linked(first.select(F.col("leader").alias("a"), F.col("node").alias("b")), active, percent), "links")
    labels = tables.stage(components(links), "labels")
    for turn in range(TURNS + 1):
        pairs = _to_leaders(met, labels, turn) if turn < TURNS else _crossing(met, labels, active, percent)
        more = tables.stage(_linked(pairs, active, percent), "links")
        labels = tables.stage(_lifted(labels, more), "labels")

    # Ids are reduced per set, then per component, and come back through sets: rows of one
    # component never meet, and a set of very many rows is joined with a table as it lies.
    roots = labels.withColumnRenamed("component", "root")
    sets = each.where("n > 0").groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sets = tables.stage(sets, "sets")
    least = tables.stage(sets.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    linked = sets.select("node", "root").join(least, "root")
    alone = sets.join(least.select("root"), "root", "left_anti").select("root", "node", "least")
    least = tables.stage(linked.union(alone), "least")
    there, empty = each.where("n > 0").join(least, "node"), each.where("n = 0")
    there = there.select("id", "k1", "k2", "n", "root", "least")
    return there.union(empty.select("id", "k1", "k2", "n", F.lit(None).cast("long"), "id"))


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest id reachable by links.

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows that
    repeat are each returned; two with equal text are linked as any copies. A row without an
    id is linked as any other; a component of such rows alone has a null id. Texts of any
    length are compared whole. Ties: none, least ids are unique values. Extra columns are not
    read, and an empty table gives an empty result.
    """
    found = groups(docs, id_column, text_column, percent)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(tables.read(spark, sf_dir, "documents"))
