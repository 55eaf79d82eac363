"""Names that differ by little: pairs over a difflib ratio, and the leaders that stand for them.

Two names of a and b letters with a ratio over t match at least m = t (a + b) / 2 letters in
order. Where few letters may differ, every name gives what is left of it without a - m of its
letters: two names meet where they leave the same, so all that meets has m letters in common.
Lengths that would leave too many texts use two-letter grams: such names share at least
3 m - 1 - a - b of theirs, a gram's k-th occurrence being one of its own, and meet under the
rarest grams that must hold a shared one. Common grams are dealt over more keys. Of what meets, only what
leads to a leader is compared, as far as the walk has come.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendloom.operators.shipping import settled, ship

#: Under it short names may share no gram: all names are compared.
LEAST_GRAMS = 0.8
#: Names with one gram that one key holds.
DEAL = 1_000
#: So many texts two names may leave without some of their letters; lengths that leave more meet by grams.
LEAVE = 800
#: Tasks a core for what is slow and small, which Spark would put into few.
TASKS = 3
#: So many pairs are resolved in one task; more are first cut down in rounds.
LOCAL = 200_000


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: Spark takes what a name is cut into, hundreds of rows, to be as small as the file it came from."""
    return left.join(right.hint("merge"), on, how)


def grams(name: str) -> list[int]:
    """Two-letter grams of a name, numbered by occurrence, as distinct numbers."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(name) - 1):
        gram = name[i : i + 2]
        k = seen[gram] = seen.get(gram, -1) + 1
        out.append((ord(gram[0]) << 42) | (ord(gram[1]) << 21) | min(k, (1 << 21) - 1))
    return out


@lru_cache(maxsize=4096)
def reach(size: int, threshold: float) -> int:
    """How many of a name's rarest grams hold one that any name over the threshold shares."""
    least, other = size, max(1, int(size * threshold / (2 - threshold)) - 1)
    while True:
        both = size + other
        m = int(threshold * both / 2 - 1e-9) + 1
        if m <= min(size, other):
            least = min(least, 3 * m - 1 - both)
        elif other > size:
            return min(size - 1, size - least)
        other += 1


def common(a: str, b: str) -> int:
    """Letters of the longest common subsequence, which no difflib match exceeds; bits of one number are a's places."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


def near(a: str, b: str, threshold: float) -> bool:
    return 2.0 * common(a, b) / (len(a) + len(b)) > threshold and difflib.SequenceMatcher(None, b, a).ratio() > threshold


def least(a: int, b: int, threshold: float) -> int:
    """How many letters names of these lengths must match."""
    return int(threshold * (a + b) / 2 - 1e-9) + 1


def left_out(size: int, sizes: tuple[int, ...], threshold: float) -> dict[int, int]:
    """Lengths that meet names of this one by what is left of both: how many letters go from this one."""
    found = {}
    for other in sizes:
        m = least(size, other, threshold)
        if m <= min(size, other) and comb(size, size - m) + comb(other, other - m) <= LEAVE:
            found[other] = size - m
    return found


def wide(size: int, sizes: tuple[int, ...], threshold: float) -> list[int]:
    """Lengths that may be near this one and would leave too many texts."""
    cut = left_out(size, sizes, threshold)
    return [other for other in sizes if other not in cut and least(size, other, threshold) <= min(size, other)]


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def remains(names: list[str], out: int) -> np.ndarray:
    """Hashes of what is left of names of one length without any `out` letters: a row a name, with repeats.

    Equal texts have equal hashes; others may, so what meets is compared.
    """
    size = len(names[0])
    letters = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(names), size).astype(np.uint64)
    power = np.cumprod(np.full(size + 1, _ODD, dtype=np.uint64))
    back = np.cumprod(np.full(out + 1, pow(int(_ODD), -1, 1 << 64), dtype=np.uint64))
    ahead = np.zeros((len(names), size + 1), dtype=np.uint64)
    np.cumsum(_mixed((letters + np.uint64(1)) * _ODD) * power[:size], axis=1, out=ahead[:, 1:])
    columns = []
    for places in combinations(range(size), out):
        total, start = 0, 0
        for shift, place in enumerate((*places, size)):
            piece = ahead[:, place] - ahead[:, start]
            total = total + (piece if not shift else piece * back[shift - 1])
            start = place + 1
        columns.append(_mixed(total))
    return np.stack(columns, axis=1)


def _met_by_remains(names: DataFrame, sizes: tuple[int, ...], threshold: float) -> DataFrame:
    """(a, b), a < b: numbers of names that leave the same text; a pair of lengths has keys of its own."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, group in batch.groupby(batch["low"].str.len()):
                made: dict[int, np.ndarray] = {}
                for other, out in left_out(int(size), sizes, threshold).items():
                    if out not in made:
                        made[out] = np.sort(remains(group["low"].tolist(), out), axis=1)
                    keys = made[out]
                    once = np.ones(keys.shape, dtype=bool)
                    once[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    lengths = np.uint64(((min(size, other) << 32) | max(size, other)) * int(_ODD) % (1 << 64))
                    rows = np.repeat(group["id"].to_numpy(), once.sum(axis=1))
                    side = 2 if size == other else int(size > other)
                    yield pd.DataFrame({"key": _mixed(keys[once] + lengths).view(np.int64), "id": rows, "side": np.full(len(rows), side, dtype=np.int8)})

    keyed = names.mapInPandas(cut, "key long, id long, side byte")
    shorter = keyed.where("side <> 1").select("key", F.col("id").alias("x"), "side")
    longer = keyed.where("side <> 0").select("key", F.col("id").alias("y"))
    met = _joined(shorter, longer, "key").where((F.col("side") == 0) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _met_by_grams(names: DataFrame, sizes: tuple[int, ...], threshold: float) -> DataFrame:
    """(a, b), a < b: numbers of names of lengths that are `wide` and share enough grams."""
    meets = {size: others for size in sizes if (others := wide(size, sizes, threshold))}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[len(x) in meets for x in batch["low"]]]
            if batch.empty:
                continue
            found = [grams(x) for x in batch["low"]]
            yield pd.DataFrame({"id": batch["id"], "size": [len(x) for x in batch["low"]], "all": found, "meets": [meets[len(x)] for x in batch["low"]], "reach": [reach(len(x), threshold) for x in batch["low"]]})

    each = names.mapInPandas(cut, "id long, size int, all array<long>, meets array<int>, reach int")
    if threshold < LEAST_GRAMS:
        keyed = each.select("*", F.lit(0).cast("long").alias("gram"), F.lit(1 << 16).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("rare"))
    else:
        single = each.select("id", F.explode("all").alias("gram"))
        counts = single.groupBy("gram").agg(F.count("*").alias("n"))
        rare = _joined(single, counts, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("rare"))
        keyed = _joined(each, rare, "id").withColumn("rare", F.slice("rare", 1, F.col("reach")))
        keyed = keyed.select("id", "size", "all", "meets", F.explode("rare").alias("key"), F.col("rare.gram").alias("rare")).select("id", "size", "all", "meets", "rare", F.col("key.gram").alias("gram"), F.col("key.n").alias("n"))
    # A gram's names are dealt over `parts` keys; each meets all others of the lengths it may, once in every part.
    parts = F.ceil(F.col("n") / DEAL).cast("int")
    left = keyed.select(F.col("gram"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in ("id", "size", "all", "rare")))
    right = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("gram", "part", F.explode("meets").alias("size_a"), *(F.col(c).alias(f"{c}_b") for c in ("id", "size", "all", "rare")))
    both = F.col("size_a") + F.col("size_b")
    m = F.floor(F.lit(threshold) * both / 2 - 1e-9) + 1
    met = _joined(left, right, ["gram", "part", "size_a"]).where(
        (F.col("id_a") < F.col("id_b")) & (m <= F.least("size_a", "size_b"))
        # of the keys that both have, the first alone gives the pair
        & (F.element_at(F.array_intersect("rare_a", "rare_b"), 1) == F.col("gram"))
        & (F.size(F.array_intersect("all_a", "all_b")) >= 3 * m - 1 - both)
    )

    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _spread(names: DataFrame) -> int:
    return names.sparkSession.sparkContext.defaultParallelism * TASKS


def _met(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, numbers of names (id, low) that may be near: all that are, and few that are not."""
    # As many rows as there are lengths.
    sizes = tuple(sorted(r["n"] for r in names.select(F.char_length("low").cast("int").alias("n")).distinct().collect()))
    met = _met_by_remains(names.repartition(_spread(names), "id"), sizes, threshold)
    if any(wide(size, sizes, threshold) for size in sizes):
        # what only shares grams is cut down to what has the letters in common
        met = met.union(_kept(_met_by_grams(names, sizes, threshold), names, lambda a, b: 2.0 * common(a, b) / (len(a) + len(b)) > threshold))
    return met


def _kept(edges: DataFrame, names: DataFrame, test: Callable[[str, str], bool]) -> DataFrame:
    """Edges whose two names pass the test."""
    low = lambda c: names.select(F.col("id").alias(c), F.col("low").alias(f"low_{c}"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[test(a, b) for a, b in zip(batch["low_a"], batch["low_b"], strict=True)], ["a", "b"]]

    both = _joined(_joined(edges, low("a"), "a"), low("b"), "b").select("a", "b", "low_a", "low_b")
    return both.repartition(_spread(names), "a", "b").mapInPandas(verify, "a long, b long")


def _near(edges: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    return _kept(edges, names, lambda a, b: near(a, b, threshold))


def pairs(names: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, numbers of names (id, low), numbered in order of distinct lower-case names, with SequenceMatcher(None, b, a).ratio() > threshold."""
    return _near(_met(names, threshold), names, threshold)


def _without(edges: DataFrame, side: str, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node", side), side, "left_anti")


def members(edges: DataFrame, near: Callable[[DataFrame], DataFrame], local: int = LOCAL) -> DataFrame:
    """Nodes (numbers) that have a smaller neighbour which is no member itself; neighbours are those of the edges (a, b), a < b, that `near` leaves.

    The same as walking all nodes in order. A round walks the first nodes, as far as about `local`
    edges lead to them, in one task; they and all nodes without a smaller node at an edge left are settled, and with them
    the neighbours of those that are no members. So each round ends with that many edges less at least, and
    edges from members are never asked for.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: dict[int, list[int]] = {}
        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                before.setdefault(b, []).append(a)
        found: set[int] = set()
        for b in sorted(before):
            if any(a not in found for a in before[b]):
                found.add(b)
        yield pd.DataFrame({"node": sorted(found)}, dtype="int64")

    # not coalesce(1), which would leave all that `near` does to that task
    walked = lambda few: near(few.select("a", "b")).repartition(1).mapInPandas(walk, "node long")
    rounds = []
    while (many := edges.count()) > local:
        cut = edges.agg(F.percentile_approx("b", local / many, 10_000)).first()[0]
        first = _without(edges.where(F.col("a") <= cut), "a", walked(edges.where(F.col("b") <= cut)))
        later, after = edges.where(F.col("a") > cut), edges.select(F.col("b").alias("node"))
        joined = settled(near(first.union(_without(later, "a", after)).select("a", "b")).select(F.col("b").alias("node")).distinct())
        rounds.append(joined)
        # a node that none comes before has given all it can
        later = later.join(after.withColumnRenamed("node", "a").distinct(), "a", "left_semi")
        edges = settled(_without(_without(later, "a", joined), "b", joined).select("a", "b"))
    out = walked(edges)
    for joined in rounds:
        out = out.union(joined)
    return out


def leaders(names: DataFrame, threshold: float, local: int = LOCAL) -> DataFrame:
    """(low, leader): every distinct lower-case name beside the smallest leader near it, or itself.

    In the order of names, one that is near no leader before it becomes a leader.
    """
    # Partitions of a sorted table follow each other, and so do these numbers; settled, they stay.
    names = settled(names.select("low").orderBy("low").withColumn("id", F.monotonically_increasing_id()))
    edges = settled(_met(names, threshold))
    moved = settled(members(edges, lambda some: _near(some, names, threshold), local))
    led = _without(edges.join(moved.withColumnRenamed("node", "b"), "b", "left_semi"), "a", moved)
    under = _near(led, names, threshold).groupBy("b").agg(F.min("a").alias("a"))
    named = _joined(under, names.select(F.col("id").alias("a"), F.col("low").alias("leader")), "a").select(F.col("b").alias("id"), "leader")
    return _joined(names, named, "id", "left").select("low", F.coalesce("leader", "low").alias("leader"))


def lowered(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column and their lower case as Python has it: (column, low)."""

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(low=[x.lower() for x in batch[column]])

    return df.select(column).distinct().mapInPandas(lower, f"`{column}` string, low string")


def canonical(df: DataFrame, column: str, threshold: float, local: int = LOCAL) -> DataFrame:
    """(column, canonical) of the distinct values of a column without nulls."""
    ship(df.sparkSession)
    forms = settled(lowered(df, column))
    first = forms.groupBy("low").agg(F.min(column).alias("canonical"))
    of = leaders(first.select("low"), threshold, local)
    return _joined(_joined(forms, of, "low"), first.withColumnRenamed("low", "leader"), "leader").select(column, "canonical")
