"""Near names against the plain walk over all of them."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import nearnames, normalise
from spendloom.plans.messy import typed_names


def walk(names, threshold):
    leaders, of = [], {}
    for name in sorted(names, key=lambda x: (x.lower(), x)):
        near = next((c for c in leaders if difflib.SequenceMatcher(None, name.lower(), c.lower()).ratio() > threshold), None)
        if near is None:
            leaders.append(name)
        of[name] = near or name
    return of


def wrong(name, rng):
    i = rng.randrange(len(name) - 1)
    return rng.choice([name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + name[i + 1 :], name[:i] + name[i] + name[i:], name[:i] + rng.choice("abxyzé") + name[i + 1 :], name.upper()])


@pytest.mark.parametrize("threshold,local", [(0.9, nearnames.LOCAL), (0.9, 0), (0.7, nearnames.LOCAL)])
def test_like_the_walk(spark, threshold, local):
    rng = random.Random(7)
    base = [" ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(rng.randint(1, 5))) for _ in range(25)]
    names = {*base, "Deutsche Telekom", "Duetsche Telekom", "eutsche Telekom", "x", "X", "ab", "aaaa" * 8, "aaaa" * 9, *(f"Supplier#{i:09d}" for i in range(0, 30))}
    for _ in range(2):
        names |= {wrong(n, rng) for n in names if len(n) > 2}
    names = sorted(names)[:: 1 if threshold > 0.8 else 3]
    found = nearnames.canonical(spark.createDataFrame([(n,) for n in names], "cleaned string"), "cleaned", threshold, local)
    assert {r["cleaned"]: r["canonical"] for r in found.collect()} == walk(names, threshold)


def test_a_typing_error_in_the_first_letters(spark):
    table = spark.createDataFrame([("Deutsche Telekom AG",), ("Duetsche Telekom",), (None,), (" ",)], "name string")
    assert {r["canonical"] for r in normalise.supplier_clusters(table, "name").collect()} == {"Deutsche Telekom"}


def test_the_registered_names(spark, sf_dir):
    names = typed_names(spark, sf_dir)
    got = normalise.supplier_clusters(names, "supplier").collect()
    want = walk({r["cleaned"] for r in got}, 0.9)
    assert {r["cleaned"]: r["canonical"] for r in got} == want and len(want) > 20
    assert sorted(r["supplier"] for r in got) == sorted({r[0] for r in names.select(F.trim("supplier")).collect()})
    assert normalise.supplier_clusters(names.limit(0), "supplier").count() == 0


def test_numbered_names_meet_only_where_they_are_near(spark):
    names = sorted({f"supplier#{i * 37:09d}" for i in range(600)} | {f"spuplier#{i * 37:09d}" for i in range(0, 600, 3)} | {"supplie#000000037", "stark industries"})
    table = spark.createDataFrame(list(enumerate(names)), "id long, low string")
    sizes = tuple(sorted({len(n) for n in names}))
    near = {(a, b) for b in range(len(names)) for a in range(b) if nearnames.common(names[a], names[b]) >= nearnames.least(len(names[a]), len(names[b]), 0.9)}
    met = [tuple(r) for r in nearnames._met_by_remains(table, sizes, 0.9).collect()]
    # by two-letter grams nearly all of them met
    assert len(met) == len(near) and {*met} == near and 100 < len(near) < len(names) ** 2 / 20
    assert {tuple(r) for r in nearnames.pairs(table, 0.9).collect()} == {(a, b) for a, b in near if nearnames.near(names[a], names[b], 0.9)}
    assert {r["leader"] for r in nearnames.leaders(table.select("low"), 0.9, 50).collect()} == {v.lower() for v in walk(names, 0.9).values()}


def test_what_names_are_cut_into_is_not_broadcast(spark):
    # hundreds of rows a name, of which Spark knows no more than the size of the names
    for like, met in (("supplier#%09d", nearnames._met_by_remains), ("the northern and southern trading company of %09d", nearnames._met_by_grams)):
        table = nearnames.settled(spark.range(60).select("id", F.format_string(like, F.col("id") * 37).alias("low")))
        found = met(table, (len(like % 0),), 0.9)
        plan = found._jdf.queryExecution().executedPlan()
        assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()
        assert found.count() > 0


@pytest.mark.parametrize("local", [0, 40, 1000])
def test_members_where_what_meets_need_not_be_near(spark, local):
    rng = random.Random(3)
    met = sorted({tuple(sorted(rng.sample(range(150), 2))) for _ in range(700)})
    near = {pair for pair in met if rng.random() < 0.4}
    asked = []

    def left(edges):
        got = edges.collect()
        asked.extend((r["a"], r["b"]) for r in got)
        return spark.createDataFrame([(r["a"], r["b"]) for r in got if (r["a"], r["b"]) in near], "a long, b long")

    want = set()
    for b in range(150):
        if any((a, b) in near and a not in want for a in range(b)):
            want.add(b)
    found = nearnames.members(spark.createDataFrame(met, "a long, b long"), left, local)
    assert sorted(r["node"] for r in found.collect()) == sorted(want)
    if local == 40:
        # edges from nodes known to be members are not compared
        assert len({*asked}) < len(met)
