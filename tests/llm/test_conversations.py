"""Repair of conversations against all edit sequences, and its edges."""

import hashlib
import itertools
import random
import re

import pytest

from spendloom.llm import op11_conversations as op

NAMES = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}


def brute(rows):
    """(cost, audit, output) of the best of all edits, at most two insertions in a row."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]

    def options(role, fault):
        yield "D", 2, None
        if fault not in "bd":
            extra = 5 if fault == "t" else 0
            yield "K", extra, role
            for r in "ua":
                yield "R", 1 + extra, r

    for choice in itertools.product(*(list(options(*r)) for r in rows)):
        least = sum(c for _, c, _ in choice)
        if best is not None and least > best[0]:
            continue
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost = least + op.INSERT * sum(map(len, between))
            if best is not None and cost > best[0]:
                continue
            shape = "".join(b + (c[2] or "") for b, c in itertools.zip_longest(between, choice, fillvalue=("", 0, "")))
            if re.fullmatch("(s?(ua)+)?", shape):
                audit = "".join("I" * len(b) + c[0] for b, c in itertools.zip_longest(between, choice, fillvalue=("", 0, "")))
                best = min(best or (1 << 30, ""), (cost, audit))
    return best


def test_least_edits():
    random.seed(3)
    for _ in range(120):
        rows = [(random.choice("suax"), random.choice("---tbd")) for _ in range(random.randint(0, 4))]
        rows = [(r if r != "x" else "-", f) for r, f in rows]
        assert op.mend("".join(r + f for r, f in rows)) == brute(rows), rows


@pytest.fixture(scope="module")
def edges(spark):
    long = "word " * 60_000 + "end."
    rows = [
        (1, 0, "system", "You help."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."),
        (2, None, "user", "First."), (2, 0, None, None), (2, 5, "assistant", "Open"), (2, 5, "assistant", "Open"),
        (None, 0, "user", long), (None, 1, "assistant", "Short."), (4, None, None, None), (5, 1, "", "No role."), (6, -9, "user", "a."), (6, 9, "assistant", "b. "), (7, 3, "assistant", "\t\n"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'mine' AS at", "'mine' AS cost", "'mine' AS fault", "'mine' AS place").repartition(3)


def test_edges(edges):
    report, repaired = op.repair(edges)
    got = {r.conv_id: r for r in report.collect()}
    assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in got.items()} == {
        1: (0, 0, 0, 0, 0, 0, "KKK"),
        2: (4, 1, 1, 1, 3, 8, "DDDD"),
        None: (0, 0, 0, 0, 0, 0, "KK"),
        4: (0, 1, 0, 0, 0, 2, "D"),
        5: (0, 0, 0, 0, 0, 2, "D"),
        6: (17, 0, 0, 1, 0, 4, "DD"),
        7: (0, 1, 0, 0, 0, 2, "D"),
    }
    lines = sorted(((r.place, r.role, r.text) for r in repaired.where("conv_id IS NULL").collect()))
    assert [(p, r, len(t)) for p, r, t in lines] == [(0, "user", 300_004), (1, "assistant", 6)]
    hashes = {r.conv_id: r.repaired_sha256 for r in op.digests(repaired).collect()}
    assert hashes[None] == hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()
    assert set(hashes) == {1, None}


def test_inserted_turns(monkeypatch):
    """At the contract's costs a deletion is always cheaper; with cheap insertions they are used."""
    monkeypatch.setattr(op, "INSERT", 1)
    random.seed(4)
    for _ in range(120):
        rows = [(random.choice("sua"), random.choice("---tb")) for _ in range(random.randint(0, 4))]
        assert op.mend("".join(r + f for r, f in rows)) == brute(rows), rows
    assert op.mend("s-a-u-a-") == (1, "KIKKK")
    assert list(op.edits("s-a-u-a-", "KIKKK")) == [(0, 0, "K", None), (1, None, "I", "user"), (2, 1, "K", None), (3, 2, "K", None), (4, 3, "K", None)]
    assert list(op.edits("u-u-", "DRI")) == [(0, 1, "R", "user"), (1, None, "I", "assistant")]


def test_long_conversation(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, '.') AS text")
    report, repaired = op.repair(rows)
    (row,) = report.collect()
    assert (row.cost, len(row.audit), set(row.audit)) == (0, n, {"K"})
    want = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}." for i in range(n))
    assert op.digests(repaired).collect()[0].repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = op.repair(op.damaged(empty), empty)
    assert report.collect() == [] and repaired.collect() == [] and op.digests(repaired).collect() == []
