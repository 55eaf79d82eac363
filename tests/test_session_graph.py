"""What a session's tables are made from, tables from iterators, exactly once after a failed task."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from spendloom.operators.session import Session
from spendloom.sources import iterators


@pytest.fixture
def session(spark):
    s = Session(spark, "graph")
    yield s
    s.close()


def test_dropping_an_upload_drops_what_was_made_from_it(spark, session):
    one = spark.range(1)
    for name, of in [("up 'a'", []), ("up b", []), ("clean a", ["up 'a'"]), ("clean b", ["up b"]), ("merged", ["clean a", "clean b"]), ("report", ["merged"]), ("only b", ["clean b"])]:
        session.save(name, one, of)
    assert session.sources("merged") == ["clean a", "clean b"] and session.downstream("up 'a'") == ["report", "merged", "clean a"]
    with pytest.raises(KeyError):
        session.invalidate("up 'a'", "unknown")
    assert len(session.names()) == 7
    assert set(session.invalidate("up 'a'", keep=False)) == {"up 'a'", "clean a", "merged", "report"}
    assert session.names() == ["clean b", "only b", "up b"]
    assert session.invalidate("only b") == [] and session.exists("only b")
    with pytest.raises(KeyError):
        session.save("x", one, ["gone"])


def test_ragged_rows(spark, session):
    parts = [lambda: iter([{"a": 1, "z": 9}, ("x", "y", "too long")]), lambda: ([i] for i in range(12_000)), lambda: []]
    assert iterators.store(session, "rows", ["a", "b"], parts) == 12_002
    got = session.read("rows")
    assert {tuple(r) for r in got.where("b IS NOT NULL").collect()} == {("x", "y")}
    assert got.where("a = '11999' AND b IS NULL").count() == 1 and got.where("a = '1'").count() == 2
    assert iterators.ragged(spark, ["a"], []).collect() == []
    with pytest.raises(ValueError):
        iterators.ragged(spark, ["a", "a"], parts)


FAILING = """
import json, os, sys, tempfile
from pyspark.sql import SparkSession
from spendloom.operators.session import Session
from spendloom.sources import iterators
folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", folder + "/w").config("spark.checkpoint.dir", folder + "/c").getOrCreate()
def part(n):
    def rows():
        for i in range(20000):
            if n == 1 and i == 15000 and not os.path.exists(folder + "/failed"):
                open(folder + "/failed", "w").close()
                raise RuntimeError("a lost task")
            yield (n, i)
    return rows
session = Session(spark, "failing")
total = iterators.store(session, "t", ["n", "i"], [part(n) for n in range(3)])
print("FOUND", json.dumps([total, session.read("t").distinct().count(), os.path.exists(folder + "/failed")]))
"""


def test_rows_stand_once_after_a_failed_task(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", FAILING, str(tmp_path)], cwd=tmp_path, env={**__import__("os").environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=150)
    assert json.loads(run.stdout.rpartition("FOUND")[2]) == [60_000, 60_000, True], run.stderr[-2000:]
