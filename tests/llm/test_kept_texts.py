"""The text that substring deduplication leaves."""

import hashlib
import random

from spendloom.llm import op7_suffix_dedup as op7


def test_text_that_is_left(spark):
    random.seed(7)
    shared = "".join(random.choices("abcdef ", k=150))
    texts = [None, "", "only here", "one é" + shared + " end", "two ©" + shared, shared, "x" * 99]
    # é and © end with the same byte, so the common string starts inside them.
    want = [None, b"", b"only here", b"one \xc3 end", b"two \xc2", b"", b"x" * 99]
    table = spark.createDataFrame([*enumerate(texts)], "n long, body string")
    found = op7.deduplicate(table, "n", "body", length=100)
    got = sorted((r.n, r.body) for r in found.collect())
    assert got == [(i, x if x is None else x.decode(errors="replace")) for i, x in enumerate(want)]
    exact = op7.deduplicate(table.selectExpr("n", "cast(body as binary) body"), "n", "body", length=100).collect()
    assert sorted((r.n, r.body) for r in exact) == [*enumerate(want)]
    assert all(hashlib.sha256(r.body or b"").hexdigest() == r.kept_sha256 for r in exact)


def test_the_query_returns_what_is_left(spark, sf_dir):
    given = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = op7.op7_suffix_dedup(spark, sf_dir).collect()
    assert len(found) == len(given)
    for r in found:
        if not r.n_removed:
            assert r.text == given[r.doc_id]
        elif "�" not in r.text:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert any(r.n_removed for r in found)
