"""Source divergence against a plain count, with ties, nulls and languages without terms."""

import re
from collections import Counter, defaultdict

from brute import LOWER, edge_docs
from pyspark.sql import functions as F

from spendloom.llm import op13_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        counts[lang, source].update(words)
        held[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]
        of_lang = Counter()
        for s in sources:
            of_lang += counts[lang, s]

        def shares(count):
            size = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (size + len(kept)) for t in kept}  # noqa: B023

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(of_lang)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]  # noqa: B023
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, top in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def plain(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_edges(spark, sf_dir):
    docs = edge_docs(spark, sf_dir).selectExpr("*", "'mine' AS term", "'mine' AS total", "'mine' AS size", "'mine' AS docs", "'mine' AS words")
    rows = docs.select("text", "lang", "source").collect()
    assert plain(op.audit(docs)) == brute(rows)


def test_no_terms_and_ties(spark):
    rows = [("1 2 3", "xx", "a"), (None, "xx", "b"), ("", "xx", None), ("b a", "yy", "s"), ("a b", "yy", "t"), ("a b", "yy", "t"), ("A B c", "yy", "u"), ("z", None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = plain(op.audit(docs))
    assert got == brute(rows)
    assert [r for r in got if r[0] == "xx"] == [("xx", s, "pair", o, 0, i + 1) for s in ("", "a", "b") for i, o in enumerate(x for x in ("", "a", "b") if x != s)]
    assert op.audit(docs.limit(0)).collect() == []


def test_counts_beyond_long_products(spark):
    """Shares of counts over 2^63 / 10^9 stay exact."""
    big, size = 10**13 + 7, 3 * 10**13 + 1
    (row,) = spark.createDataFrame([(big, size, 5)], "n long, size long, terms long").select(op._share(F.col("n"), F.col("size"), F.col("terms"))).collect()
    assert row[0] == 1 + 10**9 * (big + 1) // (size + 5)


def test_terms_are_counted_before_they_are_rows(spark):
    """No row an occurrence: blocks of texts are counted, a text over a block alone, and equal terms of two documents stay apart as documents."""
    rows = [("xx", "s", "Äb b " * (op.BLOCK // 5)), ("xx", "s", "b" * 9), ("", "t", "B1b_É,b"), ("xx", "s", "b\x00C"), ("xx", "t", "c"), ("", "t", " 1 "), ("xx", "s", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    counts = op._counts(docs)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    n, held = Counter(), Counter()
    for lang, source, text in rows:
        words = TERM.findall(text.translate(LOWER))
        n.update((lang, source, w) for w in words)
        held.update((lang, source, w) for w in {*words})
    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in counts.collect()} == {k: (v, held[k]) for k, v in n.items()}
    assert n["xx", "s", "Äb"] == op.BLOCK // 5
