"""Each operator against brute force, a round trip or held-out accuracy, on edge cases and real rows."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendloom.llm import (
    op1_decontamination,
    op2_repetition,
    op3_language,
    op4_licenses,
    op5_pseudonyms,
    op6_token_counts,
    op7_suffix_dedup,
    op8_jaccard_join,
    op9_urls,
    op10_packing,
    registry,
    tables,
)
from spendloom.llm.deep_shallow import suffix_order


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    tables.ship(spark)
    return brute.edge_docs(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_decontamination(spark, sf_dir, docs, rows):
    items = [(r["item_id"], r["text"]) for r in tables.read(spark, sf_dir, "benchmark").collect()]
    items += [(900, "one two three"), (901, None), (902, "..."), (903, "žluťoučký kůň"), (904, rows[3][1]), (905, rows[3][1])]
    table = spark.createDataFrame([(i, t, "mine") for i, t in items], "item_id long, text string, span string")
    found = op1_decontamination.contamination(docs, table).collect()
    want = brute.contamination(rows, items)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found) == sorted((doc, *want[doc]) for doc, _ in rows)
    assert any(r["contaminated"] for r in found)
    # Rows without an id, or of one id with different texts, are judged each by its own.
    texts = [rows[3][1], rows[3][1], "clean words of a text", None, items[0][1]]
    loose = spark.createDataFrame([*zip((None, None, None, 7, 7), texts, strict=True)], "doc_id long, text string")
    got = op1_decontamination.contamination(loose, table).collect()
    alone = brute.contamination([*enumerate(texts)], items)
    assert sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(alone.values())
    assert op1_decontamination.contamination(docs.limit(0), table).count() == 0
    assert op1_decontamination.contamination(docs, table.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_repetition(docs, rows):
    found = op2_repetition.score(docs).collect()
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
    assert got == sorted((doc, *brute.repetition(text)) for doc, text in rows)
    assert not any(r["kept"] and r["base_failed"] for r in found) and any(r["kept"] for r in found)
    assert op2_repetition.score(docs.limit(0)).count() == 0


def test_language(spark, sf_dir, docs):
    model = op3_language.fit_on_kept(docs)
    found = op3_language.predict(docs, model, keep=["text", "lang"]).withColumn("held", op3_language.held_out()).toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    held = found[found.held & found.lang.notna() & (found.doc_id < 10_000)]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    without = found.text.map(lambda t: t is None or not any(c.isalpha() for c in t))
    assert (without == (found.lang_pred == "und")).all()
    # A splice of two languages is labelled word by word.
    by = {k: " ".join(found[(found.lang == k) & (found.doc_id < 10_000)].text.iloc[:3]).split()[:150] for k in ("en", "fr")}
    mixed = spark.createDataFrame([(1, " ".join(by["en"] + by["fr"]))], "doc_id long, text string")
    spliced = op3_language.predict(mixed, model).first()
    assert spliced["switches"] >= 1 and 0.3 < spliced["score"] < 0.7
    empty = op3_language.fit_on_kept(docs.limit(0))
    assert op3_language.predict(docs, empty).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_licenses(spark, docs):
    templates = [("long", "L", " ".join(f"word{i}" for i in range(60))), ("short", "S", "licensed under the small licence")]
    words = [f"word{i}" for i in range(60)]
    edited = words[:20] + ["added", "twice"] + words[20:40] + words[42:]
    texts = [None, "", "clean text of other words", "before " + " ".join(words) + " after", " ".join(edited), " ".join(words[:30]), "LICENSED, under the small licence!", "licensed under the big licence"]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    found = {r["doc_id"]: r for r in op4_licenses.scan_licenses(table, templates).collect()}
    assert [found[i]["families"] for i in range(8)] == [[], [], [], ["L"], ["L"], [], ["S"], []]
    hit = found[3]["matches"][0]
    assert hit["coverage"] == 1.0 and texts[3][hit["start"] : hit["end"]] == " ".join(words)
    assert found[4]["best_coverage"] == pytest.approx(58 / 60)
    assert op4_licenses.scan_licenses(docs.limit(0)).count() == 0 and op4_licenses.scan_licenses(docs).count() == docs.count()


def test_pseudonyms_round_trip(spark, docs):
    card = "453201511283036"
    card += op5_pseudonyms.luhn_digit(card)
    text = f"Mail ann.b@example.org or ann.b@example.org, call +1 555 123 4567, card {card}, IBAN GB82WEST12345698765432, ssn 123-45-6789, host 10.1.2.3, born 1987-03-12 or 31/12/1999, token=abc123def456gh"
    clean = "Version 1.2.3 of 2024, 400 pages, 999-99-9999 and 1234567812345678 are no personal data."
    table = spark.createDataFrame([(1, text, "x"), (2, text + " again", "y"), (3, clean, "z"), (4, None, None), (5, "", "")], "doc_id long, text string, n_email string")
    there = op5_pseudonyms.pseudonymise(table, "k", counts=True)
    out = {r["doc_id"]: r for r in there.collect()}
    assert out[1]["text"] != text and len(out[1]["text"]) - len(text) in range(-8, 9) and out[3]["text"] == clean
    assert out[2]["text"] == out[1]["text"] + " again" and out[4]["text"] is None and out[5]["text"] == ""
    assert out[1]["n_email"] == 2 and all(out[1][f"n_{k}"] for k in op5_pseudonyms.KINDS)
    for secret in ("ann.b", card, "WEST12345698765432", "123-45-6789", "10.1.2.3", "1987-03-12", "31/12/1999", "abc123def456gh"):
        assert secret not in out[1]["text"]
    assert op5_pseudonyms.pseudonymise(table, "other").where("doc_id = 1").first()["text"] != out[1]["text"]
    whole = op5_pseudonyms.pseudonymise(docs, "k")
    back = op5_pseudonyms.pseudonymise(whole, "k", back=True)
    assert whole.columns == docs.columns and back.exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert whole.select("text").exceptAll(docs.select("text")).count() > 0
    assert op5_pseudonyms.pseudonymise(docs.limit(0), "k", counts=True).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_permutes(n):
    f = op5_pseudonyms.Feistel("key")
    image = [f.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == [*range(n)] and [f.permute(y, n, "t", back=True) for y in image] == [*range(n)]


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((doc, len((text or "").encode()), n := len(library.encode(text or "", add_special_tokens=False).ids), n > 1024) for doc, text in rows)
    assert sorted(map(tuple, op6_token_counts.count_tokens(docs, path).collect())) == want
    assert op6_token_counts.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("group", [2, 2_000])
def test_suffix_dedup(spark, group):
    random.seed(group)
    word = lambda: "".join(random.choices("ab", k=random.randint(1, 6)))
    shared = [" ".join(word() for _ in range(random.randint(20, 90))) for _ in range(4)]
    texts = [None, "", "short", "é" * 300, "ab" * 300]
    for _ in range(40):
        parts = [random.choice(shared) if random.random() < 0.5 else " ".join(word() for _ in range(30)) for _ in range(4)]
        texts.append("".join(parts)[random.randint(0, 40) :])
    texts += texts[5:8]
    table = spark.createDataFrame([(None if i == 7 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = op7_suffix_dedup.deduplicate(table, length=100, group=group).collect()
    got = sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in found)
    want = sorted((-1 if i == 7 else i, *w) for i, w in enumerate(brute.removed_bytes(texts, 100)))
    assert got == want and any(w[2] for w in want)
    assert op7_suffix_dedup.deduplicate(table.limit(0)).count() == 0


def test_suffix_dedup_of_whole_documents(docs, rows):
    small = [(i, t) for i, t in rows if len(t or "") < 40_000]
    found = op7_suffix_dedup.deduplicate(docs.where("length(coalesce(text, '')) < 40000")).collect()
    want = brute.removed_bytes([t for _, t in small], 400)
    assert sorted(tuple(r[:5]) for r in found) == sorted((i, *w) for (i, _), w in zip(small, want, strict=True))


def test_suffix_order():
    random.seed(3)
    texts = [bytes(random.choices(b"ab\0", k=random.randint(0, 300))) for _ in range(200)] + [b"ab" * n for n in range(90)] * 2
    assert [texts[i] for i in suffix_order(texts)] == sorted(texts)


def test_jaccard_join(spark, docs, rows):
    random.seed(9)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(100)]
    chain = []
    for i in range(30):  # each is similar to the next one, the ends are not similar at all
        base = base[2:] + [f"new{i}", f"newer{i}"]
        chain.append((20_000 + i, " ".join(base)))
    many = [(21_000 + i, " ".join(f"s{j}" for j in range(60)) + f" end{i} of it") for i in range(150)]
    extra = spark.createDataFrame(chain + many, "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra).selectExpr("*", "'mine' AS node")
    found = op8_jaccard_join.join(table).collect()
    want = brute.jaccard(list(dict(rows).items()) + chain + many)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert len(found) == len(rows) + len(chain) + len(many)
    assert op8_jaccard_join.join(docs.limit(0)).count() == 0
    orphan = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert {tuple(r) for r in op8_jaccard_join.join(orphan).collect()} == {(None, 2, 5), (5, 2, 5), (None, 0, None)}
    # A text without an id links two that are not similar to each other; so does one of two texts of a repeated id.
    steps = [" ".join(f"x{j}" for j in range(i, 60 + i)) for i in (0, 5, 10, 15, 20)]
    bridge = spark.createDataFrame([*zip((1, None, 2, 2, 3), steps, strict=True)], "doc_id long, text string")
    assert {r["component_id"] for r in op8_jaccard_join.join(bridge).collect()} == {1}


def test_urls(spark, sf_dir):
    urls = [None, "", "example.net/en/", "http://", "HTTP://Example.NET/en/a?b#c", "http://a.b.example.net/EN/", "x://net", "x://net/", "x://.net/", "x://net./", "x://inet/", "x://example.com/de/", "x://example.com/de", "a://b://net/", "x://org?/fr/", "x://a.org/fr/x", "x://y\n.net/\n/", "s://ÄÖ.net/", "s://example.net/aaa", "s://x.org/bbbb/c"] * 2
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string").unionByName(tables.read(spark, sf_dir, "pages").selectExpr("page_id + 1000 AS page_id", "url", "html AS key"))
    nested = [*op9_urls.RULES, ("a.b.example.net", "/EN/", "block"), ("b.example.net", "/", "allow")]
    many = [*nested, *((h, f"/{'abc'[i % 3] * (i // 3)}", ("allow", "block")[i % 2]) for i in range(3, 60) for h in ("example.net", "org"))]
    for rules in (op9_urls.RULES, nested, many, []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        found = op9_urls.judge(pages.repartition(7), table).collect()
        want = sorted((r["page_id"], *brute.url(r["url"], rules)) for r in pages.collect())
        assert sorted(map(tuple, found)) == want
    assert op9_urls.judge(pages.limit(0), table).count() == 0


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = op10_packing.pack(docs, path).toPandas()
    want = []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, k, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(found[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, one in found.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert (one["offset"] == one["length"].cumsum() - one["length"]).all() and one["length"].sum() <= 2048
    least = -(-found["length"].sum() // 2048)
    assert found["sequence_id"].nunique() <= least * 1.02 + 1
    assert op10_packing.pack(docs.limit(0), path).count() == 0


def test_plan_packs_everything():
    random.seed(1)
    for size in (8, 50, 2048):
        counts = np.array([0, *(random.choice([0, 0, 1, 5, 1000]) for _ in range(size))])
        used = defaultdict(int)
        for times, lengths in op10_packing.plan(counts):
            assert sum(lengths) <= size
            for n in lengths:
                used[n] += times
        assert used == {n: c for n, c in enumerate(counts.tolist()) if c}


def test_queries_return_the_contract(spark, sf_dir):
    want = {
        "op1_": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op2_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op3_": {"doc_id", "held_out", "lang_pred", "score"},
        "op6_": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op7_": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op8_": {"doc_id", "n_shingles", "component_id"},
        "op9_": {"page_id", "host", "path", "rule", "verdict"},
        "op10_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    }
    found = {name: query(spark, sf_dir).columns for name, query in registry.queries().items() if name.startswith(tuple(want))}
    for start, columns in want.items():
        assert columns <= set(next(v for k, v in found.items() if k.startswith(start)))
    assert pd.Series(registry.queries()).index.is_unique
