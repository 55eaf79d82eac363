"""Pseudonyms that stay linked over formats, and parts of models against plain enumeration."""

import itertools
import random

import brute
import numpy as np
import pytest

from spendloom.llm import op2_repetition, op3_language, op4_licenses, op5_pseudonyms


def test_equal_values_stay_linked_in_all_formats():
    f = op5_pseudonyms.Feistel("k")
    change = lambda text: op5_pseudonyms.replace(f, text)[0]
    digits = lambda text: "".join(c for c in text if c.isdigit())
    phones = [change(x) for x in ("+1 555 123 4567", "(555) 123-4567", "555-123-4567", "555.123.4567", "+1-555-123-4567")]
    assert len({digits(p)[-10:] for p in phones}) == 1 and digits(phones[0])[-10:] != "5551234567" and phones[0].startswith("+1 ")
    a, b, c = (change(x) for x in ("1999-12-31", "31/12/1999", "12/31/1999"))
    assert a.split("-") == b.split("/")[::-1] == [c.split("/")[i] for i in (2, 0, 1)] and a != "1999-12-31"
    a, b = change("1999-02-03"), change("03.02.1999")
    assert a.split("-") == b.split(".")[::-1]
    low, up = change("ann.b@example.org"), change("ANN.B@Example.org")
    assert low == up.lower() and low != "ann.b@example.org" and up[:3].isupper()
    for text in (*phones, a, b, low, up):
        assert change(op5_pseudonyms.replace(f, text, back=True)[0]) == text


def test_dates_are_permuted():
    f = op5_pseudonyms.Feistel("other")
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1950, 2001) for m in range(1, 13) for d in range(1, 29)]
    image = [op5_pseudonyms.replace(f, x)[0] for x in days]
    assert len({*image}) == len(days) and [op5_pseudonyms.replace(f, x, back=True)[0] for x in image] == days


@pytest.mark.parametrize("labels", [2, 3])
def test_marginals_are_those_of_all_label_paths(labels):
    rng = np.random.default_rng(labels)
    counts = [0, 1, 3, 6, 5]
    first = np.r_[0, np.cumsum(counts)]
    scores, transitions = rng.normal(size=(first[-1], labels)) * 2, rng.normal(size=(labels, labels))
    found = op3_language.marginals(scores, first, transitions)
    for lo, hi in zip(first[:-1], first[1:]):
        want = np.zeros((hi - lo, labels))
        # Every path begins in any label, as likely as its transitions into the first word's.
        for path in itertools.product(range(labels), repeat=int(hi - lo)):
            begin = np.log(np.exp(transitions[:, path[0]]).sum()) if path else 0
            weight = np.exp(begin + sum(scores[lo + i, k] for i, k in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            for i, k in enumerate(path):
                want[i, k] += weight
        assert np.allclose(found[lo:hi], want / np.maximum(want.sum(axis=1, keepdims=True), 1e-300))


def test_banded_alignment_finds_the_longest_common_subsequence():
    random.seed(3)
    for _ in range(200):
        template = [random.randint(0, 6) for _ in range(random.randint(1, 9))]
        text = [random.randint(0, 6) for _ in range(random.randint(1, 12))]
        table = np.zeros((len(template) + 1, len(text) + 1), int)
        for i, j in itertools.product(range(len(template)), range(len(text))):
            table[i + 1, j + 1] = table[i, j] + 1 if template[i] == text[j] else max(table[i, j + 1], table[i + 1, j])
        # A band as wide as both texts leaves nothing out.
        n, lo, hi = op4_licenses.align(template, text, 0, band=25)
        assert n == table[-1, -1]
        if n:
            own = np.zeros((len(template) + 1, hi - lo + 1), int)
            for i, j in itertools.product(range(len(template)), range(hi - lo)):
                own[i + 1, j + 1] = own[i, j] + 1 if template[i] == text[lo + j] else max(own[i, j + 1], own[i + 1, j])
            assert own[-1, -1] == n


def test_kept_by_brute_force(spark, sf_dir):
    random.seed(6)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(2, 8)))
    prose = [" ".join(word() for _ in range(n)) for n in (49, 50, 200, 400)]
    texts = [*prose, (prose[2] + "\n") * 4, prose[3] + " " + prose[3][:600], "\n".join(["a line that stands here again and again"] * 30 + [prose[3]]), None]
    texts += ["\n".join(random.choice(prose[3].split()[:n]) + f" {i} " + " ".join(word() for _ in range(6)) for i in range(30)) for n in (2, 5, 40)]
    texts += [r["text"] for r in brute.edge_docs(spark, sf_dir).collect()]
    found = op2_repetition.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    limits = (op2_repetition.DUPLICATED_LINES, op2_repetition.DUPLICATED_LINE_CHARS, op2_repetition.DUPLICATED_NGRAMS, op2_repetition.TOP_NGRAM)
    want = {i: not brute.repetition(t)[-1] and brute.clean_of_repeats(t, *limits) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["kept"] for r in found} == want and {*want.values()} == {True, False}
    assert any(not r["base_failed"] and not r["kept"] for r in found)
