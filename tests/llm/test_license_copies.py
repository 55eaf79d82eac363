"""Licence notices that stand back to back, and licences that differ by a few words."""

import pyarrow as pa
import pytest

from spendloom.llm import op4_licenses
from spendloom.llm.license_templates import TEMPLATES
from spendloom.llm.textblock import blocks

INDEX = op4_licenses.Index(TEMPLATES)


def scan(text):
    return op4_licenses.scan(INDEX, next(blocks(pa.array([text]))), op4_licenses.COVERAGE)[0]


@pytest.mark.parametrize("name,family,text", TEMPLATES, ids=[t[0] for t in TEMPLATES])
def test_copies_back_to_back(name, family, text):
    found = scan(" ".join([text] * 5))
    starts = [i * (len(text) + 1) for i in range(5)]
    assert [(m["template"], m["coverage"], m["start"], m["end"]) for m in found] == [(name, 1.0, s, s + len(text.rstrip("./"))) for s in starts]
    assert {m["family"] for m in found} == {family}


@pytest.mark.parametrize("name,family,text", [t for t in TEMPLATES if len(t[2].split()) > 30], ids=lambda x: x[:20])
def test_edited_copies_beside_whole_ones(name, family, text):
    words = text.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 20 != 19)
    found = scan(f"ahead {edited} {text} {edited} between the two {text} after")
    assert [m["family"] for m in found] == [family] * 4
    assert [m["coverage"] == 1.0 for m in found] == [False, True, False, True]


def test_many_short_notices():
    assert len(scan("All rights reserved. " * 3_000)) == 3_000
