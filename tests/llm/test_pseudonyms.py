"""Pseudonyms of values of any length, permutations of small domains, and one link per value."""

import itertools
import random
import re
import string
import warnings

import pytest

from spendloom.llm import op5_pseudonyms as op

FEISTEL = op.Feistel("key of the tests")


def changed(text):
    new, found = op.replace(FEISTEL, text)
    assert op.replace(FEISTEL, new, back=True) == (text, found)
    return new


@pytest.mark.parametrize("length", [12, 16, 64, 65, 128, 256, 300, 600, 1_000, 2_000, 6_620, 12_000, 100_000])
@pytest.mark.parametrize("letters", [string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_lowercase + string.digits])
def test_secrets_of_any_length(length, letters):
    random.seed(length)
    value = "7" + "".join(random.choices(letters, k=length - 1))
    head = "token="
    new = changed(head + value)[len(head) :]
    assert len(new) == length and new != value
    assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or set(letters) == set("0123456789abcdef")
    # About one of ten to 26 characters stays by chance; no stretch of many does.
    same = "".join("=" if a == b else "." for a, b in zip(value, new, strict=True))
    assert max(map(len, re.findall("=+", same)), default=0) <= 8
    # One changed character changes the front as well as the back.
    other = value[:-1] + ("1" if value[-1] != "1" else "2")
    far = changed(head + other)[len(head) :]
    if value[-1].isdigit() and length >= 64:
        assert far[:12] != new[:12] and far[-24:] != new[-24:]


def test_five_million_characters():
    value = ("a1B2" * 1_250_000)
    new, found = op.replace(FEISTEL, f"token={value} end")
    assert found["secret"] == 1 and len(new) == len(value) + 10
    assert not new.startswith("token=a1B2a1B2") and "a1B2a1B2a1B2" not in new
    assert new.endswith(" end")


def test_one_link_per_phone():
    forms = ["+49 30 1234567", "+49301234567", "+49-30-1234567", "+49 (30) 123 4567"]
    news = [changed(f"call {f} now") for f in forms]
    assert len({re.sub(r"\D", "", n) for n in news}) == 1 and news[0].startswith("call +49 ")
    assert changed("+1 555 123 4567")[-12:].replace(" ", "-") == changed("555-123-4567")
    assert changed("+420 601 234 567").startswith("+420 ")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1_000, 4_097])
def test_permutations(n):
    assert sorted(FEISTEL.permute(x, n, "t") for x in range(n)) == list(range(n))


def test_small_values_are_permuted_whole():
    """Every value of a format goes to one of the format, and no two to the same."""
    for kind, values in {
        "ip": [f"10.0.{a}.{b}" for a in range(16) for b in range(256)],
        "date": [f"20{y:02d}-{m:02d}-{d:02d}" for y in range(100) for m in range(1, 13) for d in range(1, 29)],
        "secret": ["".join(p) for p in itertools.product("0123456789ab", repeat=3)],
        "phone": [f"+49 30 000{i:04d}" for i in range(10_000)],
        "ssn": [f"123-45-{i:04d}" for i in range(1, 10_000)],
    }.items():
        news = [op._CHANGE[kind](FEISTEL, v, False) for v in values]
        made = [(v, n) for v, n in zip(values, news, strict=True) if n is not None]
        assert len({n for _, n in made}) == len(made) > 0
        assert all(op._CHANGE[kind](FEISTEL, n, True) == v for v, n in made)
        assert all(re.sub("[0-9a-f]", "0", n) == re.sub("[0-9a-f]", "0", v) for v, n in made) or kind == "ip"


def test_a_missing_key_is_told(spark):
    with pytest.warns(UserWarning, match="invert"):
        assert op.session_key(spark) == op.PUBLIC_KEY
    spark.conf.set(op.KEY_SETTING, "mine")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert op.session_key(spark) == "mine"
    spark.conf.unset(op.KEY_SETTING)


def test_long_values_in_a_table(spark):
    random.seed(1)
    long = "".join(random.choices(string.ascii_letters + string.digits, k=300_000))
    rows = [(1, f"api_key: {long}"), (2, f"first password={long} last"), (3, f"{'a' * 3_000}1@{'b.' * 8}example.com"), (4, "9" * 20_000), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    new = {r.doc_id: r.text for r in op.pseudonymise(docs, "k").collect()}
    assert new[1] != rows[0][1] and new[1][9:] == new[2][15:-5] and new[5] is None
    back = op.pseudonymise(spark.createDataFrame(list(new.items()), "doc_id long, text string"), "k", back=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
