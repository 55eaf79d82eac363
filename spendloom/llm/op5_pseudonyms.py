"""Format-preserving pseudonyms for personal data.

Candidates are found by pattern and validated (Luhn, mod 97, calendar, octets, ...). A value
becomes its rank among all values of its format; a keyed Feistel network permutes the ranks
and the permuted rank is written in the same format. Equal values stay equal across
documents, different ones stay different, and who holds the key can invert it. Needs no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spendloom.llm import tables
from spendloom.llm.textblock import blocks, per_doc_sum, tidy

KEY_SETTING = "spendloom.pii.key"
#: Used where the session sets no key; anyone can invert these pseudonyms.
PUBLIC_KEY = "not-a-secret"
ROUNDS = 10
#: Characters that are permuted together: 62^64 are 381 bits, each half of them far below a round's 512.
CHUNK = 64
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()

#: Lengths of the formats that are looked for.
PATTERNS = {
    "secret": re.compile(
        r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b\s*[:=]\s*[\"']?)([A-Za-z0-9_\-+/]{12,})"
        r"|\bAKIA([A-Z0-9]{16})\b|\b(?:gh[pousr]_|sk-|xox[abp]-)([A-Za-z0-9_\-]{16,})"
    ),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"),
    "card": re.compile(r"(?<![\w.\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?![\w\-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}([.\-])\d{3}\1\d{4})(?![\w\-])"),
    "ssn": re.compile(r"(?<![\w\-.])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"),
    "date": re.compile(r"(?<![\w\-/.])(?:\d{4}([\-/.])\d{2}\1\d{2}|\d{2}([\-/.])\d{2}\2\d{4})(?![\w\-/]|\.\d)"),
}
#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_LOCAL, _DOMAIN = re.compile(r"[\w.%+\-]*\w$"), re.compile(r"(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w\-])")
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = "0123456789abcdef"
_LOWER = str.maketrans(_ALPHABETS[2], _ALPHABETS[1])
_OF = {c: a for a in _ALPHABETS for c in a}


class Feistel:
    """A keyed permutation of 0..n-1 for any n, different for every tweak."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _round(self, tweak: str, i: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{value}".encode(), key=self.key, digest_size=64).digest())

    def _once(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left)) % b
            else:
                left = (left + sign * self._round(tweak, i, right)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """Walks the cycle of a slightly larger domain until it is back inside."""
        a = math.isqrt(n - 1) + 1 if n > 1 else 1
        b = -(-n // a)
        while True:
            x = self._once(x, a, b, tweak, back)
            if x < n:
                return x


def _ranked(feistel: Feistel, text: list[str], places: list[tuple[int, str]], tweak: str, back: bool) -> None:
    """Permute the characters at some places of text, all together, in place."""
    rank, n = 0, 1
    for i, letters in places:
        rank, n = rank * len(letters) + letters.index(text[i]), n * len(letters)
    rank = feistel.permute(rank, n, tweak, back)
    for i, letters in reversed(places):
        rank, j = divmod(rank, len(letters))
        text[i] = letters[j]


def by_alphabet(feistel: Feistel, text: str, tweak: str, back: bool, alphabet: str = "", keep: int = 0) -> str:
    """Permute characters within their alphabets, all positions together; others stay.

    A round of the network draws 512 bits, so more than CHUNK characters are permuted in chunks.
    One pass goes over them from the front and one from the back, each chunk's permutation
    depending on all chunks that its pass has changed before: any character changes all.
    """
    places = [(i, alphabet if c in alphabet else _OF[c]) for i, c in enumerate(text) if i >= keep and (c in alphabet or c in _OF)]
    if not places:
        return text
    out, tweak = [*text], f"{tweak}:{''.join('.' if c not in _OF else _OF[c][0] for c in text) if not alphabet else len(text)}"
    if len(places) <= CHUNK:
        _ranked(feistel, out, places, tweak, back)
        return "".join(out)
    chunks = [places[i : i + CHUNK] for i in range(0, len(places), CHUNK)]
    base = hashlib.blake2b(tweak.encode(), key=feistel.key, digest_size=32)
    passes = [("front", chunks), ("back", chunks[::-1])]
    for name, order in reversed(passes) if back else passes:
        # Tweaks come from the changed chunks, which are the given ones when a pass is undone.
        seen, tweaks = base.copy(), []
        seen.update(name.encode())
        given = ["".join(out[i] for i, _ in chunk) for chunk in order] if back else None
        for k, chunk in enumerate(order):
            tweaks.append(seen.hexdigest())
            if not back:
                _ranked(feistel, out, chunk, tweaks[-1], False)
            seen.update(given[k].encode() if back else "".join(out[i] for i, _ in chunk).encode())
        if back:
            for chunk, its in zip(order, tweaks, strict=True):
                _ranked(feistel, out, chunk, its, True)
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c in _ALPHABETS[0] else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(f: Feistel, value: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    payload = f"{f.permute(int(digits[:-1]), 10**n, f'card{n}', back):0{n}d}"
    return refill(value, payload + luhn_digit(payload))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(f: Feistel, value: str, back: bool) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = by_alphabet(f, plain[4:], f"iban{plain[:2]}", back)
    done = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
    return "".join(" " if c == " " else next(done) for c in value)


def _phone(f: Feistel, value: str, back: bool) -> str | None:
    """The country code stays; the other digits change alike however they are grouped."""
    digits = re.sub(r"\D", "", value)
    code = 0
    if value[0] == "+":
        code = 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
    n = len(digits) - code
    return refill(value, digits[:code] + f"{f.permute(int(digits[code:]), 10**n, f'phone{n}', back):0{n}d}")


def _ssn(f: Feistel, value: str, back: bool) -> str | None:
    valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    digits = value.replace("-", "")
    if not valid(digits):
        return None
    while True:
        digits = f"{f.permute(int(digits), 10**9, 'ssn', back):09d}"
        if valid(digits):
            return refill(value, digits)


def _ip(f: Feistel, value: str, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts))), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4)))


def _date(f: Feistel, value: str, back: bool) -> str | None:
    sep = next(c for c in value if c in "-/.")
    a, b, c = map(int, value.split(sep))

    def at(y: int, m: int, d: int) -> int | None:
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        return day - FIRST if FIRST <= day < LAST else None

    order = "ymd" if value[4] == sep else "dmy" if at(c, b, a) is not None else "mdy"
    day = {"ymd": at(a, b, c), "dmy": at(c, b, a), "mdy": at(c, a, b)}[order]
    # Days over 12 go to such days and others to others, so every order reads back as it was
    # written and one permutation serves all orders.
    late = day is not None and datetime.date.fromordinal(FIRST + day).day > 12
    while day is not None:
        day = f.permute(day, LAST - FIRST, "date", back)
        d = datetime.date.fromordinal(FIRST + day)
        if (d.day > 12) == late:
            return sep.join({"ymd": (f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}"), "dmy": (f"{d.day:02d}", f"{d.month:02d}", f"{d.year:04d}"), "mdy": (f"{d.month:02d}", f"{d.day:02d}", f"{d.year:04d}")}[order])
    return None


def _secret(f: Feistel, value: str, back: bool) -> str | None:
    # Values go to values of their own kind, so what a pseudonym is read as tells how to undo it.
    kind = lambda v: (any(map(str.isdigit, v)), re.fullmatch("[0-9a-f]+", v) is not None)
    mine = kind(value)
    while mine[0]:
        value = by_alphabet(f, value, "secret", back, _HEX if mine[1] else "")
        if kind(value) == mine:
            return value
    return None


def _email(f: Feistel, value: str, back: bool) -> str | None:
    """Letters change alike in either case, and keep their case."""
    head, _, top = value.rpartition(".")
    new = by_alphabet(f, head.translate(_LOWER), "email", back)
    return "".join(n.upper() if o in _ALPHABETS[2] else n for n, o in zip(new, head, strict=True)) + "." + top


_CHANGE: dict[str, Callable[[Feistel, str, bool], str | None]] = {"email": _email, "phone": _phone, "card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "date": _date, "secret": _secret}


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if local and domain:
            yield at - len(local[0]), domain.end(), "email"
        at = text.find("@", at + 1)
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            group = next((g for g in (1, 2, 3) if kind == "secret" and m[g]), 0)
            yield *m.span(group), kind


def replace(feistel: Feistel, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms for valid values, and how many of each kind.

    Of overlapping values the one that begins first counts, then the longer one.
    """
    out, end, found = [], 0, dict.fromkeys(KINDS, 0)
    for lo, hi, kind in sorted(candidates(text), key=lambda x: (x[0], -x[1])):
        if lo < end or (new := _CHANGE[kind](feistel, text[lo:hi], back)) is None:
            continue
        out += text[end:lo], new
        end = hi
        found[kind] += 1
    return "".join(out) + text[end:], found


_MARKS = np.zeros(256, bool)
_MARKS[[ord("@"), *range(0x30, 0x3A)]] = True


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", counts: bool = False, back: bool = False) -> DataFrame:
    """docs with pseudonyms in the text; with counts also columns n_email, n_phone, ... (long).

    Equal phone numbers, dates and e-mail addresses get equal pseudonyms in all their formats.
    Texts of any length are read whole; of values that overlap the first counts, then the
    longer. Null and empty texts stay as they are. All other columns and repeated rows are kept; a
    column of docs named like a count is replaced by it. An empty table stays empty.
    """
    names = [f"n_{k}" for k in KINDS] if counts else []
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    place = docs.columns.index(text_column)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            column, new, found = batch.column(place), [], {k: np.zeros(batch.num_rows, np.int64) for k in KINDS}
            marked = [per_doc_sum(_MARKS[b.data], b.bounds) > 0 for b in blocks(column)]
            hits = np.flatnonzero(np.concatenate(marked)) if marked else []
            done = -1
            for i in hits:
                text, n = replace(feistel, column[int(i)].as_py(), back)
                if any(n.values()):
                    new += [column.slice(done + 1, int(i) - done - 1), pa.array([text], column.type)]
                    done = int(i)
                    for k in KINDS:
                        found[k][i] = n[k]
            column = pa.chunked_array([*new, column.slice(done + 1)], column.type).combine_chunks()
            columns = [column if i == place else c for i, c in enumerate(batch.columns)] + [pa.array(found[n[2:]]) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def session_key(spark: SparkSession) -> str:
    """The session's key; without one a public constant, of which a warning tells."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: anyone can invert these pseudonyms", stacklevel=2)
    return key or PUBLIC_KEY


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark), counts=True)
