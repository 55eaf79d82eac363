"""Plain statements of what the operators of this subpackage return, and documents to try them on."""

import hashlib
import random
import re
from collections import Counter

import pandas as pd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Columns that operators may use inside; here they are the caller's and mean nothing.
CLASHES = ["id", "node", "n", "h", "key", "span", "version", "text_a", "part", "salt", "rank", "item", "fp", "component_id", "n_words", "n_email", "score", "kept"]


def edge_texts():
    random.seed(5)
    prose = lambda n: " ".join("".join(random.choices("abcdefghijklmnop", k=random.randint(1, 8))) for _ in range(n))
    base, long = prose(120).split(), prose(60_000)
    near = [*base]
    near[60] = "changed"
    line = "the same line of words stands here"
    return [
        None, "", " \t\n ", "one", "one two three four", "ONE two Three four", "one two three four", " ".join(base), " ".join(near), " ".join(base).upper(),
        long, long + " tail", f"{line}\n" * 40, "123 !!! ---", "žluťoučký kůň 漢字 😀 ñandú", "a b c d e", "a  b\tc\nd e", "x" * 5_000, "ab" * 3_000, "é" * 1_000,
        "<|endoftext|> in a text, don't we've 12 345 #*$%", "null\x00byte and \x1f others", "e\u0301 combining", "  lead and trail  ",
    ]


def edge_docs(spark, sf_dir):
    """The smallest documents table, texts at the edge, nulls in every column, repeated rows, clashing columns."""
    known = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text", "lang", "source"]]
    extra = pd.DataFrame({"doc_id": range(10_000, 10_000 + len(edge_texts())), "text": edge_texts(), "lang": None, "source": None})
    extra.loc[::3, "lang"] = "en"
    rows = pd.concat([known, extra, known.iloc[:3], extra.iloc[[0, 1, 8]]], ignore_index=True).astype(object).where(lambda x: x.notna(), None)
    rows["n_chars"] = pd.Series([None if t is None else len(t) for t in rows["text"]], dtype=object)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], schema).repartition(5)
    return docs.selectExpr("*", *[f"'mine' AS {c}" for c in CLASHES])


def contamination(docs, items):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    found |= ids
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def repetition(text):
    w = SPACED.findall(text or "")
    threes = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), failed)


def clean_of_repeats(text, line_share, line_char_share, later_shares, top_shares):
    """The verdict on repeated lines and n-grams, by their words: is every share within its limit?"""
    w = SPACED.findall(text or "")
    floor = max(sum(map(len, w)), 1)
    lines, seen, again, again_chars = [x for x in (text or "").split("\n") if SPACED.search(x)], set(), 0, 0
    for x in lines:
        if x in seen:
            again += 1
            again_chars += sum(map(len, SPACED.findall(x)))
        seen.add(x)
    good = again <= line_share * len(lines) and again_chars / floor <= line_char_share
    for k, limit in later_shares.items():
        known, inside = set(), set()
        for i in range(len(w) - k + 1):
            if (g := tuple(w[i : i + k])) in known:
                inside |= set(range(i, i + k))
            known.add(g)
        good &= sum(len(w[i]) for i in inside) / floor <= limit
    for k, limit in top_shares.items():
        found = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        good &= min(max((n * sum(map(len, g)) for g, n in found.items() if n > 1), default=0) / floor, 1) <= limit
    return good


def removed_bytes(texts, length):
    """Per text: the bytes covered by a string of `length` that starts twice or more."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    """doc -> (n_shingles, component_id) by comparing all pairs."""
    sets = [(doc, shingles(text)) for doc, text in docs]
    of = {doc: doc for doc, _ in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * (both := len(x & y)) >= 80 * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                of[hi] = lo
    return {doc: (len(s), find(doc)) for doc, s in sets}


def url(text, rules):
    host = path = ""
    if text and "://" in text:
        rest = text.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]
