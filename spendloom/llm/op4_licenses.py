"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are cut into words and their smallest 3-word hashes per window go into an inverted
index. A document's 3-word hashes that are in the index vote for (template, diagonal), and
around each voted place the template is aligned with the document's words within a band of
diagonals, until no vote is left outside the copies found. Matched coverage is the share of
template words that align with equal words.
Templates are a small table; the index is rebuilt in each worker. Needs no shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spendloom.llm import tables
from spendloom.llm.license_templates import TEMPLATES
from spendloom.llm.textblock import ALNUM, Block, blocks, gram_hashes, tidy

GRAM, WINDOW = 3, 2
BAND = 8
COVERAGE = 0.8
#: Shorter templates must match whole: a word less would be another licence.
SHORT = 12
#: Larger template tables are refused: their index is sent to every executor.
MAX_TEMPLATE_BYTES = 16 << 20

RESULT = "n_matches long, families array<string>, best_coverage double, matches array<struct<template: string, family: string, coverage: double, first_word: int, end_word: int, start: long, end: long>>"


class Index:
    """Word hashes of all templates and the inverted index of their fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.names, self.families, self.words = [], [], []
        entries: dict[int, list[tuple[int, int]]] = {}
        for name, family, text in templates:
            block = next(blocks(pa.array([text])), None)
            words = block.words(ALNUM, lower=True).hashes() if block else np.zeros(0, np.uint64)
            if not len(words):
                continue
            k = len(self.names)
            self.names.append(name)
            self.families.append(family)
            self.words.append(words)
            grams = gram_hashes(words, min(GRAM, len(words)))
            span = min(WINDOW, len(grams))
            chosen = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(len(grams) - span + 1)
            for at in np.unique(chosen).tolist():
                entries.setdefault(int(grams[at]), []).append((k, at))
        self.entries = entries
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})
        self.sorted = np.array(sorted(entries), np.uint64)

    def hits(self, hashes: np.ndarray, size: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = gram_hashes(hashes, size)
        if not len(grams) or not len(self.sorted):
            return np.zeros(0, np.int64), grams[:0]
        at = np.minimum(np.searchsorted(self.sorted, grams), len(self.sorted) - 1)
        found = np.flatnonzero((self.sorted[at] == grams) & inside)
        return found, grams[found]


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of the whole template with a stretch of text.

    Cell (i, d) pairs template word i with text word i + diagonal + d, |d| <= band. Equal words
    count one, text and template words may be left out; ends are those of the first and last
    equal pair. Among equal scores the shorter stretch counts, then the earlier one.
    """
    none = (0, 0, 0)
    row: list[tuple[int, int, int]] = [none] * (2 * band + 1)  # (matches, first, -end)
    found, rank = none, (0, 0, 0)
    for i in range(len(template)):
        new = []
        for k in range(2 * band + 1):
            j = i + diagonal + k - band
            best = max(row[k + 1] if k < 2 * band else none, new[k - 1] if k else none)
            if 0 <= j < len(text) and text[j] == template[i]:
                n, first, _ = row[k]
                here = (n + 1, first if n else j, -j - 1)
                best = max(best, here)
                if (here[0], here[1] - j, -here[1]) > rank:
                    found, rank = here, (here[0], here[1] - j, -here[1])
            else:
                best = max(best, row[k])
            new.append(best)
        row = new
    return found[0], found[1], -found[2]


def _places(template: np.ndarray, text: np.ndarray, votes: dict[int, list[int]], coverage: float) -> Iterator[tuple[int, int, int]]:
    """(matched words, first, end) of every copy of the template in a text.

    votes: the places of the text's hits by diagonal. Diagonals are tried by their votes; the
    words of a copy are taken out with their votes, so that each further copy is found by what
    is left. A window that shares too few words with the template is not aligned.
    """
    size = len(template)
    if size < SHORT:
        # Whole and without a gap: such a copy votes for its own diagonal.
        last = 0
        for d in sorted(votes):
            if d >= last and d + size <= len(text) and np.array_equal(text[d : d + size], template):
                last = d + size
                yield size, d, last
        return
    distinct, own, need = np.unique(template, return_inverse=True, return_counts=True)
    at = np.minimum(np.searchsorted(distinct, text), len(distinct) - 1)
    words = np.where(distinct[at] == text, at, -1)
    taken = np.zeros(len(text), bool)
    own, least = own.tolist(), coverage * size
    queue = [(-len(x), d) for d, x in votes.items()]
    heapq.heapify(queue)
    while queue:
        count, d = heapq.heappop(queue)
        left = sum(not taken[x] for x in votes[d])
        if left < -count:
            if left:
                heapq.heappush(queue, (-left, d))
            continue
        a, b = max(0, d - BAND), min(len(text), d + size + BAND)
        window = words[a:b]
        if np.minimum(np.bincount(window[window >= 0], minlength=len(need)), need).sum() < least:
            continue
        n, first, end = align(own, window.tolist(), d - a)
        if n and n >= least and (end - first) * least <= size**2:
            first, end = first + a, end + a
            words[first:end], taken[first:end] = -1, True
            heapq.heappush(queue, (count, d))  # the diagonal may hold votes outside the copy
            yield n, first, end


def scan(index: Index, block: Block, coverage: float) -> list[list[dict]]:
    words = block.words(ALNUM, lower=True)
    hashes = words.hashes()
    found: list[list[dict]] = [[] for _ in range(block.n)]
    votes: dict[tuple[int, int], dict[int, list[int]]] = {}
    for size in index.sizes:
        for at, gram in zip(*(x.tolist() for x in index.hits(hashes, size, words.inside(size))), strict=True):
            doc = int(np.searchsorted(words.first, at, "right")) - 1
            at -= int(words.first[doc])
            for k, place in index.entries[gram]:
                if min(GRAM, len(index.words[k])) == size:
                    votes.setdefault((doc, k), {}).setdefault(at - place, []).append(at)
    for (doc, k), diagonals in votes.items():
        lo, hi = int(words.first[doc]), int(words.first[doc + 1])
        base, size = int(block.bounds[doc]), len(index.words[k])
        for n, first, end in _places(index.words[k], hashes[lo:hi], diagonals, coverage):
            found[doc].append({"template": index.names[k], "family": index.families[k], "coverage": n / size, "first_word": first, "end_word": end, "start": int(words.starts[lo + first]) - base, "end": int(words.ends[lo + end - 1]) - base, "score": 2 * n - size})
    return [_best(x) for x in found]


def _best(matches: list[dict]) -> list[dict]:
    """Matches in order of place, without those that lie by more than half in better ones.

    The better match has more matched words less missing ones: of templates that differ by few
    words the nearest, and a whole text before a notice within it.
    """
    covered = np.zeros(max((m["end_word"] for m in matches), default=0), bool)
    kept: list[dict] = []
    for m in sorted(matches, key=lambda m: (-m["score"], -m["coverage"], m["end_word"] - m["first_word"], m["first_word"], m["template"])):
        place = covered[m["first_word"] : m["end_word"]]
        if 2 * np.count_nonzero(place) <= len(place):
            place[:] = True
            kept.append({k: v for k, v in m.items() if k != "score"})
    return sorted(kept, key=lambda m: (m["start"], -m["end"], m["template"]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, id_column: str = "doc_id", text_column: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per document: matches with template, family, coverage, word and byte spans; none for clean ones.

    Texts of any length are scanned whole. Null and empty texts match nothing; repeated rows are each scanned; other columns are not
    read; an empty table gives an empty result. Wordless templates match nothing. Every copy of
    a template is a match, back to back ones too. Of templates that match at one place only the
    best is reported: the one with the most matched words less missing ones.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.encode()) for _, _, t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("the templates are too large for an index in every worker; scan them in parts")
    kind = docs.schema[id_column].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            found = [m for block in blocks(batch.column(1)) for m in scan(index, block, coverage)]
            columns = [
                batch.column(0),
                pa.array([len(m) for m in found], pa.int64()),
                pa.array([sorted({x["family"] for x in m}) for m in found], pa.list_(pa.string())),
                pa.array([max((x["coverage"] for x in m), default=0.0) for m in found], pa.float64()),
                pa.array(found, pa.list_(pa.struct([("template", pa.string()), ("family", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_matches", "families", "best_coverage", "matches"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {RESULT}")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(tables.read(spark, sf_dir, "documents"))
