"""Quality rules from repetition: how much of a text stands in repeated n-grams and lines.

Word n-grams of several lengths are hashed with rolling hashes in numpy, and the
characters inside n-grams or lines that occur before in the same text are measured.
Needs no shuffle: every document is judged alone, in blocks inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spendloom.llm import tables
from spendloom.llm.textblock import SPACED, Block, Words, blocks, gram_hashes, mix, per_doc_sum, span_hashes, tidy

#: Highest share of a text's word characters in duplicated n-grams, by n.
DUPLICATED_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Highest share of a text's word characters in the most frequent n-gram, by n.
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}
#: Highest share of lines, and of characters, in duplicated lines.
DUPLICATED_LINES, DUPLICATED_LINE_CHARS = 0.30, 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LINES = np.ones(256, bool)
LINES[0x0A] = False

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_char_frac double, dup_ngram_frac double, top_ngram_frac double, base_failed boolean, kept boolean"
)


def _repeats(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is there an earlier equal one in the document, is there any other, group number) of each."""
    n = len(hashes)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
    key = mix(hashes + docs.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, other, group = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
    later[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    group[order] = np.r_[0, np.cumsum(~same)]
    return later, other, group


def _covered(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words stand in a flagged gram of k words."""
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps)[:-1] > 0


def measure(block: Block) -> dict[str, np.ndarray]:
    words: Words = block.words(SPACED)
    n, docs, hashes = words.counts(), words.docs(), words.hashes()
    lead = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[words.ends] - lead[words.starts]
    word_chars = per_doc_sum(chars, words.first)
    floor = np.maximum(word_chars, 1)

    lines = block.words(LINES)
    has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    # A word never spans a line, so a line has one if one starts in it.
    line_later, _, _ = _repeats(np.where(has_word, lines.hashes(), np.arange(len(has_word), dtype=np.uint64)), lines.docs())
    line_later &= has_word
    in_words = np.r_[0, np.cumsum(chars)]
    line_chars = in_words[np.searchsorted(words.starts, lines.ends)] - in_words[np.searchsorted(words.starts, lines.starts)]
    n_lines, n_dup_lines = per_doc_sum(has_word, lines.first), per_doc_sum(line_later, lines.first)
    dup_line_chars = per_doc_sum(np.where(line_later, line_chars, 0), lines.first)

    def grams(k: int):
        inside = np.flatnonzero(words.inside(k))
        return inside, *_repeats(gram_hashes(hashes, k)[inside], docs[inside])

    total = len(hashes)
    at, _, other, _ = grams(3)
    flags = np.zeros(total, bool)
    flags[at[other]] = True
    n_repeat = per_doc_sum(_covered(flags, 3, total), words.first)

    bad = (n_dup_lines > DUPLICATED_LINES * n_lines) | (dup_line_chars > DUPLICATED_LINE_CHARS * floor)
    dup_frac = np.zeros(block.n)
    for k, limit in DUPLICATED_NGRAMS.items():
        at, later, _, _ = grams(k)
        flags = np.zeros(total, bool)
        flags[at[later]] = True
        share = per_doc_sum(np.where(_covered(flags, k, total), chars, 0), words.first) / floor
        bad |= share > limit
        dup_frac = np.maximum(dup_frac, share)
    top_frac = np.zeros(block.n)
    starts = np.r_[0, np.cumsum(chars)]
    for k, limit in TOP_NGRAM.items():
        at, _, other, group = grams(k)
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        value = np.where(other, size[group] * (starts[at + k] - starts[at]), 0)
        most = np.zeros(block.n, np.int64)
        np.maximum.at(most, docs[at], value)
        share = np.minimum(most / floor, 1.0)
        bad |= share > limit
        top_frac = np.maximum(top_frac, share)

    failed = (n < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": per_doc_sum(SYMBOLS[block.data], block.bounds),
        "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "dup_line_char_frac": dup_line_chars / floor,
        "dup_ngram_frac": dup_frac, "top_ngram_frac": top_frac, "base_failed": failed, "kept": ~failed & ~bad,
    }


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: repetition measures and the verdict `kept`.

    A null text has no words and fails the base rules, as an empty one does; repeated rows are
    each judged alone; other columns are not read. An empty table gives an empty result.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids = batch.column(0).slice(block.lo, block.n)
                out = {k: pa.array(v) for k, v in measure(block).items()}
                yield pa.RecordBatch.from_arrays([ids, *out.values()], [id_column, *out])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {COLUMNS}")


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(tables.read(spark, sf_dir, "documents"))
