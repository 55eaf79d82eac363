"""Pre-token memories over public byte-pair vocabularies, equal to the `tokenizers` library.

A pre-token's ids depend on nothing around it, so each distinct one is merged once per
worker, as long as a bounded memory keeps it. Vocabulary strings proven to encode alone as
one token need no merge at all. Characters from U+0300 on, whose classes differ between
Unicode versions, count as what the library's own pre-tokenizer takes each of them for. Only
texts that hold a special string go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, PreTokenizer

from spendloom.llm.textblock import emptied

#: Distinct merged pre-tokens that a worker remembers beside the proven ones.
REMEMBERED = 400_000

#: The published pre-token patterns of the two vocabularies, by end-of-word suffix.
PRE_TOKENS = {
    "": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "</w>": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
_END = chr(0x300)


def _class(*starts: str) -> str:
    points = (i for i in range(ord(_END)) if unicodedata.category(chr(i)).startswith(starts))
    return "".join(f"\\u{i:04x}" for i in points)


def _latin(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0300, where plain `re` classes say the same faster."""
    letter, number = _class("L"), _class("N")
    space = "".join(f"\\u{i:04x}" for i in range(ord(_END)) if regex.match(r"\s", chr(i)))
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    pattern = pattern.replace(r"[\p{L}]", f"[{letter}]").replace(r"\p{L}", f"[{letter}]")
    pattern = pattern.replace(r"[\p{N}]", f"[{number}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(pattern.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    symbols = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    assert set(symbols) == set(ByteLevel.alphabet())
    return symbols


class Pieces(dict):
    """Ids of pre-tokens as little-endian 32-bit bytes: proven whole tokens first, others when met."""

    def __init__(self, tokenizer: Tokenizer, suffix: str):
        super().__init__()
        symbols, special = byte_symbols(), {x.content for x in tokenizer.get_added_tokens_decoder().values()}
        self.end, ranks, whole = b"\xff" if suffix else b"", {}, {}
        for string, i in tokenizer.get_vocab(with_added_tokens=True).items():
            if string in special:
                continue
            ended = bool(suffix) and string.endswith(suffix)
            raw = bytes(symbols[c] for c in (string.removesuffix(suffix) if ended else string))
            ranks[raw + self.end * ended] = i
            if (ended or not suffix) and (text := raw.decode("utf-8", "ignore")).encode() == raw:
                whole[text] = i
        # Merges go by rank, and ids are ranks here, so the merges can run on ids. 0xFF never
        # stands in UTF-8: it marks the end of a word, and its pairs have the lowest ranks.
        self.merges = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe
        alone = tokenizer.encode_batch([*whole], add_special_tokens=False)
        self.unproven = {}
        for (text, i), e in zip(whole.items(), alone, strict=True):
            ids = np.array(e.ids, "<u4").tobytes()
            if e.ids == [i]:
                self[text] = ids
            else:
                self.unproven[text] = ids
        self.update(self.unproven)
        self.known = len(self)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.known + REMEMBERED:
            for key in list(self)[self.known :]:
                del self[key]
        ids = self[piece] = np.array(self.merges.encode_single_piece(piece.encode() + self.end), "<u4").tobytes()
        return ids


class Classes(dict):
    """For str.translate: each character from U+0300 on becomes one of its class below, asked once."""

    def __init__(self, split: PreTokenizer):
        super().__init__()
        self.split = split

    def __missing__(self, code: int) -> int:
        if code < ord(_END):
            return code
        c = chr(code)
        joins = lambda x: [at for _, at in self.split.pre_tokenize_str(x + c)] == [(0, 2)]
        if joins("z"):
            found = "z"  # a letter that ends no contraction
        elif joins("!"):
            found = "!"
        else:  # numbers may stand alone, and spaces be left out
            found = "1" if joins("1") or [at for _, at in self.split.pre_tokenize_str("z" + c)] == [(0, 1), (1, 2)] and not c.isspace() else "\t"
        self[code] = ord(found)
        return self[code]


class Bpe:
    """ids(text): what the library gives with add_special_tokens=False, as 32-bit bytes."""

    def __init__(self, path: str):
        self.path = path
        library = self.library
        suffix = getattr(library.model, "end_of_word_suffix", None) or ""
        self.lower = bool(suffix)
        self.pieces, self.cut = Pieces(library, suffix), _latin(PRE_TOKENS[suffix])
        self.special = [x.content for x in library.get_added_tokens_decoder().values()]
        self.normal, self.classes = library.normalizer, Classes(library.pre_tokenizer)
        del self.library  # comes back for the first text that needs it

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.no_padding()
        library.no_truncation()
        return library

    def found(self, text: str) -> list[str] | None:
        """The pre-tokens, or None if the text is the library's."""
        if any(x in text for x in self.special):
            return None
        plain = text.lower() if self.lower else text
        if plain.isascii() or max(plain) < _END:
            return self.cut.findall(plain)
        text = self.normal.normalize_str(text) if self.normal else text
        return [text[slice(*m.span())] for m in self.cut.finditer(text.translate(self.classes))]

    def ids(self, text: str) -> bytes:
        found = self.found(text)
        if found is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, found))

    def count(self, text: str) -> int:
        found = self.found(text)
        if found is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(len, map(self.pieces.__getitem__, found))) // 4


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


emptied.append(load.cache_clear)
