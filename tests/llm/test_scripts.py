"""Token ids of texts in many scripts, without the library's help, against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spendloom.llm import bpe

POOLS = [
    "abc XYZ 12 'S don't we'll ", "αβγΣσς ΑΒΓ", "привет МИР", "漢字 仮名 ー々", "عربى ٣٤٥ ", "हिन्दी १२३ ", "‘’“”–—…€ ™", "😀👍🏽👩‍👧 ",
    "̀́é ñ", "  　  \t\n​", "ⅷ½²①Ⅳ ", "ǅ İ ı ſ ẞ ﬁ", "\U0001d400\U00010400\U000e0001͸\U0001fae9",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_scripts(name):
    random.seed(4)
    path = public_tokenizers.path(name)
    model, library = bpe.Bpe(path), Tokenizer.from_file(path)
    for i in range(1_500):
        if i % 3:
            text = "".join(random.choice(random.choice(POOLS)) if random.random() < 0.5 else random.choice("abcdet's 12!, ") for _ in range(random.randint(1, 60)))
        else:
            text = "".join(chr(random.choice([random.randint(1, 0xD7FF), random.randint(0xE000, 0x10FFFF)])) for _ in range(12))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert model.ids(text) == want and model.count(text) == len(want) // 4
    assert "library" not in vars(model)
