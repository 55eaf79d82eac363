"""Anchors of texts over the stretch, and over what a place and a hash share."""

import numpy as np
import pytest

from spendloom.llm import op7_suffix_dedup as op7


def together(parts):
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


@pytest.mark.parametrize("stretch", [250, 1_000, 4_097])
def test_stretches_have_the_runs_of_the_whole(stretch):
    rng = np.random.default_rng(stretch)
    data = rng.integers(97, 99, 20_000).astype(np.uint8)
    data[3_000:4_500] = 97
    data[9_000:9_700] = data[100:800]
    bounds = np.array([0, 50, 50, 12_000, 12_090, 20_000])
    whole = together(op7._runs(data, bounds, 100, 64, 1 << 20))
    parts = together(op7._runs(data, bounds, 100, 64, stretch))
    assert len(whole[0]) > 100
    for a, b in zip(whole, parts, strict=True):
        assert a.tolist() == b.tolist()


def test_a_text_of_over_64_mb():
    size = (1 << 26) + 1_000
    data = np.random.default_rng(1).integers(97, 123, size).astype(np.uint8)
    data[-500:] = data[1_000:1_500]
    at, h, around, first, last = together(op7._runs(data, np.array([0, size]), op7.LENGTH))
    assert (last - first + 1).sum() == size - op7.LENGTH + 1 and (first[1:] == last[:-1] + 1).all()
    end = h[last >= size - op7.LENGTH]
    assert set(end.tolist()) <= set(h[:100].tolist())
