"""Overlaps with substitutions, every pattern of them, and several stretches on one diagonal."""

import itertools

import numpy as np
import pytest

from tidemark.llm import decontam


def overlap_of(item, doc):
    index = decontam.SeedIndex([type("Row", (), {"item_id": 1, "words": np.array(item, np.uint64).view(np.int64)})], decontam.MASKS, 6)
    return index.overlaps(np.array(doc, np.uint64), decontam.MIN_WORDS, decontam.MIN_AGREE).get(0)


@pytest.mark.parametrize("words, changed", [(12, 2), (13, 2), (15, 3), (20, 4)])
def test_every_pattern_of_substitutions_is_found(words, changed):
    item = list(range(1, words + 1))
    for places in itertools.combinations(range(words), changed):
        doc = [900, 901, *(1000 + w if w - 1 in places else w for w in item), 902]
        assert overlap_of(item, doc) is not None, places


def test_a_passage_after_a_short_hit_on_its_diagonal_is_found():
    item = list(range(1, 61))
    doc = [*item[:12], *range(500, 520), *item[32:]]
    assert overlap_of(item, doc) == (32, 32, 28, 28)
    assert overlap_of(item, [*item[:12], *range(500, 548)]) is None
