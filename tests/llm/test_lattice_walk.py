import math

import numpy as np
import public_tokenizers
import pytest

from phonelens.llm.lattice_lm import SPACE_MARK, Lattice, vocabulary
from phonelens.llm.queries import PIECE_MODEL


class Looked(dict):
    n = 0

    def get(self, *key):
        self.n += 1
        return super().get(*key)


@pytest.fixture(scope="module")
def lattice():
    path = str(public_tokenizers.path(PIECE_MODEL))
    pieces, of_bytes = vocabulary(path)
    size = 1 + max(*pieces.values(), *of_bytes.values())
    return Lattice(path, np.log(np.random.default_rng(5).random(size) * 1e-4 + 1e-9))


def _every_segmentation(lattice, s):
    if not s:
        return 1.0
    total = 0.0 if s[0] in lattice.weight else math.exp(lattice.spelled(s[0])) * _every_segmentation(lattice, s[1:])
    for k in range(1, len(s) + 1):
        if s[:k] in lattice.weight:
            total += math.exp(lattice.weight[s[:k]]) * _every_segmentation(lattice, s[k:])
    return total


@pytest.mark.parametrize("word", ["a", "the", "counting", "xqzj", "naïve", "日本語", "-->", "☃☃"])
def test_word_sums_every_segmentation(lattice, word):
    assert lattice.word(word) == pytest.approx(math.log(_every_segmentation(lattice, SPACE_MARK + word)), rel=1e-12)


def test_walk_stops_where_no_piece_goes_on(lattice, monkeypatch):
    """Not every substring up to the longest piece is looked up."""
    looked = Looked(lattice.walk)
    monkeypatch.setattr(lattice, "walk", looked)
    word = "qzxj" * 50
    lattice.word(word)
    assert looked.n < 5 * len(word)
